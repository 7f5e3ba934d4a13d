"""What retrieval shuffles: never a pair of query and text, nor single postings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus as C
from lodestone.operators import index as X
from lodestone.operators import retrieval as R
from lodestone.plans import retrieval as P

TEXTS, WORDS, ASKED = 300, 20, 40


def shuffled(spark, run):
    """The result of ``run`` and the number of rows that its stages wrote to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    result = run()
    return result, rows() - before


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of 20 words that all texts have, and one of their own in five of them."""
    folder = tmp_path_factory.mktemp("tables")
    words = " ".join(f"common{i}" for i in range(WORDS))
    texts = [(i, f"{words} own{i} own{i}" if i % 5 == 0 else f"{words} common{i % 7}") for i in range(1, TEXTS + 1)]
    documents = [(i * 100 // 5 if i % 5 == 0 else i * 1000 + 1, t) for i, t in texts] + [(100, "again common1"), (200, None), (90_100, None), (90_200, "")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    kinds = {"page_start": "int", "page_end": "int", "has_equation": "boolean", "has_table": "boolean", "has_caption": "boolean"}
    rest = {c: F.lit(None).cast(kinds.get(c, "string")) for c in C._FIELDS if c != "text"}
    spark.createDataFrame([(f"c{i:04d}", t) for i, t in texts] + [("c0001", None), (None, "common1"), ("c9999", None)], "chunk_id string, text string").withColumns(rest).write.parquet(
        f"{folder}/retrieval_hits.parquet")
    cases = [(f"k{i * 100}", f"common1 common2 own{i * 5}", f"Common3, own{i * 5 + 5} unknown") for i in range(ASKED)] + [("k5", "common1", None), ("k90000", None, None)]
    spark.createDataFrame(cases, "case_id string, query string, answer string").write.parquet(f"{folder}/citation_audit_v1_queries.parquet")
    vectors = [(i * 100, [1.0, float(i)]) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def against_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "retrieval_hits", "citation_audit_v1_queries", "embeddings"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    got, n = shuffled(spark, lambda: P.QUERIES[name](spark, tables).collect())
    columns = ", ".join(got[0].asDict())
    as_rows = lambda rows: sorted([f"{x:.6g}" if isinstance(x, float) else str(x) for x in r] for r in rows)
    want = as_rows(con.execute(f"SELECT {columns} FROM ({P.ORACLE[name]})").fetchall())
    assert as_rows(got) == want
    return n


def test_document_hybrid_shuffles_no_pairs(spark, tables):
    assert against_sql(spark, tables, "document_hybrid_topk") < TEXTS * 60 / 2


def test_queries_in_blocks_find_the_same(spark):
    texts = spark.range(100).select(F.col("id"), F.concat(F.lit("all "), F.concat(F.lit("w"), F.col("id") % 10)).alias("text"))
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.concat(F.lit("all w"), F.col("id")).alias("query")).unionByName(
        spark.createDataFrame([(None, "w3")], "query_id long, query string"))
    index = X.of_postings(C.postings(texts, "id"), "id")
    once, blocks = ({tuple(r) for r in R.bm25(queries, index, k=4, block=b).collect()} for b in (1000, 2))
    assert once == blocks and len(once) == 40


def test_self_retrieval_shuffles_no_pairs(spark, tables):
    assert against_sql(spark, tables, "self_retrieval_hits") < TEXTS * 60 / 2


def test_bm25_shuffles_texts_and_terms_only(spark, tables):
    assert against_sql(spark, tables, "bm25_topk") < TEXTS * 10


def test_multi_query_shuffles_no_pairs(spark, tables):
    assert against_sql(spark, tables, "multi_query_rrf") < TEXTS * 20


def test_index_is_checked_text_by_text(spark, tables):
    assert against_sql(spark, tables, "index_build_load_search") < TEXTS * 10


def test_faults_of_a_stored_index(spark, tmp_path):
    counters = lambda at: {r.counter: r.n for r in X.faults(X.load(spark, at, "id")).where("n > 0").collect()}
    texts = spark.createDataFrame([("a", "dense index dense"), ("b", "index list"), ("a", "list")], "id string, text string")
    path, bad = str(tmp_path / "index"), str(tmp_path / "bad")
    X.build(texts, "id", path)
    index = X.load(spark, path, "id", strict=True)
    assert sorted(tuple(r) for r in index.postings.where("id = 'a'").collect()) == [("dense", "a", 2, 1, 4), ("index", "a", 1, 2, 4), ("list", "a", 1, 2, 4)]
    for p in ("terms", "stats"):
        spark.read.parquet(f"{path}/{p}").write.parquet(f"{bad}/{p}")
    index.texts.write.parquet(f"{bad}/postings")
    index.texts.where("id = 'b'").write.mode("append").parquet(f"{bad}/postings")  # a part stored twice
    assert counters(bad) == {"repeated_postings": 2, "wrong_lengths": 1, "wrong_document_frequencies": 2}
    index.texts.where("id = 'a'").write.mode("overwrite").parquet(f"{bad}/postings")  # a part lost
    assert counters(bad) == {"wrong_document_frequencies": 2, "wrong_statistics": 1}
