"""Retrieval, audit, gate, structure and metrics on small inputs with known results."""

import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import audit as A
from lodestone.operators import corpus as C
from lodestone.operators import index as X
from lodestone.operators import filters as P
from lodestone.operators import memory as E
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import structure as S
from lodestone.plans import audit as audit_plans


def test_core_does_not_need_the_corpus_subpackage():
    root = Path(__file__).parent.parent / "lodestone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+\S*llm", p.read_text(encoding="utf8")), p


def brute_bm25(queries, docs):
    tok = lambda t: [w.lower() for w in re.findall(T.BM25_TOKEN.replace("(?:", "(?:"), t or "")]
    own = {k: tok(t) for k, t in docs.items()}
    own = {k: v for k, v in own.items() if v}
    n, avg = len(own), max(1.0, sum(map(len, own.values())) / max(1, len(own)))
    out = []
    for q, text in queries.items():
        scored = []
        for k, w in own.items():
            s = 0.0
            for t in tok(text):
                df, tf = sum(t in x for x in own.values()), w.count(t)
                if tf:
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
            if s > 0:
                scored.append((-round(s, 6), k))
        out += [(q, k, i + 1) for i, (_, k) in enumerate(sorted(scored)[:10])]
    return sorted(out)


def test_bm25_against_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = {f"d{i:02d}": " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))) for i in range(40)}
    docs["d90"] = None
    queries = {"q1": "w1 w2 w2 unknown", "q2": "w5", "q3": "", "q4": None}
    post = C.postings(spark.createDataFrame(list(docs.items()), "id string, text string"), "id")
    got = R.bm25(spark.createDataFrame(list(queries.items()), "query_id string, query string"), X.of_postings(post, "id"))
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == brute_bm25(queries, docs)


def test_dense_in_blocks_equals_brute_force(spark):
    rnd = random.Random(2)
    vec = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    v = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    dot = {(r.query_id, r.vec_id): r.s for r in q.crossJoin(v.withColumnRenamed("embedding", "e")).select(
        "query_id", "vec_id", F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("s")).collect()}
    want = {(a, b) for a in range(7) for b, _ in sorted(((b, -dot[a, b]) for b in range(61)), key=lambda x: (x[1], x[0]))[:5]}
    for block in (3, 1000):
        assert {(r.query_id, r.vec_id) for r in R.dense(q, v, k=5, block=block).collect()} == want
    assert R.dense(q.limit(0), v).count() == 0


def test_fusion_orders_ties_by_id(spark):
    legs = spark.createDataFrame([("q", "dense", "b", 1), ("q", "sparse", "a", 1), ("q", "dense", "c", 2), ("q", "sparse", "c", 3), ("q", "dense", "z", None)],
                                 "query_id string, leg string, chunk_id string, leg_rank int")
    got = [(r.chunk_id, r.rank, r.n_legs, r.best_leg) for r in R.fuse(legs, "chunk_id").orderBy("rank").collect()]
    assert got == [("c", 1, 2, "dense"), ("a", 2, 1, "sparse"), ("b", 3, 1, "dense")]


def test_filters_treat_nulls_as_told(spark):
    rows = [("a", "d1", "method", "body", 1, 2, True), ("b", None, None, None, None, None, None), ("c", "d2", "references", "body", 4, 6, False)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, section string, chunk_type string, page_start int, page_end int, has_table boolean")
    pick = lambda f: [r.chunk_id for r in df.where(f.column()).orderBy("chunk_id").collect()]
    assert pick(P.MetadataFilter()) == ["a", "b", "c"]
    assert pick(P.MetadataFilter(has_table=False)) == ["b", "c"]
    assert pick(P.MetadataFilter(page_min=2, page_max=4)) == ["a", "c"]
    assert pick(P.MetadataFilter(exclude_references=True, doc_ids=["d1", "d2"])) == ["a"]


def test_gate_fails_closed(spark):
    rows = [("ok", "strong", 0.9, True, ["k1"]), ("level", "great", 0.9, True, ["k1"]), ("conf", "strong", float("nan"), True, ["k1"]), ("none", "strong", 0.9, True, None),
            ("foreign", "strong", 0.9, True, ["k1", "x"]), ("mism", "strong", 0.9, False, ["k1"]), ("weak", "partial", 0.9, True, ["k1"]), ("null", None, None, None, None)]
    j = spark.createDataFrame(rows, "result_id string, support_level string, confidence double, answerable boolean, ids array<string>")
    got = {r.result_id: (r.decision, r.reason) for r in A.gate(j, spark.createDataFrame([("k1",)], "chunk_id string")).collect()}
    assert got.pop("ok") == ("accept", "")
    assert all(d == "reject" for d, _ in got.values())
    assert got["foreign"][1] == "foreign_evidence" and got["conf"][1] == "bad_confidence" and got["null"][1] == "unknown_level"


def test_claim_verdicts_keep_claims_without_evidence(spark):
    claims = spark.createDataFrame([("c1", "the index improves recall by 12 points"), ("c2", "nothing here"), ("c3", None)], "claim_id string, text string")
    ev = spark.createDataFrame([("e1", "the index improves recall by 12 points on all sets"), ("e2", "the index lowers recall, it is worse by 7")], "chunk_id string, text string")
    pairs = spark.createDataFrame([("c1", "e1"), ("c1", "e2"), ("c3", "e1")], "claim_id string, chunk_id string")
    s = A.overlaps(claims, ev, pairs)
    assert {r.claim_id: r.verdict for r in A.verdicts(claims, s).collect()} == {"c1": "supported", "c2": "unsupported", "c3": "unsupported"}
    assert {r.claim_id: r.status for r in A.numeric_consistency(claims, s).collect()} == {"c1": "consistent", "c2": "not_applicable", "c3": "not_applicable"}
    assert {r.claim_id: r.status for r in A.polarity(claims, s).collect()} == {"c1": "consistent", "c2": "uncertain", "c3": "uncertain"}


def test_greedy_alignment_is_one_to_one(spark):
    e = spark.createDataFrame([("k", 0, "dense index reads passages"), ("k", 1, "dense index reads all passages")], "case_id string, exp_no int, text string")
    f = spark.createDataFrame([("k", "a", "dense index reads all passages"), ("k", "b", "dense index reads passages")], "case_id string, claim_id string, text string")
    assert sorted((r.exp_no, r.claim_id) for r in A.align(e, f).collect()) == [(0, "b"), (1, "a")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Shown in [3] and by Smith et al. (2020); see (Lee, 2019). Table 4 has 5.2% of T5x.", 1)], "t string, n int")
    r = df.select(T.citations(F.col("t")).alias("c"), T.claim_numbers(F.col("t")).alias("n"), T.audit_tokens(F.lit("检索系统 a1 3%")).alias("a"),
                  T.overclaim(F.lit("It never fails")).alias("o"), T.word_count(F.lit("  ")).alias("w"), T.compact(F.lit("abcdef"), 4).alias("k")).first()
    assert r.c == ["(Lee, 2019)", "Smith et al. (2020)", "[3]"]
    assert r.n == ["2020", "2019", "5.2%"]
    assert set(r.a) == {"a1", "3%", "检索系统", "检索", "索系", "系统"}
    assert (r.o, r.w, r.k) == ("severe", 0, "abc…")


def test_manifest_diff_and_sync_guard(spark):
    s = "chunk_id string, content_hash string, metadata string"
    before = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "1", "m"), ("d", "1", None)], s)
    after = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("d", "1", "x"), ("e", "1", "m")], s)
    diff = C.manifest_diff(before, after)
    assert {r.chunk_id: r.change for r in diff.collect()} == {"a": "reused", "b": "updated", "c": "removed", "d": "metadata_changed", "e": "added"}
    assert C.sync_plan(diff).first().allowed is False and C.sync_plan(diff, 0.5).first().allowed is True
    assert C.sync_plan(diff.limit(0)).first().allowed is True


def test_chunker_covers_blocks_and_keeps_limits(spark):
    rnd = random.Random(4)
    rows = [("d1", i, "method" if i < 14 else "references", " ".join(f"word{i}x{k}." if k % 9 == 8 else f"word{i}x{k}" for k in range(rnd.choice((3, 40, 120, 500))))) for i in range(20)]
    rows += [("d2", 0, "method", None), ("d2", 1, "method", " ")]
    df = spark.createDataFrame(rows, "doc_id string, block_no int, section string, text string")
    out = S.build_chunks(df).orderBy("chunk_no").collect()
    assert all(len(r.text) <= 1600 for r in out) and {r.doc_id for r in out} == {"d1"}
    seen = re.findall(r"word\d+x\d+", " ".join(r.text for r in out))
    assert set(seen) == set(re.findall(r"word\d+x\d+", " ".join(r[3] or "" for r in rows)))
    assert not any(r.n_overlap for r in out if r.section == "references")
    again = S.build_chunks(df.repartition(5)).orderBy("chunk_no").collect()
    assert out == again


def test_ledger_is_idempotent(spark):
    claims = spark.createDataFrame([("a", "supported"), ("b", "supported"), ("c", "unsupported")], "claim_id string, support_level string")
    refs = spark.createDataFrame([("a", "k"), ("b", "gone")], "claim_id string, chunk_id string")
    known = spark.createDataFrame([("k",)], "chunk_id string")
    first = E.ledger_rows(claims, refs, known, claims.limit(0))
    assert {r.claim_id for r in first.collect()} == {"a", "c"}
    assert E.ledger_rows(claims, refs, known, first).count() == 0


def test_metrics_of_empty_inputs(spark):
    v = spark.createDataFrame([], "answerable boolean, passed boolean")
    assert M.confusion(v, "answerable", "passed").first().f1 == 0.0
    ranks = spark.createDataFrame([], "query_id string, chunk_id string, mode string, rank int")
    rel = spark.createDataFrame([("q", "c")], "query_id string, chunk_id string")
    assert {r.rr for r in M.relevance(ranks, rel).collect()} == {0.0}


def test_gap_sessions_and_carry(spark):
    df = spark.sql("SELECT * FROM VALUES ('u', TIMESTAMP_NTZ '2025-01-01 00:00:00', 1, 'h'), ('u', TIMESTAMP_NTZ '2025-01-01 00:10:00', 2, NULL), ('u', TIMESTAMP_NTZ '2025-01-01 02:00:00', 3, NULL) AS t(g, ts, id, v)")
    assert [r.session for r in S.gap_sessions(df, "g", "ts", "id", 3600).orderBy("id").collect()] == [0, 0, 1]


def test_hits_without_text_are_reranked_by_the_text_of_their_chunk(spark, tmp_path):
    hits = [(1, "q1", "c1", 1, "the dense index"), (2, "q2", "c1", 2, None), (2, "q2", "c1", 2, None), (3, "q2", "c2", 3, None), (4, "q1", "c3", 21, "a list")]
    kinds = {"page_start": "int", "page_end": "int", "has_equation": "boolean", "has_table": "boolean", "has_caption": "boolean"}
    rest = {c: F.lit(None).cast(kinds.get(c, "string")) for c in C._FIELDS if c != "text"}
    spark.createDataFrame(hits, "hit_id long, query_id string, chunk_id string, fusion_rank int, text string").withColumns(rest).write.parquet(str(tmp_path / "retrieval_hits.parquet"))
    spark.createDataFrame([("q1", "dense index", "a"), ("q2", "dense index", "b")], "case_id string, query string, answer string").write.parquet(
        str(tmp_path / "citation_audit_v1_queries.parquet"))
    got = {r.id: r.score for r in audit_plans.rerank_backend_scores(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["1", "2"] and got["1"] == got["2"]


def test_stored_index_is_checked(spark, tmp_path):
    texts = spark.createDataFrame([("a", "dense index dense"), ("b", "index list"), ("c", ""), ("d", None), (None, "x")], "id string, text string")
    path = str(tmp_path / "index")
    X.build(texts, "id", path)
    index = X.load(spark, path, "id", strict=True)
    assert {r.counter: r.n for r in X.faults(index, texts.where("id IN ('a', 'b', 'c')")).where("n > 0").collect()} == {"texts_not_indexed": 1}
    index.postings.where("term <> 'dense'").write.parquet(str(tmp_path / "bad" / "postings"))
    index.stats.write.parquet(str(tmp_path / "bad" / "stats"))
    with pytest.raises(ValueError, match="wrong_lengths"):
        X.load(spark, str(tmp_path / "bad"), "id", strict=True)
    X.build(texts.limit(0), "id", path)
    assert X.load(spark, path, "id", strict=True).postings.count() == 0
