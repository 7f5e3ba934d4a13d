"""Retrieval queries over chunks, cases, stored hits and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..operators import corpus as C
from ..operators import filters as P
from ..operators import index as X
from ..operators import retrieval as R
from ..session import shared_folder, written
from ..tables import load
from .corpus import CH, POST, chunk_postings

#: Phrases that the notices of the corpus at hand use.
NOTICES = ("all rights reserved", "under review", "annals of", "preprint", "licence", "license")
FILTER = P.MetadataFilter(sections=("method", "experiment", "result"), chunk_types=("body", "mixed"), page_min=2, page_max=12, exclude_references=True)


def _chunks(spark, sf_dir):
    return C.chunks(load(spark, sf_dir, "retrieval_hits"))


def _queries(spark, sf_dir):
    c = load(spark, sf_dir, "citation_audit_v1_queries").where(R.every_hundredth("case_id"))
    return c.groupBy(F.col("case_id").alias("query_id")).agg(F.max("query").alias("query"))


_STORED: dict = {}


def _stored(spark, sf_dir, name, texts, key):
    """The stored index of a data directory, built by the first search of a session."""
    at = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir, name)
    if at not in _STORED:
        path = f"{shared_folder(spark)}/lodestone/{at[0]}/index-{name}-{uuid.uuid4().hex}"
        X.build(texts, key, path)
        _STORED[at] = path
    return X.load(spark, _STORED[at], key)


def _index(spark, sf_dir):
    return _stored(spark, sf_dir, "chunks", C.chunks(load(spark, sf_dir, "retrieval_hits")).select("chunk_id", "text"), "chunk_id")


def _document_index(spark, sf_dir):
    return _stored(spark, sf_dir, "documents", load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def index_build_load_search(spark, sf_dir):
    """Stored, checked (an index with a fault is refused), loaded and searched."""
    path = f"{shared_folder(spark)}/lodestone/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    X.build(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id", path)
    return R.bm25(_queries(spark, sf_dir), X.load(spark, path, "chunk_id", strict=True), k=5)


def index_faults(spark, sf_dir):
    texts = _chunks(spark, sf_dir).where(F.size(bm25_tokens(F.col("text"))) > 0).select("chunk_id")
    return X.faults(_index(spark, sf_dir), texts)


def bm25_distinct_tokens(spark, sf_dir):
    """BM25 over the different tokens of a text: every frequency is one."""
    post = chunk_postings(spark, sf_dir).withColumn("tf", F.lit(1).cast("long"))
    return R.bm25(_queries(spark, sf_dir), X.of_postings(written(post, "postings"), "chunk_id"))


def bm25_topk(spark, sf_dir):
    return R.bm25(_queries(spark, sf_dir), _index(spark, sf_dir))


def bm25_filtered_topk(spark, sf_dir):
    keep = _chunks(spark, sf_dir).where(FILTER.column())
    return R.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), keep=keep)


def _self_queries(docs):
    """The whole text of every hundredth document as a query."""
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def self_retrieval_hits(spark, sf_dir):
    """Every hundredth document asked for with its own text: whether it is among the ten
    best, and its rank and score (null where it is not)."""
    asked = _self_queries(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = R.bm25(asked, _document_index(spark, sf_dir), k=10).where(F.col("doc_id") == F.col("query_id")).select("query_id", "rank", "score")
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.col("rank").isNotNull().alias("found"), "rank", "score")


def _vec_queries(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_cosine_topk(spark, sf_dir):
    return R.dense(_vec_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"))


def dense_dot_topk(spark, sf_dir):
    return R.dense(_vec_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), cosine=False)


def hybrid_rrf_topk(spark, sf_dir):
    return R.fuse(R.legs_of_hits(load(spark, sf_dir, "retrieval_hits")), "chunk_id")


def hybrid_weighted_rrf(spark, sf_dir):
    return R.fuse(R.legs_of_hits(load(spark, sf_dir, "retrieval_hits")), "chunk_id", {"dense": 0.7, "sparse": 0.3})


def multi_query_rrf(spark, sf_dir):
    """Every hundredth case asked in two variants, its query and its answer, fused."""
    c = load(spark, sf_dir, "citation_audit_v1_queries").where(R.every_hundredth("case_id")).groupBy("case_id").agg(
        F.max("query").alias("query"), F.max("answer").alias("answer"))
    variants = c.select(F.explode(F.array(
        F.struct(F.concat("case_id", F.lit("|a_query")).alias("query_id"), F.col("query").alias("query")),
        F.struct(F.concat("case_id", F.lit("|b_answer")).alias("query_id"), F.col("answer").alias("query")))).alias("v")).select("v.*")
    found = R.bm25(variants, _index(spark, sf_dir), k=20)
    legs = found.select(F.split("query_id", r"\|")[0].alias("query_id"), F.split("query_id", r"\|")[1].alias("leg"), "chunk_id", F.col("rank").alias("leg_rank"))
    return R.fuse(legs, "chunk_id")


def rerank_topk(spark, sf_dir):
    """The stored rerank scores of the 20 best fused hits, sorted again, ten kept."""
    h = load(spark, sf_dir, "retrieval_hits").where("fusion_rank <= 20 AND rerank_score IS NOT NULL").dropDuplicates(["hit_id"]).select(
        "query_id", "chunk_id", "fusion_rank", F.col("rerank_score").alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fusion_rank", "chunk_id")
    return h.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def document_hybrid_topk(spark, sf_dir):
    """Full hybrid over documents: BM25 for the text of every hundredth document,
    fused with the nearest vectors.  A vector stands for the document of its id;
    that pairing is made up, the tables have none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    sparse = R.bm25(_self_queries(docs), _document_index(spark, sf_dir), k=20).select("query_id", F.lit("sparse").alias("leg"), "doc_id", F.col("rank").alias("leg_rank"))
    near = R.dense(_vec_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), k=20).select(
        "query_id", F.lit("dense").alias("leg"), F.col("vec_id").alias("doc_id"), F.col("rank").alias("leg_rank"))
    return R.fuse(sparse.unionByName(near), "doc_id")


def metadata_filter_conjunction(spark, sf_dir):
    return _chunks(spark, sf_dir).where(FILTER.column()).select("chunk_id", "section", "chunk_type", "page_start", "page_end")


def filter_tristate(spark, sf_dir):
    f = P.MetadataFilter(has_equation=False, has_table=True)
    return _chunks(spark, sf_dir).where(f.column()).select("chunk_id", "section")


def page_overlap_filter(spark, sf_dir):
    return _chunks(spark, sf_dir).where(P.MetadataFilter(page_min=3, page_max=4).column()).select("chunk_id", "page_start", "page_end")


def noise_filter(spark, sf_dir):
    return _chunks(spark, sf_dir).where(P.is_noise(F.col("text"))).select("chunk_id", "section")


def boilerplate_filter(spark, sf_dir):
    return _chunks(spark, sf_dir).where(P.has_phrase(F.col("text"), NOTICES)).select("chunk_id", "section")


def unfinished_answers(spark, sf_dir):
    c = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("answer").alias("answer"))
    return c.where(P.is_unfinished(F.col("answer"))).select("case_id")


def best_score_ladder(spark, sf_dir):
    """The best available score of each hit and the stage it comes from, with a page label."""
    h = load(spark, sf_dir, "retrieval_hits").dropDuplicates(["hit_id"])
    ladder = ("rerank_score", "fusion_score", "dense_score", "sparse_score")
    stage = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in ladder])
    label = F.when(F.col("page_start").isNull(), "").when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(
        F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    return h.select("hit_id", F.round(F.coalesce(*ladder), 6).alias("best_score"), stage.alias("stage"), label.alias("pages"))


def required_field_gaps(spark, sf_dir):
    """Hits that lack a required field, per field."""
    h = load(spark, sf_dir, "retrieval_hits").dropDuplicates(["hit_id"])
    fields = ("chunk_id", "doc_id", "title", "section", "chunk_type", "page_start", "text")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return h.select(F.explode(F.array_compact(F.array(*[F.when(blank(c), c) for c in fields]))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_filtered_topk, self_retrieval_hits, dense_cosine_topk, dense_dot_topk, hybrid_rrf_topk, hybrid_weighted_rrf, multi_query_rrf, rerank_topk,
    document_hybrid_topk, metadata_filter_conjunction, filter_tristate, page_overlap_filter, noise_filter, boilerplate_filter, unfinished_answers,
    best_score_ladder, required_field_gaps, index_build_load_search, index_faults, bm25_distinct_tokens)}

_TOK = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9_.+-]*|[0-9]+(?:\\.[0-9]+)*|[A-Za-z0-9]+'), lambda x: lower(x))"
_NUM = "coalesce(TRY_CAST(regexp_extract({c}, '([0-9]+)$', 1) AS BIGINT) % 100 = 0, FALSE)"


def _bm25(queries: str, post: str = "post", key: str = "chunk_id", k: int = 10, where: str = "") -> str:
    return f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format(c='query')}) AS term FROM {queries}) GROUP BY 1, 2),
dl AS (SELECT {key}, sum(tf) AS dl FROM {post} GROUP BY 1), tot AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM dl),
dfs AS (SELECT term, count(*) AS df FROM {post} GROUP BY 1),
sc AS (SELECT qt.query_id, p.{key}, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.dl / avgdl))), 6) AS score
  FROM qt JOIN dfs ON qt.term = dfs.term JOIN {post} p ON p.term = qt.term JOIN dl ON dl.{key} = p.{key}, tot {where} GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_Q = f"q AS (SELECT case_id AS query_id, max(query) AS query FROM citation_audit_v1_queries WHERE {_NUM.format(c='case_id')} GROUP BY 1)"
_F = "section IN ('method', 'experiment', 'result') AND chunk_type IN ('body', 'mixed') AND page_end >= 2 AND page_start <= 12 AND section IS DISTINCT FROM 'references'"
_DENSE = """dn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id, round({f}(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0))"""
_LEGS = """l AS (SELECT query_id, chunk_id, leg, leg_rank FROM (SELECT DISTINCT hit_id, query_id, chunk_id, dense_rank, sparse_rank FROM retrieval_hits)
 CROSS JOIN LATERAL (VALUES ('dense', dense_rank), ('sparse', sparse_rank)) AS t(leg, leg_rank) WHERE leg_rank IS NOT NULL)"""


def _fuse(weight: str, key: str = "chunk_id") -> str:
    return f"""SELECT query_id, {key}, score, CAST(rank AS INTEGER) AS rank, n_legs, best_leg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM
 (SELECT query_id, {key}, round(sum({weight} / (60 + leg_rank)), 9) AS score, count(DISTINCT leg) AS n_legs, min(lpad(CAST(leg_rank AS VARCHAR), 9, '0') || leg)[10:] AS best_leg
  FROM l GROUP BY 1, 2)) WHERE rank <= 10"""


_DOCPOST = f"""post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(c='text')}) AS term FROM documents) GROUP BY 1, 2),
        q AS (SELECT doc_id AS query_id, coalesce(text, '') AS query FROM documents WHERE doc_id % 100 = 0)"""
_BOIL = " OR ".join(f"contains(t, '{w}')" for w in NOTICES)
ORACLE = {
    "bm25_topk": f"WITH {CH}, {POST}, {_Q}, {_bm25('q')} SELECT query_id, chunk_id, score, rank FROM bm",
    "bm25_filtered_topk": f"WITH {CH}, {POST}, {_Q}, {_bm25('q', where=f'WHERE p.chunk_id IN (SELECT chunk_id FROM ch WHERE {_F})')} SELECT query_id, chunk_id, score, rank FROM bm",
    "self_retrieval_hits": f"""WITH {_DOCPOST}, {_bm25('q', key='doc_id')} SELECT q.query_id, bm.rank IS NOT NULL AS found, bm.rank, bm.score
        FROM q LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = q.query_id""",
    "index_build_load_search": f"WITH {CH}, {POST}, {_Q}, {_bm25('q', k=5)} SELECT query_id, chunk_id, score, rank FROM bm",
    "index_faults": "SELECT unnest(['null_keys_or_terms', 'bad_frequencies', 'repeated_postings', 'wrong_lengths', 'wrong_document_frequencies', 'texts_not_indexed', 'wrong_statistics']) AS counter, CAST(0 AS BIGINT) AS n",
    "bm25_distinct_tokens": f"WITH {CH}, {POST}, one AS (SELECT chunk_id, term, 1 AS tf FROM post), {_Q}, {_bm25('q', post='one')} SELECT query_id, chunk_id, score, rank FROM bm",
    "dense_cosine_topk": f"WITH {_DENSE.format(f='list_cosine_similarity')} SELECT * FROM dn WHERE rank <= 10",
    "dense_dot_topk": f"WITH {_DENSE.format(f='list_dot_product')} SELECT * FROM dn WHERE rank <= 10",
    "hybrid_rrf_topk": f"WITH {_LEGS} {_fuse('1.0')}",
    "hybrid_weighted_rrf": f"WITH {_LEGS} {_fuse('CASE leg WHEN ' + chr(39) + 'dense' + chr(39) + ' THEN 0.7 ELSE 0.3 END')}",
    "multi_query_rrf": f"""WITH {CH}, {POST}, c AS (SELECT case_id, max(query) AS query, max(answer) AS answer FROM citation_audit_v1_queries WHERE {_NUM.format(c='case_id')} GROUP BY 1),
        q AS (SELECT case_id || '|a_query' AS query_id, query FROM c UNION ALL SELECT case_id || '|b_answer', answer FROM c), {_bm25('q', k=20)},
        l AS (SELECT split_part(query_id, '|', 1) AS query_id, split_part(query_id, '|', 2) AS leg, chunk_id, rank AS leg_rank FROM bm) {_fuse('1.0')}""",
    "rerank_topk": """SELECT query_id, chunk_id, fusion_rank, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fusion_rank, chunk_id) AS rank
        FROM (SELECT DISTINCT hit_id, query_id, chunk_id, fusion_rank, rerank_score AS score FROM retrieval_hits WHERE fusion_rank <= 20 AND rerank_score IS NOT NULL)) WHERE rank <= 10""",
    "document_hybrid_topk": f"""WITH {_DOCPOST}, {_bm25('q', key='doc_id', k=20)},
        {_DENSE.format(f='list_cosine_similarity')}, l AS (SELECT query_id, 'sparse' AS leg, doc_id, rank AS leg_rank FROM bm UNION ALL
        SELECT query_id, 'dense', vec_id, rank FROM dn WHERE rank <= 20) {_fuse('1.0', 'doc_id')}""",
    "metadata_filter_conjunction": f"WITH {CH} SELECT chunk_id, section, chunk_type, page_start, page_end FROM ch WHERE {_F}",
    "filter_tristate": f"WITH {CH} SELECT chunk_id, section FROM ch WHERE NOT coalesce(has_equation, FALSE) AND coalesce(has_table, FALSE)",
    "page_overlap_filter": f"WITH {CH} SELECT chunk_id, page_start, page_end FROM ch WHERE page_end >= 3 AND page_start <= 4",
    "noise_filter": f"""WITH {CH}, s AS (SELECT chunk_id, section, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS s FROM ch)
        SELECT chunk_id, section FROM s WHERE s = '' OR regexp_matches(s, '^[0-9]{{1,4}}$') OR (length(s) < 12 AND NOT regexp_matches(s, '[A-Za-z一-鿿]'))
        OR (length(s) >= 20 AND length(regexp_replace(s, '[^A-Za-z0-9一-鿿]', '', 'g')) < 0.18 * length(s))""",
    "boilerplate_filter": f"WITH {CH}, s AS (SELECT chunk_id, section, lower(coalesce(text, '')) AS t FROM ch) SELECT chunk_id, section FROM s WHERE {_BOIL}",
    "unfinished_answers": """WITH s AS (SELECT case_id, regexp_replace(coalesce(max(answer), ''), '\\s+$', '') AS t FROM citation_audit_v1_queries GROUP BY 1)
        SELECT case_id FROM s WHERE regexp_matches(lower(t), '(:|;|,|\\band|\\bor|\\bincluding|\\bsuch as)$') OR (length(t) < 220 AND NOT regexp_matches(t, '[.!?。！？)\\]]$'))""",
    "best_score_ladder": """SELECT DISTINCT hit_id, round(coalesce(rerank_score, fusion_score, dense_score, sparse_score), 6) AS best_score,
        CASE WHEN rerank_score IS NOT NULL THEN 'rerank_score' WHEN fusion_score IS NOT NULL THEN 'fusion_score' WHEN dense_score IS NOT NULL THEN 'dense_score'
        WHEN sparse_score IS NOT NULL THEN 'sparse_score' END AS stage,
        CASE WHEN page_start IS NULL THEN '' WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE concat_ws('-', page_start, page_end) END AS pages FROM retrieval_hits""",
    "required_field_gaps": "SELECT field, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT DISTINCT hit_id, '{c}' AS field FROM retrieval_hits WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''" for c in (
            "chunk_id", "doc_id", "title", "section", "chunk_type", "page_start", "text")) + ") GROUP BY field",
}
