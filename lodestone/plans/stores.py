"""Sources, stores, caches, ledger and pipeline state over the domain tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import memory as E
from ..operators import metrics as M
from ..operators.references import normal_id
from ..session import shared_folder
from ..sources import jsonl, store
from ..tables import load
from .references import _norm

MOMENT = "2025-03-01"


def jsonl_roundtrip(spark, sf_dir):
    """The manifest written as canonical JSON lines and read back strictly: counts per section."""
    m = load(spark, sf_dir, "corpus_manifest").select("chunk_id", "section", "char_count", "content_hash")
    path = f"{shared_folder(spark)}/lodestone/jsonl-{uuid.uuid4().hex}"
    jsonl.write_canonical(m, path)
    return jsonl.read_strict(spark, path, m.schema).groupBy("section").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"), F.countDistinct("content_hash").alias("n_hashes"))


def metadata_codec(spark, sf_dir):
    h = load(spark, sf_dir, "retrieval_hits").select("hit_id", "heading_path", "content_types").dropDuplicates(["hit_id"])
    lists = ["heading_path", "content_types"]
    back = store.decode_metadata(store.encode_metadata(h, lists), lists)
    return back.select("hit_id", F.array_join("heading_path", ">").alias("path"), F.array_join("content_types", ",").alias("types"))


def vector_store_upsert(spark, sf_dir):
    """Every third vector replaced under another label, every tenth deleted: labels after that."""
    e = load(spark, sf_dir, "embeddings")
    after = store.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id")
    left = store.delete(after, e.where("vec_id % 10 = 0"), "vec_id")
    return left.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


def embedding_cache_fill(spark, sf_dir):
    """Chunk texts through a cache that already holds the papers' first chunks: hits and misses by hash."""
    h = load(spark, sf_dir, "retrieval_hits").where("text IS NOT NULL").groupBy("chunk_id").agg(F.max("text").alias("text"))
    seeded = h.where(F.col("chunk_id").endswith("_00001")).withColumn("key", store.cache_key(["text"], "v1")).dropDuplicates(["key"])
    cache = store.hashing_embedder()(seeded)
    rows, made = store.through_cache(h, cache, ["text"], "v1", store.hashing_embedder())
    new = made.select("key").withColumn("new", F.lit(1))
    return rows.join(new, "key", "left").agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"), F.countDistinct(F.when(F.col("new").isNotNull(), F.col("key"))).alias("n_computed"))


def ledger_append(spark, sf_dir):
    a = load(spark, sf_dir, "audited_claims")
    claims = a.select("claim_id", "support_level").dropDuplicates(["claim_id"])
    refs = M.ids_of(a, "claim_id", "candidate_chunk_ids")
    known = load(spark, sf_dir, "corpus_manifest").select(normal_id(F.col("chunk_id")).alias("chunk_id"))
    return E.ledger_rows(claims, refs, known, claims.limit(0))


def pipeline_status(spark, sf_dir):
    cases = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("answer").alias("answer"))
    hits = load(spark, sf_dir, "retrieval_hits").where("fusion_rank <= 10").select(F.col("query_id").alias("case_id"))
    v = load(spark, sf_dir, "evidence_sufficiency").select("case_id", "result_id", "judged_at", "support_level").dropDuplicates(["result_id"])
    claims = load(spark, sf_dir, "audited_claims").select("claim_id", "case_id", "support_level").dropDuplicates(["claim_id"])
    return E.pipeline_status(cases, hits, M.latest(v, ["case_id"], ["judged_at", "result_id"]), claims)


def snapshot_counts(spark, sf_dir):
    """Rows loaded up to a moment and after it, per table."""
    out = None
    for t in ("citation_audit_v1_queries", "evidence_sufficiency", "audited_claims", "corpus_manifest", "retrieval_hits", "documents"):
        late = F.col("loaded_at") >= F.lit(MOMENT).cast("timestamp_ntz")
        one = load(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
        out = one if out is None else out.unionByName(one)
    return out


def record_parity(spark, sf_dir):
    """Chunks of the hits against the manifest, field by field."""
    h = load(spark, sf_dir, "retrieval_hits").groupBy("chunk_id").agg(F.max("section").alias("s1"), F.max("chunk_type").alias("t1"), F.max("doc_id").alias("d1"), F.max("text").alias("x1"))
    m = load(spark, sf_dir, "corpus_manifest").groupBy("chunk_id").agg(F.max("section").alias("s2"), F.max("chunk_type").alias("t2"), F.max("doc_id").alias("d2"), F.max("content_hash").alias("x2"))
    j = h.withColumn("a", F.lit(1)).join(m.withColumn("b", F.lit(1)), "chunk_id", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("only_hits"), F.count_if(F.col("a").isNull()).alias("only_manifest"),
                 *[F.count_if(both & ~F.col(f"{c}1").eqNullSafe(F.col(f"{c}2"))).alias(n) for c, n in (("s", "other_section"), ("t", "other_type"), ("d", "other_paper"))],
                 F.count_if(both & (F.sha2("x1", 256) == F.col("x2"))).alias("same_hash"))


def stratified_sample(spark, sf_dir):
    """Three chunks per paper and type, those with the smallest hash of their id."""
    m = load(spark, sf_dir, "corpus_manifest").select("doc_id", "chunk_type", "chunk_id").distinct()
    w = Window.partitionBy("doc_id", "chunk_type").orderBy(F.md5("chunk_id"), "chunk_id")
    return m.withColumn("n", F.row_number().over(w)).where("n <= 3").select("doc_id", "chunk_type", "chunk_id", "n")


def query_dedupe(spark, sf_dir):
    """Queries that differ only in case and blanks, with their number and first case."""
    q = load(spark, sf_dir, "citation_audit_v1_queries")
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    return q.groupBy(key.alias("query_key")).agg(F.countDistinct("case_id").alias("n"), F.min("case_id").alias("first_case"))


def query_paper_match(spark, sf_dir):
    """Papers whose title has a name that a query asks about: an equality join on the name."""
    names = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+[A-Z0-9-][A-Za-z0-9-]*"), F.lit(0))))
    q = load(spark, sf_dir, "citation_audit_v1_queries").select("case_id", names("query").alias("name")).distinct()
    t = load(spark, sf_dir, "corpus_manifest").select("doc_id", "title").distinct().select("doc_id", names("title").alias("name")).distinct()
    return q.join(t, "name").select("case_id", "doc_id").distinct()


QUERIES = {f.__name__: f for f in (
    jsonl_roundtrip, metadata_codec, vector_store_upsert, embedding_cache_fill, ledger_append, pipeline_status, snapshot_counts, record_parity, stratified_sample,
    query_dedupe, query_paper_match)}

_NAMES = "unnest(list_distinct(regexp_extract_all({c}, '[A-Z][a-z]+[A-Z0-9-][A-Za-z0-9-]*'))) AS name"
ORACLE = {
    "jsonl_roundtrip": "SELECT section, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars, count(DISTINCT content_hash) AS n_hashes FROM corpus_manifest GROUP BY 1",
    "metadata_codec": "SELECT DISTINCT hit_id, array_to_string(heading_path, '>') AS path, array_to_string(content_types, ',') AS types FROM retrieval_hits",
    "vector_store_upsert": """SELECT CAST(label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS INTEGER) AS label, count(*) AS n, min(vec_id) AS first_id FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY 1""",
    "embedding_cache_fill": """WITH h AS (SELECT chunk_id, max(text) AS text FROM retrieval_hits WHERE text IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n_rows, count(DISTINCT text) AS n_keys, count(DISTINCT text) FILTER (WHERE text NOT IN (SELECT text FROM h WHERE ends_with(chunk_id, '_00001'))) AS n_computed FROM h""",
    "ledger_append": f"""WITH c AS (SELECT DISTINCT claim_id, support_level FROM audited_claims), r AS (SELECT DISTINCT claim_id, chunk_id FROM (SELECT claim_id, {_norm('raw')} AS chunk_id FROM
        (SELECT claim_id, unnest(candidate_chunk_ids) AS raw FROM audited_claims)) WHERE chunk_id IN (SELECT {_norm('chunk_id')} FROM corpus_manifest)),
        n AS (SELECT claim_id, count(*) AS n FROM r GROUP BY 1) SELECT c.claim_id, support_level, coalesce(n, 0) AS n_refs, substr(sha256(concat_ws('|', c.claim_id, support_level)), 1, 16) AS ledger_id
        FROM c LEFT JOIN n ON c.claim_id = n.claim_id WHERE coalesce(n, 0) > 0 OR support_level = 'unsupported'""",
    "pipeline_status": """WITH c AS (SELECT case_id, max(answer) AS answer FROM citation_audit_v1_queries GROUP BY 1), h AS (SELECT DISTINCT query_id FROM retrieval_hits WHERE fusion_rank <= 10),
        v AS (SELECT case_id, support_level FROM (SELECT DISTINCT case_id, result_id, judged_at, support_level FROM evidence_sufficiency) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY judged_at DESC NULLS LAST, result_id DESC) = 1),
        a AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE support_level = 'supported') AS s FROM (SELECT DISTINCT claim_id, case_id, support_level FROM audited_claims) GROUP BY 1)
        SELECT c.case_id, CASE WHEN h.query_id IS NULL THEN 'failed' WHEN NOT coalesce(v.support_level = 'strong', FALSE) THEN 'rejected' WHEN regexp_replace(coalesce(answer, ''), '[^\\p{L}\\p{N}]+', '', 'g') = '' THEN 'evidence_sufficient'
        WHEN a.n IS NULL THEN 'answered' WHEN a.n = a.s THEN 'grounded' ELSE 'needs_review' END AS status FROM c LEFT JOIN h ON c.case_id = h.query_id LEFT JOIN v ON c.case_id = v.case_id LEFT JOIN a ON c.case_id = a.case_id""",
    "snapshot_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) FILTER (WHERE loaded_at < TIMESTAMP '{MOMENT}') AS before, count(*) FILTER (WHERE loaded_at >= TIMESTAMP '{MOMENT}') AS after FROM {t}" for t in (
        "citation_audit_v1_queries", "evidence_sufficiency", "audited_claims", "corpus_manifest", "retrieval_hits", "documents")),
    "record_parity": """WITH h AS (SELECT chunk_id, max(section) AS s1, max(chunk_type) AS t1, max(doc_id) AS d1, max(text) AS x1 FROM retrieval_hits GROUP BY 1),
        m AS (SELECT chunk_id, max(section) AS s2, max(chunk_type) AS t2, max(doc_id) AS d2, max(content_hash) AS x2 FROM corpus_manifest GROUP BY 1),
        j AS (SELECT h.chunk_id AS a, m.chunk_id AS b, * FROM h FULL OUTER JOIN m ON h.chunk_id = m.chunk_id)
        SELECT count(*) AS n, count(*) FILTER (WHERE b IS NULL) AS only_hits, count(*) FILTER (WHERE a IS NULL) AS only_manifest,
        count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND s1 IS DISTINCT FROM s2) AS other_section, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND t1 IS DISTINCT FROM t2) AS other_type,
        count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND d1 IS DISTINCT FROM d2) AS other_paper, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND sha256(x1) = x2) AS same_hash FROM j""",
    "stratified_sample": """SELECT doc_id, chunk_type, chunk_id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_type ORDER BY md5(chunk_id), chunk_id) AS n
        FROM (SELECT DISTINCT doc_id, chunk_type, chunk_id FROM corpus_manifest)) WHERE n <= 3""",
    "query_dedupe": "SELECT lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS query_key, count(DISTINCT case_id) AS n, min(case_id) AS first_case FROM citation_audit_v1_queries GROUP BY 1",
    "query_paper_match": f"""WITH q AS (SELECT DISTINCT case_id, {_NAMES.format(c='query')} FROM citation_audit_v1_queries), t AS (SELECT DISTINCT doc_id, {_NAMES.format(c='title')} FROM (SELECT DISTINCT doc_id, title FROM corpus_manifest))
        SELECT DISTINCT case_id, doc_id FROM q JOIN t USING (name)""",
}
