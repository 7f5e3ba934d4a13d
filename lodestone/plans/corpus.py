"""Queries on chunks, postings and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..tables import load

BEFORE, AFTER = "2025-03-01", "2025-06-01"

CH = ("ch AS (SELECT chunk_id, " + ", ".join(f"max({c}) AS {c}" for c in C._FIELDS) + " FROM retrieval_hits WHERE chunk_id IS NOT NULL GROUP BY chunk_id)")
TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_.+-]*|[0-9]+(?:\\.[0-9]+)*|[A-Za-z0-9]+'), lambda x: lower(x))"
POST = f"post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS}) AS term FROM ch) GROUP BY 1, 2)"


def chunk_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.postings(C.chunks(load(spark, sf_dir, "retrieval_hits")), "chunk_id")


def bm25_postings(spark, sf_dir):
    return chunk_postings(spark, sf_dir)


def bm25_term_stats(spark, sf_dir):
    return C.term_stats(chunk_postings(spark, sf_dir))


def bm25_doc_stats(spark, sf_dir):
    return C.doc_stats(chunk_postings(spark, sf_dir), "chunk_id")


def document_term_stats(spark, sf_dir):
    return C.term_stats(C.postings(load(spark, sf_dir, "documents"), "doc_id"))


def corpus_summary(spark, sf_dir):
    m = load(spark, sf_dir, "corpus_manifest")
    return m.agg(
        F.count("*").alias("n_rows"), F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("doc_id").alias("n_papers"),
        F.countDistinct("content_hash").alias("n_hashes"), F.sum("char_count").alias("chars"), F.sum("word_count").alias("words"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.count_if(F.col("page_start").isNull()).alias("n_no_page"))


def section_distribution_grouping_sets(spark, sf_dir):
    return C.summary(load(spark, sf_dir, "corpus_manifest"))


def content_hash_duplicates(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def corpus_fingerprint(spark, sf_dir):
    """Order-free fingerprint per paper: the sum of 48 bits of the hash of every chunk."""
    m = load(spark, sf_dir, "corpus_manifest").select("doc_id", "chunk_id", "content_hash").distinct()
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(
        F.conv(F.substring(F.md5(F.concat_ws(":", "chunk_id", "content_hash")), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def manifest_diff(spark, sf_dir):
    m = load(spark, sf_dir, "corpus_manifest")
    return C.manifest_diff(C.living_at(m, BEFORE), C.living_at(m, AFTER))


def manifest_sync_plan(spark, sf_dir):
    return C.sync_plan(manifest_diff(spark, sf_dir))


def cache_miss_plan(spark, sf_dir):
    m = load(spark, sf_dir, "corpus_manifest")
    done = C.living_at(m, BEFORE)
    return C.cache_misses(m.select("chunk_id", "content_hash").distinct(), done, "content_hash")


def id_integrity_checks(spark, sf_dir):
    """Index health counters over manifest and hits."""
    m = load(spark, sf_dir, "corpus_manifest")
    hits = load(spark, sf_dir, "retrieval_hits").select("chunk_id").distinct()
    known = m.select("chunk_id").distinct()
    counts = m.agg(F.count_if(F.col("chunk_id").isNull()).alias("v"))
    rows = [("null_chunk_ids", counts), ("hits_without_manifest", hits.join(known, "chunk_id", "left_anti").agg(F.count("*").alias("v"))),
            ("chunks_never_hit", known.join(hits, "chunk_id", "left_anti").agg(F.count("*").alias("v"))),
            ("inverted_pages", m.agg(F.count_if(F.col("page_end") < F.col("page_start")).alias("v"))),
            ("ends_before_start", m.agg(F.count_if(F.col("deleted_at") <= F.col("ingested_at")).alias("v")))]
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("counter"), F.col("v").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def vector_health(spark, sf_dir):
    from ..functions.vectors import is_finite, norm

    e = load(spark, sf_dir, "embeddings").withColumn("norm", norm(F.col("embedding")))
    return e.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(~is_finite(F.col("embedding"))).alias("n_not_finite"), F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.count_if(F.abs(F.col("norm") - 1) > 1e-3).alias("n_norm_drift"), F.max(F.size("embedding")).alias("dims"))


QUERIES = {f.__name__: f for f in (
    bm25_postings, bm25_term_stats, bm25_doc_stats, document_term_stats, corpus_summary, section_distribution_grouping_sets, content_hash_duplicates,
    corpus_fingerprint, manifest_diff, manifest_sync_plan, cache_miss_plan, id_integrity_checks, vector_health)}


def _living(moment: str) -> str:
    return f"""(SELECT chunk_id, max(content_hash) AS content_hash, max(schema_version) AS metadata FROM corpus_manifest
        WHERE ingested_at <= TIMESTAMP '{moment}' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '{moment}') GROUP BY chunk_id)"""


_DIFF = f"""SELECT coalesce(b.chunk_id, a.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'added' WHEN a.chunk_id IS NULL THEN 'removed'
    WHEN b.content_hash IS DISTINCT FROM a.content_hash THEN 'updated' WHEN b.metadata IS DISTINCT FROM a.metadata THEN 'metadata_changed' ELSE 'reused' END AS change
    FROM {_living(BEFORE)} b FULL OUTER JOIN {_living(AFTER)} a ON b.chunk_id = a.chunk_id"""
ORACLE = {
    "bm25_postings": f"WITH {CH}, {POST} SELECT * FROM post",
    "bm25_term_stats": f"WITH {CH}, {POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "bm25_doc_stats": f"WITH {CH}, {POST} SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS dl, count(*) AS terms FROM post GROUP BY chunk_id",
    "document_term_stats": f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2)
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term""",
    "corpus_summary": """SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_papers, count(DISTINCT content_hash) AS n_hashes,
        CAST(sum(char_count) AS BIGINT) AS chars, CAST(sum(word_count) AS BIGINT) AS words, count(deleted_at) AS n_deleted,
        count(*) FILTER (WHERE page_start IS NULL) AS n_no_page FROM corpus_manifest""",
    "section_distribution_grouping_sets": """SELECT section, chunk_type, count(*) AS n, CAST(sum(char_count) AS BIGINT) AS chars, CAST(sum(word_count) AS BIGINT) AS words,
        count(*) FILTER (WHERE page_start IS NULL) AS no_page, CAST(grouping(section, chunk_type) AS INTEGER) AS gid
        FROM corpus_manifest GROUP BY GROUPING SETS ((section, chunk_type), (section), (chunk_type), ())""",
    "content_hash_duplicates": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "corpus_fingerprint": """SELECT doc_id, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(k), 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint FROM
        (SELECT DISTINCT doc_id, concat_ws(':', chunk_id, content_hash) AS k, chunk_id, content_hash FROM corpus_manifest) GROUP BY doc_id""",
    "manifest_diff": _DIFF,
    "manifest_sync_plan": f"""SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
        count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'metadata_changed') AS metadata_changed,
        count(*) FILTER (WHERE change = 'reused') AS reused,
        coalesce(count(*) FILTER (WHERE change = 'removed') / nullif(count(*) FILTER (WHERE change <> 'added'), 0), 0) <= 0.1 AS allowed FROM ({_DIFF})""",
    "cache_miss_plan": f"""SELECT content_hash, count(*) AS n_rows FROM (SELECT DISTINCT chunk_id, content_hash FROM corpus_manifest)
        WHERE content_hash NOT IN (SELECT content_hash FROM {_living(BEFORE)}) GROUP BY content_hash""",
    "id_integrity_checks": """WITH k AS (SELECT DISTINCT chunk_id FROM corpus_manifest), h AS (SELECT DISTINCT chunk_id FROM retrieval_hits)
        SELECT 'null_chunk_ids' AS counter, count(*) FILTER (WHERE chunk_id IS NULL) AS n FROM corpus_manifest
        UNION ALL SELECT 'hits_without_manifest', count(*) FROM h ANTI JOIN k USING (chunk_id)
        UNION ALL SELECT 'chunks_never_hit', count(*) FROM k ANTI JOIN h USING (chunk_id)
        UNION ALL SELECT 'inverted_pages', count(*) FILTER (WHERE page_end < page_start) FROM corpus_manifest
        UNION ALL SELECT 'ends_before_start', count(*) FILTER (WHERE deleted_at <= ingested_at) FROM corpus_manifest""",
    "vector_health": """WITH e AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
        SELECT label, count(*) AS n, count(*) FILTER (WHERE NOT isfinite(norm)) AS n_not_finite, count(*) FILTER (WHERE norm = 0) AS n_zero,
        count(*) FILTER (WHERE abs(norm - 1) > 1e-3) AS n_norm_drift, CAST(max(len(embedding)) AS INTEGER) AS dims FROM e GROUP BY label""",
}
