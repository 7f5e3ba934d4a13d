"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..tables import load
from . import leakage, mixing, near_duplicates, page_noise, pairs, reading_level, splitting
from .text import chunk_texts, language_profiles, source_key


def _near(spark: SparkSession, sf_dir: str):
    hits = load(spark, sf_dir, "retrieval_hits")
    return near_duplicates.near_duplicates(hits.select(F.col("chunk_id").alias("id"), "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_ = near_duplicates.all_pairs(*_near(spark, sf_dir))
    return pairs_.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(*_near(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the cases, and claims with the query of their case."""
    cases = load(spark, sf_dir, "citation_audit_v1_queries")
    claims = load(spark, sf_dir, "audited_claims").select("claim_id", "case_id", "text").dropDuplicates()
    asked = cases.groupBy("case_id").agg(F.max("query").alias("query"))
    return cases.select(F.lit("case").alias("record_kind"), F.col("case_id").alias("record_id"), "query", "answer").unionByName(
        claims.join(asked, "case_id", "left").select(
            F.lit("claim").alias("record_kind"), F.col("claim_id").alias("record_id"), "query", F.col("text").alias("answer")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(pair_records(spark, sf_dir), language_profiles(load(spark, sf_dir, "documents")))


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("record_kind", "defect").agg(F.count("*").alias("n_records"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk; these tables name paper and author in the chunk id only."""
    chunks = chunk_texts(load(spark, sf_dir, "retrieval_hits"), "title")
    return chunks.withColumns({"paper": F.regexp_replace("chunk_id", r"_[^_]*_?\d*$", ""), "author": F.regexp_extract("chunk_id", r"^[^_]*_([^_]+)", 1)})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise.find_noise(_pages(spark, sf_dir))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise.repair(_pages(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = load(spark, sf_dir, "retrieval_hits")
    return splitting.oversized(chunk_texts(hits.where(F.length("text") > 1600)))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_texts(load(spark, sf_dir, "retrieval_hits"), "section", "source_block_ids", "overlap_source_block_ids")
    out = splitting.pieces(chunks)
    return out.withColumns({c: F.array_join(c, ",") for c in ("source_block_ids", "overlap_source_block_ids")})


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized chunk what its pieces hold: characters but white space without the
    overlap, whether every piece keeps the limit and repeats at most 200 characters,
    whether the pieces are numbered without a gap, and the weakest cut."""
    chunks = chunk_texts(load(spark, sf_dir, "retrieval_hits").where(F.length("text") > 1600), "section", "source_block_ids", "overlap_source_block_ids")
    own = F.regexp_replace(F.substring("piece_text", F.col("overlap_chars") + 1, F.length("piece_text")), r"\s", "")
    kinds = F.array(*map(F.lit, splitting.CUTS))
    return splitting.pieces(chunks).groupBy("chunk_id").agg(
        F.sum(F.length(own)).alias("n_chars"), (F.max(F.length("piece_text")) <= 1600).alias("in_limit"), (F.max("overlap_chars") <= 200).alias("short_overlap"),
        (F.count("*") == F.max("piece_no")).alias("numbered"), kinds[F.max(F.coalesce(F.array_position(kinds, F.col("cut")), F.lit(1))).cast("int") - 1].alias("boundary"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p6_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.paraphrases(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(p6_found(spark, sf_dir), load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    counted = written(mixing.token_counts(load(spark, sf_dir, "documents")), "mix-tokens")
    targets = load(spark, sf_dir, "source_targets")
    return mixing.mix(counted, targets), counted, targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _, targets = _mixed(spark, sf_dir)
    return mixing.shares(chosen, targets)


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, counted, targets = _mixed(spark, sf_dir)
    return mixing.margins(written(chosen, "mix-chosen"), counted, targets)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return reading_level.levels(docs, reading_level.fit(docs, load(spark, sf_dir, "level_labels")), reading_level.fit_languages(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "band")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.profile(p8_found(spark, sf_dir), load(spark, sf_dir, "documents"), source_key(F.col("source")))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_summary": p3_summary, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_check": p5_check, "p6_found": p6_found, "p6_report": p6_report, "p6_paraphrases": p6_paraphrases, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_margins": p7_margins, "p8_found": p8_found, "p8_profile": p8_profile}

_P5 = r"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM retrieval_hits WHERE length(text) > 1600 AND chunk_id IS NOT NULL),
par AS (SELECT chunk_id, text, list_max(list_transform(regexp_split_to_array(text, '\n[^\S\n]*\n\s*'), lambda p: length(trim(p)))) AS p,
  list_max(list_transform(regexp_split_to_array(
    regexp_replace(regexp_replace(regexp_replace(text, '\n[^\S\n]*\n\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'),
    chr(1)), lambda p: length(trim(p)))) AS s,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda p: length(p))) AS w FROM c),
found AS (SELECT chunk_id, text, CASE WHEN p <= 1600 THEN 'paragraph' WHEN s <= 1600 THEN 'sentence' WHEN w <= 1600 THEN 'word' ELSE 'none' END AS boundary FROM par)
"""

ORACLE = {
    "p2_found": r"""
WITH c AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM retrieval_hits WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 20)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS k FROM s a JOIN s b ON a.r = b.r AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM p JOIN n u ON x = u.chunk_id JOIN n v ON y = v.chunk_id WHERE 2 * k >= u.n + v.n - k
""",
    "p2_classes": r"""
WITH m AS (SELECT DISTINCT chunk_id, text FROM retrieval_hits WHERE text IS NOT NULL AND chunk_id IS NOT NULL AND len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 20),
t AS (SELECT text, min(chunk_id) AS class_id, count(*) AS n_copies, row_number() OVER (ORDER BY text) AS k FROM m GROUP BY 1),
c AS (SELECT k, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
s AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.r = b.r AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON x = u.k JOIN n v ON y = v.k WHERE 2 * c >= u.n + v.n - c),
e AS (SELECT k, count(*) AS n_links FROM (SELECT x AS k FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
SELECT chunk_id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM m JOIN t ON m.text = t.text LEFT JOIN e ON t.k = e.k
""",
    "p5_found": _P5 + "SELECT chunk_id, boundary FROM found",
    "p5_check": _P5 + r"""SELECT chunk_id, length(regexp_replace(text, '\s', '', 'g')) AS n_chars, true AS in_limit, true AS short_overlap, true AS numbered, boundary FROM found""",
}
