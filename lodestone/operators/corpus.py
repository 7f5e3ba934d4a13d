"""Chunks, postings, corpus statistics and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens

_FIELDS = ("doc_id", "title", "section", "section_heading", "chunk_type", "page_start", "page_end", "text",
           "has_equation", "has_table", "has_caption")


def chunks(hits: DataFrame) -> DataFrame:
    """One row per chunk of the hits.  A field missing in one hit comes from another."""
    return hits.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in _FIELDS])


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf."""
    return texts.select(key, F.explode(bm25_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_stats(post: DataFrame, key: str) -> DataFrame:
    """key, dl (tokens), terms (different ones)."""
    return post.groupBy(key).agg(F.sum("tf").alias("dl"), F.count("*").alias("terms"))


def term_stats(post: DataFrame) -> DataFrame:
    """term, df, cf."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def content_hash(text: Column) -> Column:
    """Hash of the canonical JSON of a text."""
    return F.sha2(F.to_json(F.struct(text.alias("text")), {"ignoreNullFields": "false"}), 256)


def summary(manifest: DataFrame) -> DataFrame:
    """Counts over all grouping sets of section and chunk type (null = all)."""
    return manifest.groupingSets([["section", "chunk_type"], ["section"], ["chunk_type"], []], "section", "chunk_type").agg(
        F.count("*").alias("n"), F.sum("char_count").alias("chars"), F.sum("word_count").alias("words"),
        F.count_if(F.col("page_start").isNull()).alias("no_page"), F.grouping_id().cast("int").alias("gid"))


def living_at(manifest: DataFrame, moment: str) -> DataFrame:
    """Manifest rows that live at ``moment``: chunk_id, content_hash, metadata."""
    m = F.lit(moment).cast("timestamp_ntz")
    return manifest.where((F.col("ingested_at") <= m) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > m))).groupBy("chunk_id").agg(
        F.max("content_hash").alias("content_hash"), F.max("schema_version").alias("metadata"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """chunk_id and change: added, removed, updated, metadata_changed or reused."""
    b = before.select("chunk_id", F.lit(1).alias("was"), F.col("content_hash").alias("h0"), F.col("metadata").alias("m0"))
    a = after.select("chunk_id", F.lit(1).alias("is"), F.col("content_hash").alias("h1"), F.col("metadata").alias("m1"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(
        ~F.col("h0").eqNullSafe(F.col("h1")), "updated").when(~F.col("m0").eqNullSafe(F.col("m1")), "metadata_changed").otherwise("reused")
    return b.join(a, "chunk_id", "full_outer").select("chunk_id", change.alias("change"))


def sync_plan(diff: DataFrame, most_stale: float = 0.1) -> DataFrame:
    """Counts per change and whether the share of removals allows a sync."""
    return diff.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "updated", "metadata_changed", "reused")],
                    (F.coalesce(F.try_divide(F.count_if(F.col("change") == "removed").cast("double"), F.count_if(F.col("change") != "added").cast("double")), F.lit(0.0))
                     <= most_stale).alias("allowed"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Each key that has to be computed once, with the number of rows it serves."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_rows"))
