"""A stored sparse index: built once, checked when it is loaded, searched many times."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens

VERSION = "sparse-index-2"


@dataclass(frozen=True)
class SparseIndex:
    """texts: one row per text with key, dl (tokens), terms (different ones) and tfs (their
    frequencies), so that a task scores a text whole; terms: term, df (texts with the term);
    stats: one row with key_name, n (texts with a token), avgdl and version."""

    key: str
    texts: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """The same as rows: term, key, tf, df, dl."""
        rows = self.texts.select(self.key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return rows.select(F.col("p.terms").alias("term"), self.key, F.col("p.tfs").alias("tf"), "dl").join(self.terms, "term").select("term", self.key, "tf", "df", "dl")


def _stats(lengths: DataFrame, key: str) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl")).select(
        F.lit(key).alias("key_name"), "n", F.coalesce("avgdl", F.lit(1.0)).alias("avgdl"), F.lit(VERSION).alias("version"))


def of_postings(post: DataFrame, key: str) -> SparseIndex:
    """The index of a table of (key, term, tf)."""
    texts = post.groupBy(key).agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("p")).select(
        key, "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
    return SparseIndex(key, texts, post.groupBy("term").agg(F.count("*").alias("df")), _stats(post.groupBy(key).agg(F.sum("tf").alias("dl")), key))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and tokens (joined by blanks) to key, dl, terms, tfs."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = pc.split_pattern(batch.column(1), " ")
        dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        n = max(len(tokens.dictionary), 1)
        pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + tokens.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(pairs, np.arange(len(dl) + 1) * n), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl), pa.ListArray.from_arrays(ends, tokens.dictionary.take(pa.array(pairs % n))),
                                          pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=[batch.schema.names[0], "dl", "terms", "tfs"])


def build(texts: DataFrame, key: str, path: str, text: str = "text") -> None:
    """Index ``texts`` (key, text) and store it under ``path``, replacing what is there.
    Texts without a token, and null keys, are not in it; rows of one key are one text.
    The texts are shuffled once, by key (not at all where they come so); their tokens never."""
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    whole = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.collect_list(text), " ").alias("text"))
    tokens = whole.select(key, F.array_join(bm25_tokens(F.col("text")), " ").alias("tokens")).where("tokens <> ''")
    tokens.mapInArrow(_counted, f"`{key}` {kind}, dl long, terms array<string>, tfs array<int>").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    _stats(stored, key).write.mode("overwrite").parquet(f"{path}/stats")


def _agreed(c: F.Column) -> F.Column:
    """The value that all rows of a group have, null where they differ."""
    return F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*")), F.min(c))


def load(spark: SparkSession, path: str, key: str, strict: bool = False) -> SparseIndex:
    """The index stored under ``path``; with ``strict`` the counters of :func:`faults` are
    taken first and an index with any fault is refused with a ValueError.  The postings may
    also lie there as rows (:attr:`SparseIndex.postings`); dl and df are null where they differ."""
    post, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    if "term" in post.columns:
        texts = post.groupBy(key).agg(_agreed(F.col("dl")).alias("dl"), F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("p")).select(
            key, "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
        index = SparseIndex(key, texts, post.groupBy("term").agg(_agreed(F.col("df")).alias("df")), stats)
    else:
        index = SparseIndex(key, post, spark.read.parquet(f"{path}/terms"), stats)
    if strict:
        bad = {r["counter"]: r["n"] for r in faults(index).where("n > 0").collect()}  # seven rows
        if bad:
            raise ValueError(f"index {path}: {bad}")
    return index


def faults(index: SparseIndex, texts: DataFrame | None = None) -> DataFrame:
    """counter, n: seven counters, all 0 in a sound index.  ``texts`` (key) are those it should
    hold.  Each text is checked in its row; only keys and terms are grouped."""
    t, key = index.texts, index.key
    keys = t.groupBy(key).agg(F.count("*").alias("c"))
    if not keys.where("c > 1").isEmpty():  # a text in two rows: checked as one
        t = t.groupBy(key).agg(_agreed(F.col("dl")).alias("dl"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("tfs")).alias("tfs"))
    different = F.array_distinct("terms")
    often = F.size(F.filter(different, lambda x: F.size(F.filter("terms", lambda y: y.eqNullSafe(x))) > 1))
    rows = t.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(name) for name, c in (
        ("null_keys_or_terms", F.when(F.col(key).isNull(), F.size("terms")).otherwise(F.size(F.filter("terms", lambda x: x.isNull())))),
        ("bad_frequencies", F.size(F.filter("tfs", lambda x: x.isNull() | (x < 1))) + F.abs(F.size("terms") - F.size("tfs"))),
        ("repeated_postings", F.when(F.size(different) < F.size("terms"), often).otherwise(0)),
        ("wrong_lengths", ~F.col("dl").cast("long").eqNullSafe(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))))])
    held = t.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"))
    said = index.terms.groupBy("term").agg(_agreed(F.col("df")).alias("df"))
    wrong = held.alias("a").join(said.alias("b"), F.col("a.term").eqNullSafe(F.col("b.term")), "full_outer").where(~F.col("c").eqNullSafe(F.col("df")))
    lost = texts.select(key).distinct().join(keys, key, "left_anti") if texts is not None else keys.where("false")
    right = index.stats.crossJoin(keys.agg(F.count("*").alias("m"))).where(F.col("n").eqNullSafe(F.col("m")) & (F.col("version") == VERSION) & (F.col("key_name") == key))
    out = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in rows.columns])).alias("r")).select("r.*")
    for name, n in (("wrong_document_frequencies", wrong.agg(F.count("*").alias("n"))), ("texts_not_indexed", lost.agg(F.count("*").alias("n"))),
                    ("wrong_statistics", right.agg((F.lit(1) - F.count("*")).alias("n")))):  # one sound row of one
        out = out.unionByName(n.select(F.lit(name).alias("counter"), "n"))
    return out
