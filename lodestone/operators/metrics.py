"""Relevance, classification and audit metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .references import normal_id

MODES = ("dense", "sparse", "fusion", "rerank")


def ranked_modes(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, mode, rank: one row per stored rank of a hit."""
    pairs = [x for m in MODES for x in (F.lit(m), F.col(f"{m}_rank"))]
    return hits.select("query_id", normal_id(F.col("chunk_id")).alias("chunk_id"), F.explode(F.create_map(*pairs)).alias("mode", "rank")).where(
        F.col("rank").isNotNull()).groupBy("query_id", "chunk_id", "mode").agg(F.min("rank").alias("rank"))


def ids_of(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """key, chunk_id: the different ids of an array column, spellings unified; null and blank ones left out."""
    return rows.select(key, F.explode(ids).alias("raw")).select(key, normal_id(F.col("raw")).alias("chunk_id")).where(
        F.col("chunk_id").isNotNull()).distinct()


def judgements(cases: DataFrame) -> DataFrame:
    """query_id, chunk_id of the evidence of each case, spellings unified."""
    return ids_of(cases, "case_id", "evidence_chunk_ids").withColumnRenamed("case_id", "query_id")


def relevance(ranks: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per answerable query and mode: n_relevant, first relevant rank, DCG parts at ten, hits at 1, 3, 5, 10."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    every = n.select("query_id", "n_relevant", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    hit = ranks.join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "mode").agg(
        F.min("rank").alias("first_rank"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in (1, 3, 5, 10)])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return every.join(hit, ["query_id", "mode"], "left").select(
        "query_id", "mode", "n_relevant", "first_rank", *[F.coalesce(f"hits_{k}", F.lit(0)).alias(f"hits_{k}") for k in (1, 3, 5, 10)],
        F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(0.0).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def ratio(a, b) -> F.Column:
    """a / b, 0 where b is 0; six digits."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and false positive rate of two boolean columns."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("prec"),
                    ratio(tp, tp + fn).alias("rec"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def per_class(pairs: DataFrame, expected: str, predicted: str) -> DataFrame:
    """label, n_expected, n_predicted, precision and recall per class."""
    e = pairs.groupBy(F.col(expected).alias("label")).agg(F.count("*").alias("n_expected"))
    p = pairs.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("n_predicted"))
    both = pairs.where(F.col(expected) == F.col(predicted)).groupBy(F.col(expected).alias("label")).agg(F.count("*").alias("hit"))
    j = e.join(p, "label", "full_outer").join(both, "label", "left")
    hit, ne, np_ = (F.coalesce(x, F.lit(0)) for x in ("hit", "n_expected", "n_predicted"))
    return j.select("label", ne.alias("n_expected"), np_.alias("n_predicted"), ratio(hit, np_).alias("prec"), ratio(hit, ne).alias("rec"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order`` (nulls come before everything).  An
    aggregate, so that a key with very many rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
