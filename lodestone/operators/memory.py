"""Run memory: the ledger of audited claims, and the pipeline's state per case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger_rows(claims: DataFrame, refs: DataFrame, known: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger rows: claims with at least one resolvable reference (unsupported
    ones need none) that the ledger does not hold yet, so appending twice is harmless.

    ``claims``: claim_id, support_level; ``refs``: claim_id, chunk_id; ``known``: chunk_id."""
    n = refs.join(known.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("claim_id").agg(F.countDistinct("chunk_id").alias("n_refs"))
    j = claims.join(n, "claim_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    return j.where((F.col("n_refs") > 0) | (F.col("support_level") == "unsupported")).join(ledger.select("claim_id"), "claim_id", "left_anti").select(
        "claim_id", "support_level", "n_refs", F.substring(F.sha2(F.concat_ws("|", "claim_id", "support_level"), 256), 1, 16).alias("ledger_id"))


def pipeline_status(cases: DataFrame, hits: DataFrame, verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """case_id and status after all stages, every case in one pass: ``failed`` (no
    hits), ``rejected`` (evidence not strong), ``evidence_sufficient`` (no answer),
    ``answered`` (no claims audited), ``grounded`` (all supported) or ``needs_review``.

    The gate is a filter: what is decided early takes no part in later stages.
    ``cases``: case_id, answer; ``hits``: case_id; ``verdicts``: case_id, support_level
    (one row a case); ``claims``: case_id, support_level."""
    c = claims.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("support_level") == "supported").alias("s"))
    j = cases.join(hits.select("case_id").distinct().withColumn("hit", F.lit(True)), "case_id", "left").join(
        verdicts.select("case_id", "support_level"), "case_id", "left").join(c, "case_id", "left")
    said = F.regexp_replace(F.coalesce("answer", F.lit("")), r"[^\p{L}\p{N}]+", "") != ""
    status = F.when(F.col("hit").isNull(), "failed").when(~F.coalesce(F.col("support_level") == "strong", F.lit(False)), "rejected").when(
        ~said, "evidence_sufficient").when(F.col("n").isNull(), "answered").when(F.col("n") == F.col("s"), "grounded").otherwise("needs_review")
    return j.select("case_id", status.alias("status"))
