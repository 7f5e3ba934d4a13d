"""Analysis of run and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of task classes, first match wins.
TASKS = (
    ("claim_audit", r"(?i)\b(audit|verify|validate|check|fact-check)\b.{0,40}\b(claim|statement|assertion)\b"),
    ("comparison", r"(?i)\b(compare|comparison|contrast|difference|different|versus|vs\.?|distinguish)\b"),
    ("literature_review", r"(?i)^\s*(review|survey|synthesize)\b|\b(literature|research)\s+(review|survey|synthesis)\b"),
    ("answer_audit", r"(?i)\b(audit|verify|validate|check)\b.{0,32}\b(citation|claim|answer|response)\b"),
    ("literature_search", r"(?i)\b(find|search|discover|identify|locate|recommend)\b.{0,48}\b(papers?|literature|articles?|publications?|preprints?)\b"),
)


def task_class(query: Column) -> Column:
    out = F.lit("qa")
    for name, pattern in reversed(TASKS):
        out = F.when(F.coalesce(query.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def failure_class(status: Column, reason: Column, has_evidence: Column) -> Column:
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(F.contains(r, F.lit("insufficient")), "insufficient_evidence").when(F.contains(r, F.lit("tool")) | F.contains(r, F.lit("timeout")), "tool_failure").when(
        status == "rejected", F.when(has_evidence, "rejected_answer").otherwise("no_evidence")).otherwise("execution_failure")


def repeats(rows: DataFrame, run: str, signature: list[str], order: list[str]) -> DataFrame:
    """Rows whose signature occurred before in the same run."""
    w = Window.partitionBy(run, *signature).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def keyword_score(words: list[str], text: Column) -> Column:
    """Number of the words that the text contains."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum(F.contains(t, F.lit(w.lower())).cast("int") for w in words)
