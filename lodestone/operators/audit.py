"""Lexical audit of claims against evidence, and the evidence gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NEGATIONS, audit_tokens, claim_numbers, dice, overlap_ratio, plain_tokens

# The thresholds of the verdicts, and words of opposite direction.
SUPPORTED, PARTIAL, RELATED_NUMBER, RELATED, FLIPPED, ALIGNED = 0.18, 0.10, 0.20, 0.14, 0.35, 0.55
OPPOSED = (
    (("with recurrence", "recurrent"), ("without recurrence", "no recurrence")),
    (("improves", "outperforms", "better", "higher"), ("worse", "lower", "decreases", "underperforms")),
    (("supports", "confirms", "enables"), ("does not support", "fails", "cannot", "unable")),
    (("increases", "higher", "more"), ("decreases", "lower", "less", "fewer")),
)


def overlaps(claims: DataFrame, evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """claim_id, chunk_id, score, any_number, same_number and flipped of every given pair.

    ``claims``: claim_id, text; ``evidence``: chunk_id, text; ``pairs``: claim_id,
    chunk_id.  score is the share of the claim's tokens the evidence has; any_number,
    whether the evidence states a number, same_number, one of the claim's; flipped,
    whether one of them is negated and they use words of opposite direction.  Tokens,
    numbers and words are taken once per text, before the pairs are joined, and no
    text goes along with a pair."""
    def facts(text: str, p: str) -> list[Column]:
        words = audit_tokens(F.col(text))
        sides = F.array(*[_uses(F.col(text), side) for pair in OPPOSED for side in pair])
        return [words.alias(f"{p}t"), claim_numbers(F.col(text)).alias(f"{p}n"), F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS))).alias(f"{p}x"), sides.alias(f"{p}o")]

    c, e = claims.select("claim_id", *facts("text", "c")), evidence.select("chunk_id", *facts("text", "e"))
    opposed = F.lit(False)
    for k in range(0, 2 * len(OPPOSED), 2):
        opposed = opposed | (F.col("co")[k] & F.col("eo")[k + 1]) | (F.col("co")[k + 1] & F.col("eo")[k])
    return pairs.join(c, "claim_id").join(e, "chunk_id").select(
        "claim_id", "chunk_id", F.round(overlap_ratio(F.col("ct"), F.col("et")), 6).alias("score"), (F.size("en") > 0).alias("any_number"),
        F.arrays_overlap("en", "cn").alias("same_number"), ((F.col("cx") != F.col("ex")) & opposed).alias("flipped"))


def _uses(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)), F.lit(False))


def verdicts(claims: DataFrame, scored: DataFrame) -> DataFrame:
    """claim_id, best_score, verdict, evidence (up to three tied best ids).  Claims
    without any evidence stay, as unsupported."""
    w = Window.partitionBy("claim_id")
    best = scored.where("score > 0").select("claim_id", "chunk_id", "score", F.max("score").over(w).alias("best")).where("score = best").groupBy("claim_id").agg(
        F.max("best").alias("best"), F.array_join(F.slice(F.array_sort(F.collect_list("chunk_id")), 1, 3), ",").alias("evidence"))
    s = F.coalesce("best", F.lit(0.0))
    return claims.select("claim_id").join(best, "claim_id", "left").select(
        "claim_id", s.alias("best_score"), F.when(s >= SUPPORTED, "supported").when(s >= PARTIAL, "partial").otherwise("unsupported").alias("verdict"),
        F.coalesce("evidence", F.lit("")).alias("evidence"))


def numeric_consistency(claims: DataFrame, scored: DataFrame) -> DataFrame:
    """claim_id and status: one matching number in related evidence is enough."""
    own = claims.select("claim_id", claim_numbers(F.col("text")).alias("own"))
    seen = scored.where(F.col("score") >= RELATED_NUMBER).groupBy("claim_id").agg(F.max("any_number").alias("any_number"), F.max("same_number").alias("hit"))
    return own.join(seen, "claim_id", "left").select("claim_id", F.when(F.size("own") == 0, "not_applicable").when(F.col("hit"), "consistent").when(
        F.col("any_number"), "numerical_error").otherwise("uncertain").alias("status"))


def polarity(claims: DataFrame, scored: DataFrame) -> DataFrame:
    """claim_id and status: contradiction, consistent or uncertain."""
    seen = scored.where(F.col("score") >= RELATED).groupBy("claim_id").agg(F.max(F.col("flipped") & (F.col("score") >= FLIPPED)).alias("flip"))
    return claims.select("claim_id").join(seen, "claim_id", "left").select(
        "claim_id", F.when(F.col("flip").isNull(), "uncertain").when(F.col("flip"), "contradiction").otherwise("consistent").alias("status"))


def align(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of expected and found claims within a case, best
    Dice similarity first, at least 0.55.  ``expected``: case_id, exp_no, text;
    ``found``: case_id, claim_id, text.  Only claims that share a token are paired."""
    e = expected.select("case_id", "exp_no", plain_tokens(F.col("text")).alias("et"))
    f = found.select("case_id", "claim_id", plain_tokens(F.col("text")).alias("ft"))
    scored = e.join(f, "case_id").withColumn("score", F.round(dice(F.col("et"), F.col("ft")), 6)).where(F.col("score") >= ALIGNED).select(
        "case_id", "exp_no", "claim_id", "score")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        taken_e, taken_f, keep = set(), set(), []
        for r in rows.sort_values(["score", "exp_no", "claim_id"], ascending=[False, True, True]).itertuples():
            if r.exp_no not in taken_e and r.claim_id not in taken_f:
                taken_e.add(r.exp_no)
                taken_f.add(r.claim_id)
                keep.append(r.Index)
        return rows.loc[keep]

    return scored.groupBy("case_id").applyInPandas(pick, scored.schema)


def best_alignment(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The most similar found claim of every expected claim of its case (Dice; ties: the smallest id)."""
    e = expected.select("case_id", "exp_no", plain_tokens(F.col("text")).alias("et"))
    f = found.select("case_id", "claim_id", plain_tokens(F.col("text")).alias("ft"))
    w = Window.partitionBy("case_id", "exp_no").orderBy(F.desc("score"), "claim_id")
    return e.join(f, "case_id").select("case_id", "exp_no", "claim_id", F.round(dice(F.col("et"), F.col("ft")), 6).alias("score")).withColumn(
        "n", F.row_number().over(w)).where("n = 1").drop("n")


def gate(judged: DataFrame, known_ids: DataFrame) -> DataFrame:
    """result_id, decision and reason; whatever is wrong with a judgement rejects it.

    ``judged``: result_id, support_level, confidence, answerable, ids (unified chunk
    ids); ``known_ids``: chunk_id.  Reasons, first one wins: unknown_level,
    bad_confidence, foreign_evidence, no_evidence, level_mismatch, not_strong."""
    foreign = judged.select("result_id", F.explode("ids").alias("chunk_id")).join(known_ids, "chunk_id", "left_anti").select("result_id").distinct().withColumn("foreign", F.lit(1))
    c, level = F.col("confidence"), F.col("support_level")
    reason = (
        F.when(~F.coalesce(level.isin("strong", "partial", "unsupported"), F.lit(False)), "unknown_level")
        .when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "bad_confidence")
        .when(F.col("foreign").isNotNull(), "foreign_evidence")
        .when((level != "unsupported") & (F.coalesce(F.size("ids"), F.lit(0)) == 0), "no_evidence")
        .when((level == "strong") & ~F.coalesce("answerable", F.lit(False)), "level_mismatch")
        .when(level != "strong", "not_strong").otherwise("")
    )
    return judged.join(foreign, "result_id", "left").select("result_id", reason.alias("reason")).withColumn("decision", F.when(F.col("reason") == "", "accept").otherwise("reject"))


def judge_with(texts: DataFrame, backend, schema: str) -> DataFrame:
    """Run a model backend over (id, question, passage) rows in Arrow batches.

    ``backend()`` is called once per task and returns a function from two series of
    strings to a frame with the columns of ``schema``; the default backend is a
    lexical one (:func:`lexical_backend`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            out = model(batch["question"], batch["passage"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return texts.select("id", "question", "passage").mapInPandas(run, "id string, " + schema)


def lexical_backend():
    """Deterministic stand-in of a reranker or judge: share of question words in the passage."""
    import re

    def score(questions: pd.Series, passages: pd.Series) -> pd.DataFrame:
        words = lambda t: set(re.findall(r"[a-z0-9]{2,}", (t or "").lower()))
        return pd.DataFrame({"score": [round(len(words(q) & words(p)) / max(1, len(words(q))), 6) for q, p in zip(questions, passages)]})

    return score
