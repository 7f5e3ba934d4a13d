"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked to the target
share of every source and to the corpus's own shares of languages and topics: a
table of cells on which every step sums one margin and joins its factors back,
until the weights stand still.  Each document then gets the calibrated weight of
its cell, and a systematic sample with these weights decides how often it is used.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import source_key

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern of the byte-level vocabulary (a fixed value of that tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LANGUAGES = ("en", "de", "fr", "es", "zh")
#: Documents of a bucket of the sampling walk, about; ranges in which the buckets of a source and size are added up.
_BUCKET, _RANGES = 10_000, 64
MARGINS = ("lang_name", "topic", "source_name")


def _counter(name: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source_name, lang_name, topic, tokens; texts stay where they are.
    The vocabulary file ``tokenizer`` travels with the job."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    lang = F.lower(F.trim("lang"))
    return documents.where(F.col("doc_id").isNotNull()).select(
        "doc_id", source_key(F.col("source")).alias("source_name"),
        F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("lang_name"),
        F.coalesce(F.lower(F.trim("section")), F.lit("unknown")).alias("topic"),
        _counter(os.path.basename(tokenizer))(F.col("text")).alias("tokens"),
    )


def targets_of(targets: DataFrame) -> DataFrame:
    """source_name, target_share, max_repeats: one row per source with a positive share."""
    return targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(source_key(F.col("source")).alias("source_name")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("double").alias("cap"))


def usable(counted: DataFrame, aim: DataFrame) -> DataFrame:
    """One row per document of a target source that has tokens."""
    return counted.where(F.col("tokens") > 0).join(aim.select("source_name"), "source_name", "left_semi").groupBy("doc_id").agg(
        F.max(F.struct("source_name", "lang_name", "topic", "tokens")).alias("d")).select("doc_id", "d.*")


def goals(cells: DataFrame, aim: DataFrame) -> DataFrame:
    """margin, value, goal: the tokens that every source, language and topic should give.

    The total is the greatest at which every source can give its share under its cap."""
    sources = cells.groupBy("source_name").agg(F.sum("tokens").alias("tokens")).join(aim, "source_name")
    have = sources.agg(F.sum("target_share")).scalar()
    total = sources.select(F.col("tokens") * F.col("cap") * have / F.col("target_share")).toDF("n").agg(F.min("n")).scalar()
    out = sources.select(F.lit("source_name").alias("margin"), F.col("source_name").alias("value"), (F.col("target_share") / have * total).alias("goal"))
    whole = cells.agg(F.sum("tokens")).scalar()
    for m in MARGINS[:2]:
        own = cells.groupBy(m).agg(F.sum("tokens").alias("n"))
        out = out.unionByName(own.select(F.lit(m).alias("margin"), F.col(m).alias("value"), (F.col("n") / whole * total).alias("goal")))
    return out


def _fitted(cells: DataFrame, goal: DataFrame, margin: str, again: bool = False) -> DataFrame:
    """Weights scaled so that one margin holds, none above its cap; ``again``: what the
    capped cells lack is given to the others of their margin value."""
    weight = F.col("weight")
    free = (weight < F.col("cap")) if again else F.lit(True)
    now = cells.groupBy(margin).agg(F.sum(F.when(free, F.col("tokens") * weight)).alias("free"), F.sum(F.when(~free, F.col("tokens") * weight)).alias("held"))
    want = goal.where(F.col("margin") == margin).select(F.col("value").alias(margin), "goal")
    factor = now.join(want, margin).select(margin, ((F.col("goal") - F.coalesce("held", F.lit(0.0))) / F.col("free")).alias("factor"))
    scaled = F.when(free & F.col("factor").isNotNull(), weight * F.greatest("factor", F.lit(0.0))).otherwise(weight)
    return cells.join(factor, margin).withColumn("weight", F.least(scaled, F.col("cap"))).drop("factor")


def rake(cells: DataFrame, aim: DataFrame, goal: DataFrame, still: float = 0.01, rounds: int = 12) -> DataFrame:
    """``cells`` (source_name, lang_name, topic, tokens) with their calibrated ``weight``.

    In each round the margins of languages, topics and sources are fitted in turn, the
    sources last, so that they hold.  It ends when no weight moves by more than
    ``still`` of itself (cells of less than a ten-thousandth of the tokens do not count),
    or after ``rounds`` rounds, where languages and topics cannot all have their share."""
    now = written(cells.join(aim.select("source_name", "cap"), "source_name").withColumn("weight", F.lit(1.0)), "mix-weights")
    least = F.lit(1e-4) * cells.agg(F.sum("tokens")).scalar()
    for _ in range(rounds):
        step = now.withColumn("was", F.col("weight"))
        for m in MARGINS:
            step = _fitted(step, goal, m)
        step = _fitted(step, goal, "source_name", again=True)
        now = written(step, "mix-weights")
        moved = now.where(F.col("tokens") >= least).agg(F.max(F.abs(F.col("weight") / F.col("was") - 1)).alias("m")).first()["m"]
        now = now.drop("was")
        if moved is None or moved <= still:
            break
    return now


def mix(counted: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The chosen documents: doc_id, source_name, lang_name, topic, tokens, repeats (1 or more).

    ``counted``: :func:`token_counts`; ``targets``: source, target_share,
    max_repeats (spelling of the source does not matter).
    The total is the greatest at which every source that has documents can give
    its share without using one more than max_repeats times; shares of sources
    without documents are spread over the others in proportion.  Documents of no
    target source, without a source, or without tokens are not used.  Languages
    and topics are raked to the shares they have among the usable documents, as
    far as the exact source shares and the caps allow.  Rows of one doc_id
    collapse, the greatest counts.  Empty inputs give an empty result.
    """
    aim = targets_of(targets)
    docs = usable(counted, aim)
    cells = written(docs.groupBy("source_name", "lang_name", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "mix-cells")
    raked = rake(cells, aim, written(goals(cells, aim), "mix-goals"))
    placed = docs.join(raked.select("source_name", "lang_name", "topic", "weight", "n_docs"), ["source_name", "lang_name", "topic"])
    return systematic(placed, seed)


def systematic(placed: DataFrame, seed: int) -> DataFrame:
    """Systematic sampling: repeats with expectation ``weight``, off by less than one.

    ``placed``: doc_id, source_name, lang_name, topic, tokens, weight, n_docs (of the cell).
    A source is walked bucket by bucket (size class, cell and, in large cells, a hash,
    so that a bucket has about ``_BUCKET`` documents at most), from small documents to
    big ones, so that the source's token total comes out right.  Documents are summed inside their bucket only; sums of the buckets, first
    in ranges and then over these, give every bucket its start."""
    cell = ["source_name", "lang_name", "topic"]
    keys = ["source_name", "size", *cell[1:], "bucket"]
    sized = placed.withColumn("size", F.floor(4 * F.log2("tokens")).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n_docs") / _BUCKET)))
    before = Window.unboundedPreceding
    phase = F.pmod(F.xxhash64("source_name", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sums = sized.groupBy(*keys).agg(F.sum("weight").alias("w")).withColumn(
        "part", F.col("size") * _RANGES + F.pmod(F.xxhash64(*cell[1:], F.lit(seed)), F.lit(_RANGES)))
    parts = sums.groupBy("source_name", "part").agg(F.sum("w").alias("w")).select(
        "source_name", "part", (F.coalesce(F.sum("w").over(Window.partitionBy("source_name").orderBy("part").rowsBetween(before, -1)), F.lit(0.0)) + phase).alias("start"))
    inside = Window.partitionBy("source_name", "part").orderBy(*keys[1:]).rowsBetween(before, -1)
    start = sums.withColumn("inside", F.coalesce(F.sum("w").over(inside), F.lit(0.0))).join(parts, ["source_name", "part"]).select(
        *keys, (F.col("start") + F.col("inside")).alias("start"))
    walk = Window.partitionBy(*keys).orderBy("tokens", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(before, Window.currentRow)
    return (
        sized.withColumn("to", F.sum("weight").over(walk))
        .join(start, keys)
        .withColumn("to", F.col("to") + F.col("start"))
        .withColumn("repeats", (F.floor(F.col("to") + 1e-9) - F.floor(F.col("to") - F.col("weight") + 1e-9)).cast("int"))
        .where(F.col("repeats") > 0)
        .select("doc_id", *cell, "tokens", "repeats")
    )


def margins(chosen: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """margin, value, target_share, reached_share of every source, language and topic
    that the usable documents have."""
    aim = targets_of(targets)
    cells = usable(counted, aim).groupBy("source_name", "lang_name", "topic").agg(F.sum("tokens").alias("tokens"))
    goal = goals(cells, aim)
    used = None
    for m in MARGINS:
        one = chosen.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"))
        used = one if used is None else used.unionByName(one)
    whole, total = goal.where(F.col("margin") == "source_name").agg(F.sum("goal")).scalar(), chosen.agg(F.sum(F.col("tokens") * F.col("repeats"))).scalar()
    return goal.join(used, ["margin", "value"], "left").select(
        "margin", "value", F.round(F.col("goal") / whole, 6).alias("target_share"), F.round(F.coalesce(F.col("n") / total, F.lit(0.0)), 6).alias("reached_share"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target_share, reached_share, tokens, documents and most repeats used."""
    aim = targets.groupBy(source_key(F.col("source")).alias("source_name")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    used = chosen.groupBy("source_name").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("top_repeats"))
    total = used.agg(F.sum("used_tokens")).scalar()
    n = F.coalesce("used_tokens", F.lit(0))
    return aim.join(used, "source_name", "left").select(
        "source_name", "target_share", F.round(F.coalesce(n / total, F.lit(0.0)), 6).alias("reached_share"), n.alias("used_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_repeats", F.coalesce("top_repeats", F.lit(0)).alias("top_repeats"))
