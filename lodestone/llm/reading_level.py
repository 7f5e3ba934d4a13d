"""Reading level by smoothed unigram language models, one per band.

The models are fitted on a bounded sample of rated documents; raters may be off
by one band, so a rating is only a prior, and a few rounds of expectation and
maximisation let the texts of one band pull wrong ratings over.  Words are hashed
to a fixed number of buckets, so no word is left out and the model is bounded.
Scoring reads every document: one explode, one join with the model, one sum; the
band with the highest posterior wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import HAN, LANGUAGES

BANDS = ("basic", "middle", "college", "expert")
#: Buckets of hashed words: the number of rows of the models.
BUCKETS = 1 << 16
_PRIOR = -1  # stands in the table of the model for the share of each band
#: Words that say something about the level: in lower case, so neither names nor numbers.
_WORD = r"\b[a-zäöüßéèêàçñáíóú]+(?:['’-][a-zäöüßéèêàçñáíóú]+)*"


def terms(text: Column) -> Column:
    """Lower-case words; of texts without any lower-case letter, all words."""
    t = F.when(text.rlike("[a-z]{3}"), text).otherwise(F.lower(text))
    return F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))


def _priors(labels: DataFrame, sure: float) -> DataFrame:
    """doc_id and, per band, the log prior given all its ratings."""
    place = F.array_position(F.array(*map(F.lit, BANDS)), F.lower(F.trim("band"))).cast("int")
    rated = labels.where((place > 0) & F.col("doc_id").isNotNull()).select("doc_id", place.alias("at")).dropDuplicates()
    far = lambda k: F.abs(F.col("at") - (k + 1))
    own, near, rest = math.log(sure), math.log((1 - sure) / 2), math.log((1 - sure) / 40)
    return rated.groupBy("doc_id").agg(*[
        F.sum(F.when(far(k) == 0, own).when(far(k) == 1, near).otherwise(rest)).alias(f"p{k}") for k in range(4)
    ])


def _softmax(cols: list[Column]) -> list[Column]:
    top = F.greatest(*cols)
    e = [F.exp(F.greatest(c - top, F.lit(-50.0))) for c in cols]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def _buckets(text: Column) -> Column:
    return F.transform(terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows, those whose doc_id hashes below a bound."""
    share = F.lit(float(most) * (1 << 20)) / rows.groupBy().agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)


def fit_languages(documents: DataFrame, max_docs: int = 6000) -> DataFrame:
    """b and, per language with a Latin script, how much more often than on average
    its words are in bucket b (natural logarithm).

    ``documents``: doc_id, lang, text.  Fitted on about ``max_docs`` of the labelled
    documents at most; some labels may be wrong."""
    lang = F.lower(F.trim("lang"))
    names = [k for k in LANGUAGES if k != "zh"]
    labelled = documents.where(lang.isin(*names) & F.col("text").isNotNull()).select("doc_id", lang.alias("lang"), "text")
    n = _sampled(labelled, max_docs).select("lang", F.explode(_buckets(F.col("text"))).alias("b")).groupBy("b").agg(
        *[F.count_if(F.col("lang") == k).alias(k) for k in names])
    n = written(n, "level-languages")  # at most BUCKETS rows
    t = n.agg(F.struct(*[F.greatest(F.sum(k), F.lit(1)).alias(k) for k in names])).scalar()
    part = n.select("b", t.alias("t"), *names).select("b", *[(F.col(k) / F.col(f"t.{k}")).alias(k) for k in names])
    common = sum((F.col(k) for k in names), F.lit(0.0)) / len(names)
    return part.withColumn("common", common).select("b", *[F.log((0.9 * F.col(k) + 0.1 * F.col("common")) / F.col("common")).alias(k) for k in names])


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = 4000, rounds: int = 3, smoothing: float = 0.1, sure: float = 0.7) -> DataFrame:
    """The model: b (bucket of words) and its log probability per band (w0..w3); the
    row of bucket -1 holds the log share of every band.

    Fitted on about ``max_docs`` of the rated documents at most, those whose id hashes
    below a bound.  Raters give the right band with probability ``sure``, else a
    neighbouring one.
    """
    bands = range(len(BANDS))
    sample = _sampled(_priors(labels, sure), max_docs)
    counts = (
        documents.select("doc_id", "text").join(sample, "doc_id")
        .select("doc_id", *[f"p{k}" for k in bands], F.explode(_buckets(F.col("text"))).alias("b"))
        .groupBy("doc_id", *[f"p{k}" for k in bands], "b").agg(F.count("*").alias("n"))
    )
    counts = written(counts, "level-counts")
    post = counts.groupBy("doc_id").agg(*[F.first(f"p{k}").alias(f"p{k}") for k in bands]).select(
        "doc_id", *[x.alias(f"r{k}") for k, x in enumerate(_softmax([F.col(f"p{k}") for k in bands]))])
    for step in range(rounds + 1):
        weighted = counts.join(post, "doc_id").select("b", *[(F.col("n") * F.col(f"r{k}")).alias(f"c{k}") for k in bands])
        share = post.agg(F.count("*").alias("n"), *[F.sum(f"r{k}").alias(f"c{k}") for k in bands]).where("n > 0").select(
            F.lit(_PRIOR).alias("b"), *[F.col(f"c{k}") for k in bands])
        summed = written(weighted.groupBy("b").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in bands]).unionByName(share), "level-sums")  # at most BUCKETS + 1 rows
        word = F.col("b") != _PRIOR
        total = summed.groupBy(word.alias("word")).agg(*[(F.sum(f"c{k}") + smoothing * F.count("*")).alias(f"t{k}") for k in bands])
        model = written(summed.join(F.broadcast(total), word == F.col("word")).select(
            "b", *[F.log((F.col(f"c{k}") + smoothing) / F.col(f"t{k}")).alias(f"w{k}") for k in bands]), f"level-model-{step}")
        if step == rounds:
            return model
        scores = counts.join(F.broadcast(model), "b").groupBy("doc_id").agg(*[
            (F.sum(F.col("n") * F.col(f"w{k}")) + F.first(f"p{k}")).alias(f"s{k}") for k in bands])
        post = written(scores.select("doc_id", *[x.alias(f"r{k}") for k, x in enumerate(_softmax([F.col(f"s{k}") for k in bands]))]), "level-posterior")


def levels(documents: DataFrame, model: DataFrame, languages: DataFrame, least_words: int = 60) -> DataFrame:
    """doc_id, band, posterior and margin (log odds per known word to the next band)
    of each English document with at least ``least_words`` runs of non-white characters.

    ``model``: :func:`fit`; ``languages``: :func:`fit_languages`.  English: its words
    are likelier English than of any other language, and it has more Latin letters
    than Han characters.  Null, blank and short texts give no row; a text without any
    word that the model knows is ``middle`` with margin null.  Ties go to the easier
    band.  Other columns of ``documents`` are ignored.
    """
    base = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", "text", F.size(F.split(F.trim(F.regexp_replace("text", r"[\s 　]+", " ")), " ")).alias("n_words")
    ).where(F.col("n_words") >= least_words)
    han = F.when(F.col("text").rlike(f"[{HAN}]"), F.length(F.regexp_replace("text", f"[^{HAN}]", ""))).otherwise(F.lit(0))
    base = base.where(han * 2 < F.length("text"))
    names = [k for k in LANGUAGES if k != "zh"]
    bands = range(len(BANDS))
    table = model.join(languages, "b", "full_outer")  # at most BUCKETS + 1 rows
    known = F.col("w0").isNotNull() & (F.col("b") != _PRIOR)
    hit = base.select("doc_id", F.explode(F.concat(F.array(F.lit(_PRIOR)), _buckets(F.col("text")))).alias("b")).join(F.broadcast(table), "b")
    sums = hit.groupBy("doc_id").agg(
        F.count(F.when(known, 1)).alias("n"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in bands],
        *[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in names])
    others = F.greatest(*[F.col(k) for k in names if k != "en"])
    score = F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("o"), F.lit(b).alias("band")) for k, b in enumerate(BANDS)])
    ranked = F.sort_array(score, asc=False)
    post = _softmax([F.col(f"s{k}") for k in bands])
    return sums.where(F.col("en") > others).select(
        "doc_id", F.when(F.col("n") == 0, "middle").otherwise(ranked[0]["band"]).alias("band"), F.greatest(*post).alias("posterior"),
        F.when(F.col("n") > 0, (ranked[0]["s"] - ranked[1]["s"]) / F.col("n")).alias("margin"))


def profile(found: DataFrame, documents: DataFrame, source: Column) -> DataFrame:
    """Documents per source and band, with the share of each band in its source."""
    counted = documents.select("doc_id", F.coalesce(source, F.lit("unknown")).alias("source_name")).join(found, "doc_id") \
        .groupBy("source_name", "band").agg(F.count("*").alias("n_docs"))
    total = counted.groupBy("source_name").agg(F.sum("n_docs").alias("n_source"))
    return counted.join(total, "source_name").select(
        "source_name", "band", "n_docs", F.round(F.col("n_docs") / F.col("n_source"), 6).alias("share"))
