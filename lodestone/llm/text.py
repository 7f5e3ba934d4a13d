"""Column builders and the language profiles shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "zh")
#: Buckets of hashed byte runs, and bytes in a run, of the language profiles.
_BUCKETS, _BYTES = 1 << 16, 4
#: Han characters, as a Java regex class body.
HAN = r"㐀-䶿一-鿿豈-﫿"


def squash(c: Column) -> Column:
    """Letters and digits of any script, lower case, nothing between them."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def words(c: Column) -> Column:
    """Runs of letters and digits of any script, lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def source_key(c: Column) -> Column:
    """One spelling per source: trimmed, lower case, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _grams(text: str) -> np.ndarray:
    """Buckets of the byte runs of a text.  Words with a capital are left out, as
    most are names, unless hardly anything else is there."""
    import re

    plain = re.sub(r"[A-Za-zÀ-ÿ]*[A-ZÀ-Þ][A-Za-zÀ-ÿ]*", " ", text)
    plain = re.sub(r"[\W\d_]+", " ", plain)
    if len(plain) < 12:
        plain = re.sub(r"[\W\d_]+", " ", text.lower())
    raw = np.frombuffer(b" " + plain.encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    if len(raw) < _BYTES:
        return np.empty(0, np.int64)
    h = np.zeros(len(raw) - _BYTES + 1, np.uint32)
    for k in range(_BYTES):
        h = h * np.uint32(257) + raw[k : len(h) + k]
    return (h * np.uint32(2654435769) >> np.uint32(16)).astype(np.int64)


def language_profiles(documents: DataFrame, max_docs: int = 6000) -> np.ndarray:
    """Profiles of the languages, to be given to :func:`language`.

    ``documents``: doc_id, lang, text.  Fitted on at most about ``max_docs`` of the
    labelled documents, those whose id hashes below a bound; labels may be wrong now
    and then.  Spark sums the counts of byte runs per language; what comes back is
    one number per bucket and language (at most 5 x 65,536), whatever the corpus.
    """
    lang = F.lower(F.trim("lang"))
    labelled = documents.where(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select("doc_id", lang.alias("lang"), "text")
    share = F.lit(float(max_docs) * (1 << 20)) / labelled.groupBy().agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(LANGUAGES), _BUCKETS), np.int64)
        for batch in batches:
            for name, text in zip(batch["lang"], batch["text"]):
                n[LANGUAGES.index(name)] += np.bincount(_grams(text), minlength=_BUCKETS)
        k, b = np.nonzero(n)
        yield pd.DataFrame({"k": k, "b": b, "n": n[k, b]})

    got = sample.select("lang", "text").mapInPandas(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((_BUCKETS, len(LANGUAGES)))
    table[got["b"], got["k"]] = got["n"]
    total = table.sum(axis=0)
    part = table / np.maximum(total, 1)
    seen = total > 0
    common = part[:, seen].mean(axis=1, keepdims=True) + 1e-7 if seen.any() else np.ones((_BUCKETS, 1))
    # a run that no language has says nothing: the common share smooths all alike
    return np.where(seen, np.log((0.9 * part + 0.1 * common) / common), -9.0).astype(np.float32)


def language(profiles, text: Column, sure: float = 6.0, least: int = 8) -> Column:
    """Language of a text by its byte runs; null where the two best differ by less
    than ``sure`` (natural logarithm of the odds), or for null texts and those with fewer than ``least`` runs."""
    shared = SparkSession.active().sparkContext.broadcast(profiles)  # 65,536 x 5 numbers

    def tell(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in texts:
            out = []
            for t in batch:
                g = _grams(t) if t else ()
                s = table[g].sum(axis=0) if len(g) >= least else np.zeros(len(LANGUAGES))
                a, b = np.argsort(-s)[:2]
                out.append(LANGUAGES[a] if s[a] - s[b] >= sure else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(tell, "string")(text)


def chunk_texts(hits: DataFrame, *extra: str) -> DataFrame:
    """One row per chunk of the hits: chunk_id, text and ``extra`` columns.

    The text is the same in each hit of a chunk but null in some, so rows
    without text go first and one row per chunk is kept, after partial
    aggregation; ties between differing rows go to the greatest row.
    """
    return (
        hits.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
        .groupBy("chunk_id")
        .agg(F.max(F.struct("text", *extra)).alias("r"))
        .select("chunk_id", "r.*")
    )
