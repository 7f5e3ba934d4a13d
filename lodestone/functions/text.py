"""Tokenisers and normalisers as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns and word lists whose results callers rely on.
BM25_TOKEN = r"[A-Za-z][A-Za-z0-9_.+-]*|[0-9]+(?:\.[0-9]+)*|[A-Za-z0-9]+"
AUDIT_TOKEN = r"[a-z][a-z0-9_-]+|[0-9]+(?:\.[0-9]+)?%?"
NEGATIONS = ("no", "not", "without", "never", "cannot", "fails", "unable", "neither", "nor")
SEVERE_TERMS = (
    "completely replace", "completely solve", "entirely eliminate", "entirely replaced", "fully resolved", "fully solves",
    "fully proves", "eliminate all", "solves all", "without any limitation", "no longer needs", "never", "always works",
    "always correct", "guarantee", "prove that", "proves that", "undeniably", "unequivocally",
)
MILD_TERMS = ("completely", "entirely", "fully", "perfect", "always", "state-of-the-art", "best", "all problems")
NUMBER = r"[0-9]+(?:\.[0-9]+)?%?"


def bm25_tokens(c: Column) -> Column:
    """Index tokens in order, lower case; null gives an empty list."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BM25_TOKEN), F.lit(0)), F.lower)


def audit_tokens(c: Column) -> Column:
    """Distinct audit tokens: words of two signs or more, numbers, Han runs and their pairs."""
    t = F.lower(F.coalesce(c, F.lit("")))
    latin = F.regexp_extract_all(t, F.lit(AUDIT_TOKEN), F.lit(0))
    han = F.regexp_extract_all(t, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, han, pairs))


def plain_tokens(c: Column) -> Column:
    """Distinct runs of letters and digits longer than one sign, lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 1))


def overlap_ratio(a: Column, b: Column) -> Column:
    """|A and B| / max(1, |A|) of two token sets (not symmetric)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def dice(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def squeezed(c: Column) -> Column:
    """White space runs as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", " "))


def compact(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, with an ellipsis where something was cut."""
    s = squeezed(c)
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)


def word_count(c: Column) -> Column:
    s = squeezed(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! ? before white space and after Han stops."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+", "$1\u0001"), "([。！？])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), F.trim), lambda s: F.length(s) > 0)


def citations(c: Column) -> Column:
    """Distinct citation marks, sorted: [n], Name et al. (yyyy), (Name, yyyy)."""
    t = F.coalesce(c, F.lit(""))
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (
        r"\[[0-9]{1,3}\]", r"[A-Z][A-Za-z-]+ et al\.?\s*\([0-9]{4}\)", r"\([A-Z][A-Za-z-]+,\s*[0-9]{4}\)")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def claim_numbers(c: Column) -> Column:
    """Numbers a claim states: not in citation brackets, not of a figure, table or section."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[0-9 ,;–-]+\]", " ")
    t = F.regexp_replace(t, r"(?i)\b(figure|fig\.?|table|section|sec\.?)\s*[0-9]+(\.[0-9]+)*", " ")
    t = F.regexp_replace(t, r"[A-Za-z][A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*", " ")
    return F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))


def overclaim(c: Column) -> Column:
    """severe, mild or none, by the words a text uses."""
    t = F.lower(F.coalesce(c, F.lit("")))
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda w: F.contains(t, w))
    return F.when(has(SEVERE_TERMS), "severe").when(has(MILD_TERMS), "mild").otherwise("none")
