"""Near-duplicate texts by deletion-variant signatures.

A text's signature is a row of MinHash symbols of its word runs.  It is cut into
segments, fewer than the symbols that may differ, so that some segment of two
similar texts differs in at most one symbol; for every segment the variants with
one symbol left out are indexed, an equality join of the variants gives the
candidates, a bit sketch thins them out, and the word runs themselves decide.

(At a similarity of one half, one-bit symbols would leave a quarter of all bits
different and no segment could select anything; hence whole MinHash values take
the place of bits.  See the README for the recall this gives.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Segments, symbols per segment.
SEGMENTS, SYMBOLS = 30, 5
_WORDS = "[a-z0-9]+"


def _signer(segments: int, symbols: int, shingle: int, least_words: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import numpy as np
        import xxhash

        words = re.compile(_WORDS)
        rng = np.random.default_rng(20240229)  # the same functions in every task
        n = segments * symbols
        mul = rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        mix = rng.integers(1, 1 << 62, (symbols, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        name = rng.integers(1, 1 << 62, (segments, symbols), dtype=np.uint64)
        power = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
        while len(power) < shingle:
            power.append(power[-1] * np.uint64(3))
        known: dict[str, int] = {}
        weights = np.uint64(1) << np.arange(50, dtype=np.uint64)
        for batch in batches:
            keys, out, sketch = [], [], []
            for tkey, text in zip(batch["tkey"], batch["text"]):
                w = words.findall(text.lower())
                if len(w) < least_words:
                    continue
                if len(known) > 2_000_000:
                    known.clear()
                ids = np.empty(len(w), dtype=np.uint64)
                for i, x in enumerate(w):
                    v = known.get(x)
                    if v is None:
                        v = known[x] = xxhash.xxh64_intdigest(x)
                    ids[i] = v
                runs = np.zeros(len(w) - shingle + 1, dtype=np.uint64)
                for k in range(shingle):
                    part = ids[k : len(w) - shingle + 1 + k] * power[k]
                    runs += part ^ (part >> np.uint64(31))
                runs = np.unique(runs * power[0])
                low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(runs), 2048):  # very long texts: bounded memory
                    h = (runs[at : at + 2048, None] ^ add[None, :]) * mul[None, :]
                    np.minimum(low, h.min(axis=0), out=low)
                seg = low.reshape(segments, symbols)
                one = (seg * mix.T) ^ ((seg * mix.T) >> np.uint64(29))
                whole = one.sum(axis=1, dtype=np.uint64, keepdims=True)
                variants = ((whole - one) ^ name) * power[2]  # one symbol left out
                keys.append(tkey)
                out.append(variants.reshape(-1).view(np.int64))
                bits = np.zeros(150, dtype=np.uint64)
                bits[: min(n, 150)] = (low >> np.uint64(7))[:150] & np.uint64(1)
                sketch.append((bits.reshape(3, 50) * weights).sum(axis=1, dtype=np.uint64).view(np.int64))
            yield pd.DataFrame({"tkey": pd.Series(keys, dtype="int64"), "variants": pd.Series(out, dtype=object), "sketch": pd.Series(sketch, dtype=object)})

    return sign


def _bucket_pairs(most: int):
    """Pairs within runs of equal ``v`` of sorted rows; runs longer than ``most``
    come out as they are (b null), for a join that can be split."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def emit(v, t):
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            size = np.repeat(np.diff(np.r_[starts, len(v)]), np.diff(np.r_[starts, len(v)]))
            hot = size > most
            a, b, w = [t[hot]], [np.zeros(hot.sum(), np.int64)], [v[hot]]
            keep = (size > 1) & ~hot
            v, t = v[keep], t[keep]
            for d in range(1, most):
                same = np.flatnonzero(v[d:] == v[:-d]) if d < len(v) else []
                if len(same) == 0:
                    break
                x, y = t[same], t[same + d]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                w.append(np.zeros(len(same), np.int64))
            n = len(a[0])
            out = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "v": np.concatenate(w)})
            out["hot"] = np.arange(len(out)) < n
            return out.drop_duplicates() if len(out) > n else out

        rest_v, rest_t = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list = []
        for batch in batches:
            held.append((batch["v"].to_numpy(np.int64), batch["tkey"].to_numpy(np.int64)))
            if sum(len(x[0]) for x in held) < 500_000:
                continue
            v = np.concatenate([rest_v, *[x[0] for x in held]])
            t = np.concatenate([rest_t, *[x[1] for x in held]])
            held = []
            cut = int(np.flatnonzero(v != v[-1])[-1]) + 1 if v[0] != v[-1] else 0
            if cut == 0 and len(v) > 2_000_000:  # one run fills everything: it is hot anyhow
                yield pd.DataFrame({"a": t, "b": np.zeros(len(t), np.int64), "v": v, "hot": True})
                rest_v, rest_t = v[:0], t[:0]
                continue
            if cut:
                yield emit(v[:cut], t[:cut])
            rest_v, rest_t = v[cut:], t[cut:]
        v = np.concatenate([rest_v, *[x[0] for x in held]])
        t = np.concatenate([rest_t, *[x[1] for x in held]])
        if len(v):
            yield emit(v, t)

    return scan


def _verifier(similarity: float, shingle: int):
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        import re

        words = re.compile(_WORDS)

        def runs(text):
            w = words.findall(text.lower())
            return set(zip(*[w[k:] for k in range(shingle)]))

        out = []
        known: dict[str, set] = {}
        for x, y in zip(a, b):
            if len(known) > 500:
                known.clear()
            for z in (x, y):
                if z not in known:
                    known[z] = runs(z)
            p, q = known[x], known[y]
            n = len(p & q)
            out.append(n >= similarity * (len(p) + len(q) - n) and n > 0)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(alike, "boolean")


def similar_texts(texts: DataFrame, similarity: float = 0.5, shingle: int = 3, least_words: int = 20,
                  segments: int = SEGMENTS, symbols: int = SYMBOLS, bucket: int = 64) -> DataFrame:
    """Pairs of different texts at least ``similarity`` alike: a, b (a < b).

    ``texts``: tkey long (unique), text with at least ``least_words`` words.
    Similarity is the share of common runs of ``shingle`` words among all runs of
    the two texts; the result holds no pair below it.  Buckets of up to ``bucket``
    texts are paired while their sorted rows stream by; the members of larger ones
    go to a join that Spark can split.
    """
    signed = written(texts.mapInPandas(_signer(segments, symbols, shingle, least_words), "tkey long, variants array<long>, sketch array<long>"), "near-signatures")
    index = signed.select("tkey", F.explode("variants").alias("v"))
    scanned = index.repartition("v").sortWithinPartitions("v", "tkey").mapInPandas(_bucket_pairs(bucket), "a long, b long, v long, hot boolean")
    scanned = written(scanned, "near-candidates")
    hot = scanned.where("hot").select("v", "a")
    wide = hot.join(hot.select("v", F.col("a").alias("b")), "v").where(F.col("a") < F.col("b")).select("a", "b")
    found = scanned.where(~F.col("hot") & (F.col("a") != F.col("b"))).select("a", "b").unionByName(wide).distinct()
    # thin out by sketch: of 150 bits, (1 - s) / 2 differ on average; four standard deviations are allowed
    p = (1 - similarity) / 2
    most = int(150 * p + 4 * (150 * p * (1 - p)) ** 0.5)
    bits = signed.select(F.col("tkey"), *[F.col("sketch")[i].alias(f"k{i}") for i in range(3)])
    ka = bits.select(F.col("tkey").alias("a"), *[F.col(f"k{i}").alias(f"a{i}") for i in range(3)])
    kb = bits.select(F.col("tkey").alias("b"), *[F.col(f"k{i}").alias(f"b{i}") for i in range(3)])
    apart = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(3))
    near = found.join(ka, "a").join(kb, "b").where(apart <= most).select("a", "b")
    ta = texts.select(F.col("tkey").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("tkey").alias("b"), F.col("text").alias("text_b"))
    both = near.join(ta, "a").join(tb, "b")
    return both.where(_verifier(similarity, shingle)(F.col("text_a"), F.col("text_b"))).select("a", "b")


def _long_enough(text: Column, least_words: int) -> Column:
    return F.lower(text).rlike(rf"(?:[a-z0-9]++[^a-z0-9]++){{{least_words - 1}}}[a-z0-9]")


def near_duplicates(rows: DataFrame, similarity: float = 0.5, shingle: int = 3, least_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the near-duplicate relation over ``rows`` (id, text).

    members: id, tkey – one row per id and different text; equal texts share a
    tkey, so copies are never compared.  links: a, b – pairs of tkeys at least
    ``similarity`` alike.  Null texts, texts with fewer than ``least_words``
    words and null ids are in neither; repeated rows collapse.
    """
    usable = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & _long_enough(F.col("text"), least_words)).select(
        "id", F.xxhash64("text").alias("tkey"), "text")
    members = usable.select("id", "tkey").distinct()
    texts = usable.groupBy("tkey").agg(F.first("text").alias("text"))
    return members, similar_texts(texts, similarity, shingle, least_words)


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of ids, id_a < id_b: of linked texts and of equal texts."""
    a = members.select(F.col("id").alias("x"), F.col("tkey").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("tkey").alias("b"))
    linked = links.join(a, "a").join(b, "b").select("x", "y")
    equal = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return linked.unionByName(equal).where(F.col("x") != F.col("y")).select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, class_id (the least id with an equal text), n_copies, n_links (to other texts):
    one row per id and different text."""
    n = members.groupBy("tkey").agg(F.count("*").alias("n_copies"), F.min("id").alias("class_id"))
    ends = links.select(F.explode(F.array("a", "b")).alias("tkey")).groupBy("tkey").agg(F.count("*").alias("n_links"))
    return members.join(n, "tkey").join(ends, "tkey", "left").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
