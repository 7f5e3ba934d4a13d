"""A vector store as tables: upsert, delete, metadata codec, content-addressed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key.
    Of repeated keys among the changes the greatest row counts (columns in order)."""
    rest = [c for c in current.columns if c != key]
    fresh = changes.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*current.columns) if rest else changes.select(key).distinct()
    return current.join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def delete(current: DataFrame, keys: DataFrame, key: str, most: float | None = None) -> DataFrame:
    """``current`` without the given keys; more than the share ``most`` of it is refused."""
    kept = current.join(keys.select(key), key, "left_anti")
    if most is not None:
        n, m = current.count(), kept.count()
        if n and (n - m) / n > most:
            raise ValueError(f"{n - m} of {n} rows would be deleted")
    return kept


def encode_metadata(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """List columns as JSON text, for stores that hold scalars only; null stays null."""
    return df.withColumns({c: F.to_json(c) for c in lists})


def decode_metadata(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, "array<string>") for c in lists})


def cache_key(parts: Sequence[str], version: str) -> F.Column:
    """Hash of the inputs and the version of whatever computes the value."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *[F.col(p) for p in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def through_cache(rows: DataFrame, cache: DataFrame, parts: Sequence[str], version: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with value, new cache rows): values that the cache (key, value) has are
    taken from it; every other different input is computed once and fanned out.

    ``compute`` maps a frame with key and ``parts`` to key and value."""
    keyed = rows.withColumn("key", cache_key(parts, version))
    missing = keyed.join(cache.select("key"), "key", "left_anti").select("key", *parts).dropDuplicates(["key"])
    made = compute(missing).select("key", "value")
    return keyed.join(cache.select("key", "value").unionByName(made), "key"), made


def hashing_embedder(size: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Deterministic stand-in of an embedding model: signed hashing of words, unit length."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for batch in batches:
            out = []
            for text in batch["text"]:
                v = np.zeros(size)
                for w in (text or "").lower().split():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % size] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32").tolist())
            yield pd.DataFrame({"key": batch["key"], "value": out})

    return lambda df: df.select("key", "text").mapInPandas(embed, "key string, value array<float>")
