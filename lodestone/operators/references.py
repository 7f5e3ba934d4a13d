"""References to records that do not exist, or did not at the time.

References and parent rows are brought into one stream per key: co-partitioned
by key, sorted by time, and merged linearly by a running window.  A parent row
enters the stream twice, as a header (before everything, so that the merge knows
the first ingestion) and as the start of its validity interval.  No interval
list is ever collected; the window keeps three values per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: White space that may surround an id, as a Java character class.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
_FAR = "9999-12-31 00:00:00"


def normal_id(c: Column, digits: int = 5) -> Column:
    """Canonical spelling of an id: trimmed, lower case, final number padded.

    Leading zeros of the final number do not count; ids without a final number
    are only trimmed and lowered; null and blank ids become null.
    """
    s = F.lower(F.regexp_replace(c, rf"^{_BLANK}|{_BLANK}$", ""))
    tail = F.regexp_extract(s, r"([0-9]+)$", 1)
    head = F.substring(s, F.lit(1), F.length(s) - F.length(tail))
    bare = F.regexp_replace(tail, r"^0+", "")
    padded = F.when(F.length(bare) < digits, F.lpad(bare, digits, "0")).otherwise(bare)
    return F.when(s == "", None).when(tail == "", s).otherwise(F.concat(head, padded))


def references_of(df: DataFrame, table: str, record: str, ids: str, at: str) -> DataFrame:
    """One row per element of the id array ``ids``: ref_table, record_id, chunk_id, at.

    Null records, null arrays and null or blank elements give no row.
    """
    return (
        df.select(
            F.lit(table).alias("ref_table"),
            F.col(record).cast("string").alias("record_id"),
            F.col(at).alias("at"),
            F.explode(ids).alias("raw"),
        )
        .select("ref_table", "record_id", "at", normal_id(F.col("raw")).alias("chunk_id"))
        .where(F.col("chunk_id").isNotNull() & F.col("record_id").isNotNull())
    )


def _hot_keys(refs: DataFrame, pieces: int) -> DataFrame:
    """Keys that hold over 1/``pieces`` of all references (so fewer than ``pieces``
    rows, a proven bound), with the number of salts each is spread over."""
    counts = refs.groupBy("chunk_id").agg(F.count("*").alias("n"))
    share = refs.groupBy().agg((F.count("*") / F.lit(pieces)).alias("x")).scalar()
    return counts.where(F.col("n") > F.greatest(share, F.lit(10_000.0))).select(
        "chunk_id", F.ceil(F.col("n") / F.greatest(share, F.lit(10_000.0))).cast("int").alias("salts")
    )


def orphans(refs: DataFrame, parents: DataFrame, pieces: int = 256) -> DataFrame:
    """Orphan references: ref_table, record_id, chunk_id, orphan_state, period.

    ``refs`` is the union of :func:`references_of`; ``parents`` has chunk_id,
    ingested_at, deleted_at (extra columns are ignored).  States: ``missing`` –
    no parent row; ``late`` – before the first ingestion; ``deleted`` – in no
    living span [ingested_at, deleted_at).  A reference without a time can only
    be missing, its period is ``unknown``.  A parent without ingested_at exists
    but opens no span.  Repeated rows collapse; a record that cites one chunk at
    several times gets its first orphan time.  Empty inputs give empty results.

    A key with a large share of all references is spread over salts; its few
    parent rows are repeated per salt.
    """
    refs = written(refs, "references")  # counted for the hot keys and then merged
    hot = F.broadcast(_hot_keys(refs, pieces))
    child = refs.join(hot, "chunk_id", "left").select(
        "chunk_id",
        F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("record_id"), F.col("salts"))).otherwise(F.lit(0)).cast("int").alias("salt"),
        F.col("at").alias("ts"), F.lit(2).alias("kind"),
        F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(None).cast("timestamp_ntz").alias("until"),
        "ref_table", "record_id",
    )
    spans = (
        parents.select(
            normal_id(F.col("chunk_id")).alias("chunk_id"),
            F.col("ingested_at").cast("timestamp_ntz").alias("begin"),
            F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.lit(_FAR).cast("timestamp_ntz")).alias("until"),
        )
        .where(F.col("chunk_id").isNotNull())
        .join(hot, "chunk_id", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    )
    none = F.lit(None).cast("timestamp_ntz")
    text = F.lit(None).cast("string")
    # a header counts as a parent even if its ingested_at is null: it gets the far end of time
    far = F.lit(_FAR).cast("timestamp_ntz")
    parent = spans.select(
        "chunk_id", "salt",
        F.explode(F.array(
            F.struct(none.alias("ts"), F.lit(0).alias("kind"), F.coalesce("begin", far).alias("first"), none.alias("until")),
            F.struct(F.col("begin").alias("ts"), F.lit(1).alias("kind"), none.alias("first"),
                     F.when(F.col("begin").isNotNull(), F.col("until")).alias("until")),
        )).alias("e"),
    ).select("chunk_id", "salt", "e.*", text.alias("ref_table"), text.alias("record_id"))
    merged = Window.partitionBy("chunk_id", "salt").orderBy(F.col("ts").asc_nulls_first(), "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    child = child.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    state = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("ts").isNull(), None)
        .when(F.col("ts") < F.col("known"), "late")
        .when(F.col("alive").isNull() | (F.col("alive") <= F.col("ts")), "deleted")
    )
    return (
        child.unionByName(parent)
        .withColumn("known", F.min("first").over(merged))
        .withColumn("alive", F.max("until").over(merged))
        .where(F.col("kind") == 2)
        .withColumn("orphan_state", state)
        .where(F.col("orphan_state").isNotNull())
        .groupBy("ref_table", "record_id", "chunk_id")
        .agg(F.min(F.struct(F.col("ts").isNull(), "ts", "orphan_state")).alias("o"))
        .select(
            "ref_table", "record_id", "chunk_id", F.col("o.orphan_state").alias("orphan_state"),
            F.coalesce(F.date_format("o.ts", "yyyy-MM"), F.lit("unknown")).alias("period"),
        )
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, period and state, with the number of records concerned."""
    return found.groupBy("ref_table", "period", "orphan_state").agg(
        F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"),
        F.countDistinct("chunk_id").alias("n_chunks"),
    )
