"""Order statistics and look-ups along an order, for groups of any size.

Every operator works in two levels: rows are counted or ordered inside a bucket of
their group only, and one row per bucket carries the state along the group.  So no
task gets a large group whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, groups: list[str], value: str, ranks: dict[str, object], width: float) -> DataFrame:
    """groups, n and one column per entry of ``ranks``: the value that stands at a
    place of the sorted values of its group.

    ``ranks``: name -> function from the number of values (a column) to the place (a
    column, from 0).  ``width``: values of one bucket; it decides on the work only.
    Rows without a value are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c")).withColumn("_b", F.floor(F.col(value) / width))
    keyed = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(f"_g{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))]
    counts = counts.select("*", *keyed)
    before = Window.unboundedPreceding
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    total = sums.groupBy(*keys).agg(F.sum("_s").alias("n"))
    base = sums.join(total, keys).withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(before, -1)), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(before, Window.currentRow)
    placed = counts.join(base, [*keys, "_b"]).withColumn("_to", F.col("_base") + F.sum("_c").over(inside))
    return placed.groupBy(*groups).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_to") > place(F.col("n")), F.col(value))).alias(name) for name, place in ranks.items()])


def interpolated(name: str, q: float) -> tuple[dict[str, object], Column]:
    """Two entries for :func:`order_statistics` and the quantile ``q`` that lies between them."""
    at = lambda n: (n - 1) * F.lit(q)
    lo, hi = f"_{name}_lo", f"_{name}_hi"
    return {lo: lambda n: F.floor(at(n)), hi: lambda n: F.ceil(at(n))}, F.col(lo) + (F.col(hi) - F.col(lo)) * (at(F.col("n")) - F.floor(at(F.col("n"))))


def neighbours(rows: DataFrame, group: str, order: str, bucket: Column) -> DataFrame:
    """group, order, n (running count), previous and next id within the group.
    ``bucket`` does not fall along the order; rows without a group are one group."""
    cut = rows.select(group, order, bucket.alias("_b"), F.coalesce(group, F.lit("\u0000")).alias("_g"))
    inside, along = Window.partitionBy("_g", "_b").orderBy(order), Window.partitionBy("_g").orderBy("_b")
    edges = cut.groupBy("_g", "_b").agg(F.count("*").alias("_c"), F.min(order).alias("_first"), F.max(order).alias("_last")).select(
        "_g", "_b", F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    return cut.join(edges, ["_g", "_b"]).select(
        group, order, (F.col("_base") + F.row_number().over(inside)).cast("int").alias("n"),
        F.coalesce(F.lag(order).over(inside), F.col("_before")).alias("prev_id"), F.coalesce(F.lead(order).over(inside), F.col("_after")).alias("next_id"))


def around(rows: DataFrame, groups: list[str], order: str, bucket: str, value: Column) -> DataFrame:
    """Adds before and after: the nearest value that is not null at or before, and at or
    after the row in its group.  ``groups`` and ``bucket`` hold no nulls."""
    cut = rows.withColumn("_v", value)
    first, here, last = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing
    inside, along = Window.partitionBy(*groups, bucket).orderBy(order), Window.partitionBy(*groups).orderBy(bucket)
    known = F.when(F.col("_v").isNotNull(), F.col(order))
    ends = cut.groupBy(*groups, bucket).agg(F.max_by("_v", known).alias("_l"), F.min_by("_v", known).alias("_f")).select(
        *groups, bucket, F.last("_l", ignorenulls=True).over(along.rowsBetween(first, -1)).alias("_carry"), F.first("_f", ignorenulls=True).over(along.rowsBetween(1, last)).alias("_come"))
    return cut.join(ends, [*groups, bucket]).withColumn("before", F.coalesce(F.last("_v", ignorenulls=True).over(inside.rowsBetween(first, here)), F.col("_carry"))).withColumn(
        "after", F.coalesce(F.first("_v", ignorenulls=True).over(inside.rowsBetween(here, last)), F.col("_come"))).select(*rows.columns, "before", "after")
