"""Order statistics and look-ups in two levels, with one group that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import order as O


def rows(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), f"c{i:05d}", rnd.choice([None, None, f"v{i}"]), rnd.randrange(500)) for i in range(2000)]
    return data, spark.createDataFrame(data, "g string, id string, v string, x int")


def test_neighbours_across_buckets(spark):
    data, df = rows(spark)
    part = F.floor(F.substring("id", 2, 5).cast("int") / 100)
    got = {r.id: (r.n, r.prev_id, r.next_id) for r in O.neighbours(df, "g", "id", part).collect()}
    for g in {d[0] for d in data}:
        ids = sorted(d[1] for d in data if d[0] == g)
        for k, i in enumerate(ids):
            assert got[i] == (k + 1, ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None)


def test_nearest_values_across_buckets(spark):
    data, df = rows(spark)
    d2 = df.withColumn("g", F.coalesce("g", F.lit(""))).withColumn("b", F.floor(F.substring("id", 2, 5).cast("int") / 64))
    got = {r.id: (r.before, r.after) for r in O.around(d2, ["g"], "id", "b", F.col("v")).collect()}
    for g in {d[0] for d in data}:
        own = sorted((d[1], d[2]) for d in data if d[0] == g)
        for k, (i, _) in enumerate(own):
            before = next((v for _, v in reversed(own[: k + 1]) if v), None)
            after = next((v for _, v in own[k:] if v), None)
            assert got[i] == (before, after)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_order_statistics(spark, width):
    data, df = rows(spark)
    mid, median = O.interpolated("median", 0.5)
    got = {r.g: (r.n, r.least, r.tenth, r.m) for r in O.order_statistics(
        df, ["g"], "x", {"least": lambda n: F.lit(0), "tenth": lambda n: F.bround((n - 1) * 0.1, 0), **mid}, width).withColumn("m", median).collect()}
    for g in {d[0] for d in data}:
        xs = sorted(d[3] for d in data if d[0] == g)
        n = len(xs)
        assert got[g] == (n, xs[0], xs[round((n - 1) * 0.1)], (xs[(n - 1) // 2] + xs[n // 2]) / 2)


def test_empty_tables(spark):
    _, df = rows(spark)
    none = df.limit(0)
    assert O.neighbours(none, "g", "id", F.lit(0)).count() == 0
    assert O.order_statistics(none, ["g"], "x", {"least": lambda n: F.lit(0)}, 10).count() == 0
    assert O.around(none.withColumn("b", F.lit(0)), ["g"], "id", "b", F.col("v")).count() == 0
