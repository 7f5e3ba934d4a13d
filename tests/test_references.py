"""Orphan references against a brute-force check, and the edge cases."""

import random
from datetime import datetime, timedelta

from lodestone.operators.references import normal_id, orphan_report, orphans, references_of

REF = "rid string, ids array<string>, at timestamp_ntz, chunk_id string"
PAR = "chunk_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, ref_table string"
T0 = datetime(2025, 1, 1)


def test_normal_id(spark):
    rows = [(" A_7 ", "a_00007"), ("a_0000000012", "a_00012"), ("a_1234567", "a_1234567"), ("\tx\n", "x"), ("  ", None), (None, None), ("a_0", "a_00000")]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.select(normal_id(df.raw).alias("got"), "want").collect():
        assert r.got == r.want


def brute(refs, parents):
    out = set()
    for rid, ids, at, _ in refs:
        for i in ids or []:
            if i is None or not i.strip():
                continue
            k = i.strip().lower()
            own = [(b, e) for c, b, e, _ in parents if c == k]
            if not own:
                s = "missing"
            elif at is None:
                continue
            elif at < min(b for b, _ in own):
                s = "late"
            elif any(b <= at and (e is None or at < e) for b, e in own):
                continue
            else:
                s = "deleted"
            out.add(("t", rid, k, s, at.strftime("%Y-%m") if at else "unknown"))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    parents = []
    for k in range(40):
        b = T0 + timedelta(days=rnd.randrange(60))
        e = b + timedelta(days=rnd.randrange(1, 40)) if rnd.random() < 0.6 else None
        parents.append((f"c_{k:05d}", b, e, "clash"))
        if e and rnd.random() < 0.5:
            parents.append((f"c_{k:05d}", e + timedelta(days=5), None, "clash"))
    parents += parents[:5]  # redelivered
    refs = []
    for r in range(400):
        ids = [f"c_{rnd.randrange(50):05d}" if rnd.random() < 0.6 else "C_00003 " for _ in range(3)] + [None, " "]
        refs.append((f"r{r}", ids, T0 + timedelta(days=rnd.randrange(120)) if rnd.random() < 0.9 else None, "x"))
    refs.append(("none", None, T0, "x"))
    r = references_of(spark.createDataFrame(refs, REF), "t", "rid", "ids", "at")
    got = {tuple(x) for x in orphans(r, spark.createDataFrame(parents, PAR)).collect()}
    assert got == brute(refs, parents)


def test_salting_splits_the_hot_key(spark):
    refs = spark.range(30_000).selectExpr("'t' ref_table", "cast(id as string) record_id", "timestamp_ntz'2025-01-01' at", "'hot_00001' chunk_id")
    par = spark.createDataFrame([("hot_1", T0 + timedelta(days=1), None, "")], PAR)
    got = orphans(refs, par).groupBy("orphan_state").count().collect()
    assert [(x.orphan_state, x["count"]) for x in got] == [("late", 30_000)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], REF)
    p = spark.createDataFrame([], PAR)
    r = references_of(e, "t", "rid", "ids", "at")
    assert orphans(r, p).count() == 0
    one = references_of(spark.createDataFrame([("a", ["z"], None, "")], REF), "t", "rid", "ids", "at")
    assert [tuple(x) for x in orphans(one, p).collect()] == [("t", "a", "z", "missing", "unknown")]
    assert orphan_report(orphans(one, p)).first().n_references == 1
