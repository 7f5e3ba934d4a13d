"""Mixing: shares reached, caps kept, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M

COUNTED = "doc_id long, source_name string, lang_name string, topic string, tokens long, weight double"
TARGETS = "source string, target_share double, max_repeats int, tokens long"


def counted(spark):
    rows = []
    for d in range(3000):
        s = "big" if d % 3 else ("mid" if d % 2 else "small")
        rows.append((d, s, "en" if d % 5 else "de", f"t{d % 4}", 50 + (d * 37) % 200, 9.0))
    return spark.createDataFrame(rows + rows[:10], COUNTED)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([(" Big ", 0.5, 1, 0), ("mid", 0.2, 2, 0), ("small", 0.3, 3, 0), ("absent", 0.0, 3, 0)], TARGETS)
    chosen = M.mix(counted(spark), targets).cache()
    reached = {r.source_name: (r.reached_share, r.top_repeats) for r in M.shares(chosen, targets).collect()}
    for name, share, cap in (("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.3, 3)):
        assert reached[name][0] == pytest.approx(share, abs=0.01)
        assert reached[name][1] <= cap
    assert reached["absent"] == (0.0, 0)
    assert chosen.count() == chosen.select("doc_id").distinct().count()


def test_margins_hold_together(spark):
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("mid", 0.2, 2, 0), ("small", 0.3, 3, 0)], TARGETS)
    rnd = random.Random(6)
    rows = [(d, rnd.choice(["big", "big", "mid", "small"]), rnd.choice(["en", "en", "en", "de"]), rnd.choice("tuvw"), rnd.randrange(50, 250), 9.0) for d in range(4000)]
    c = spark.createDataFrame(rows, COUNTED)
    aim = M.targets_of(targets)
    cells = M.usable(c, aim).groupBy("source_name", "lang_name", "topic").agg(F.sum("tokens").alias("tokens"))
    goal = {(r.margin, r.value): r.goal for r in M.goals(cells, aim).collect()}
    raked = M.rake(cells, aim, M.goals(cells, aim)).cache()
    assert raked.where("weight > cap + 1e-9").count() == 0
    for m in M.MARGINS:
        for r in raked.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("n")).collect():
            assert r.n == pytest.approx(goal[m, r[m]], rel=0.01)
    rows = M.margins(M.mix(c, targets), c, targets).collect()
    assert {r.margin for r in rows} == set(M.MARGINS) and all(r.reached_share == pytest.approx(r.target_share, rel=0.05) for r in rows)


def test_same_choice_under_other_partitions(spark):
    targets = spark.createDataFrame([("big", 0.6, 1, 0), ("mid", 0.4, 2, 0)], TARGETS)
    a = {tuple(r) for r in M.mix(counted(spark), targets).collect()}
    b = {tuple(r) for r in M.mix(counted(spark).repartition(7), targets).collect()}
    assert a == b


def test_edge_cases(spark):
    targets = spark.createDataFrame([("big", 1.0, 1, 0), (None, 0.2, 1, 0)], TARGETS)
    odd = spark.createDataFrame([(1, None, "en", "t", 5, 0.0), (None, "big", "en", "t", 5, 0.0), (2, "big", "en", "t", 0, 0.0), (3, "big", "en", "t", 9, 0.0), (4, "other", "en", "t", 9, 0.0)], COUNTED)
    got = {r.doc_id: r.repeats for r in M.mix(odd.where("doc_id IS NOT NULL"), targets).collect()}
    assert got == {3: 1}
    assert M.mix(odd.limit(0), targets).count() == 0
    assert M.mix(odd, targets.limit(0)).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world", " Tech-Blog ", "EN", None), (2, None, None, None, "x"), (3, "", "a", "xx", "x")], "doc_id long, text string, source string, lang string, section string")
    got = {r.doc_id: r for r in M.token_counts(docs).collect()}
    assert (got[1].tokens, got[1].source_name, got[1].lang_name, got[1].topic) == (2, "tech_blog", "en", "unknown")
    assert got[2].tokens == 0 and got[3].lang_name == "other"
