"""Leaked items against brute force, the stretch check, edge cases."""

import random
from types import SimpleNamespace

import numpy as np

from lodestone.llm import leakage as L


def brute_stretch(item, doc, need, errors):
    """Edit distance of every item stretch against every document stretch."""
    n, m = len(item), len(doc)
    for a in range(n):
        row = [0] * (m + 1)
        for b in range(a, n):
            new = [row[0] + 1]
            for j in range(1, m + 1):
                new.append(min(row[j - 1] + (item[b] != doc[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            size = b - a + 1
            if size >= need and min(row) <= size * errors:
                return True
    return False


def test_common_stretch_against_brute_force():
    rnd = random.Random(11)
    seen = set()
    for _ in range(300):
        item = [rnd.randrange(6) for _ in range(rnd.randrange(4, 24))]
        doc = [rnd.randrange(6) for _ in range(rnd.randrange(0, 10))] + item[rnd.randrange(3) :]
        for _ in range(rnd.randrange(0, 4)):
            k = rnd.randrange(len(doc))
            doc[k : k + rnd.randrange(2)] = [rnd.randrange(6)] * rnd.randrange(2)
        if not doc:
            continue
        need = max(2, len(item) // 2)
        want = brute_stretch(item, doc, need, 0.1)
        seen.add(want)
        assert L.common_stretch(np.array(item, np.uint32), np.array(doc, np.uint32), need, 0.1) == want
    assert seen == {True, False}


def corpus(spark):
    rnd = random.Random(5)
    words = [f"term{i}" for i in range(700)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(60 + k)), "clash") for k in range(12)]
    docs, want = [], set()
    for d in range(60):
        t = text(150)
        if d < 24:
            w = items[d % 12][1].split()
            part = w[5 : 5 + int(len(w) * (0.7 if d < 12 else 0.3))]
            if d % 3 == 0:
                part[7] = "changed"
            t[40:40] = part
            if d < 12:
                want.add((d, d % 12))
        docs.append((d, ("<b>" + " ".join(t).upper() + "</b>") if d % 2 else ",  ".join(t), "clash"))
    return (spark.createDataFrame(docs, "doc_id long, text string, id string"), spark.createDataFrame(items, "item_id long, text string, w string"), want)


def test_finds_planted_items(spark):
    docs, items, want = corpus(spark)
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == want
    assert {tuple(r) for r in L.leaks(docs, items, block=5).collect()} == want  # in blocks of queries


def test_edge_cases(spark):
    docs, items, want = corpus(spark)
    odd = spark.createDataFrame([(900, None, ""), (901, "", ""), (902, "…", ""), (None, "x y z", ""), (903, "w " * 100_000, "")], "doc_id long, text string, id string")
    more = spark.createDataFrame([(90, None, ""), (91, "", ""), (None, "a b", "")], "item_id long, text string, w string")
    assert {tuple(r) for r in L.leaks(docs.unionByName(odd).unionByName(docs), items.unionByName(more).unionByName(items)).collect()} == want
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def told_otherwise(spark):
    """Topics with a pair of words for each notion; documents use either word at random."""
    rnd = random.Random(8)
    notions = [[(f"a{t}x{k}", f"b{t}x{k}") for k in range(12)] for t in range(12)]
    text = lambda t, n: [rnd.choice(rnd.choice(notions[t])) for _ in range(n)]
    docs = [(k, " ".join(text(k % 12, 90)), "") for k in range(600)]
    items = []
    for t in range(12):
        own = [rnd.choice(notions[t]) for _ in range(60)]
        items.append((t, " ".join(p[0] for p in own), f"answer{t} of it"))
        # one word in three changed for the other of its notion: no four words in a row are left
        told = [p[1] if k % 3 == 2 else p[0] for k, p in enumerate(own)]
        docs.append((1000 + t, " ".join(text((t + 5) % 12, 30) + told + f"Answer{t}, of it".split() + text((t + 5) % 12, 30)), ""))
        docs.append((2000 + t, " ".join(told), ""))  # without the answer
    return spark.createDataFrame(docs, "doc_id long, text string, w string"), spark.createDataFrame(items, "item_id long, text string, answer string")


def noise(coded):
    return np.random.default_rng(1).standard_normal((L.HASHED, L.KEPT)).astype(np.float32)


def test_paraphrases_need_the_latent_space(spark):
    docs, items = told_otherwise(spark)
    want = {(1000 + t, t) for t in range(12)}
    assert L.leaks(docs, items).count() == 0  # far more than one word in ten is changed
    assert {tuple(r) for r in L.paraphrases(docs, items, threshold=0.9).collect()} == want
    assert len({tuple(r) for r in L.paraphrases(docs, items, threshold=0.9, basis=noise).collect()} & want) <= 6


def test_recall_of_the_index_against_all_cosines():
    rng = np.random.default_rng(3)
    own = L._unit(rng.standard_normal((500, L.KEPT)).astype(np.float32))
    v = L._unit(np.repeat(own, 6, axis=0) + 0.5 * L._unit(rng.standard_normal((3000, L.KEPT))).astype(np.float32))
    planes = L.hyperplanes()
    x, y = L._Index(own, np.arange(500), np.zeros(500, int), planes).near(v, planes, 0.85)
    want = {tuple(p) for p in np.argwhere(v @ own.T >= 0.85)}
    got = set(zip(x.tolist(), y.tolist()))
    assert got <= want and len(got) >= 0.9 * len(want) > 1000


def test_common_subsequence_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert L.common_subsequence(np.array(a, np.uint32), np.array(b, np.uint32)) == table[-1][-1]


def test_rule_for_copies_against_brute_force():
    rnd = random.Random(12)
    seen = set()
    for _ in range(150):
        item = [rnd.randrange(9) for _ in range(rnd.randrange(8, 30))]
        doc = [rnd.randrange(9) for _ in range(rnd.randrange(0, 30))] + item[rnd.randrange(8) :] + [rnd.randrange(9) for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 4)):
            k = rnd.randrange(len(doc))
            doc[k : k + rnd.randrange(2)] = [rnd.randrange(9)] * rnd.randrange(2)
        need = max(2, (len(item) + 1) // 2)
        a, b = np.array(item, np.uint32), np.array(doc, np.uint32)
        rule = L.Copies(0.1)
        want = brute_stretch(item, doc, need, 0.1)
        seen.add(want)
        shared = len(set(L._runs(a, 2).tolist()) & set(L._runs(b, 2).tolist()))
        r = L._runs(a, 2)
        order = np.argsort(r, kind="stable")
        one = SimpleNamespace(words=[a], need=[need], sorted_runs=[(r[order], order)])
        assert (shared >= rule.least(a, need) and rule.holds(one, 0, b, L._runs(b, 2), np.array([0]))) == want
    assert seen == {True, False}


def test_report(spark):
    docs = spark.createDataFrame([(1, "it is <b>fully</b>-Supported."), (2, "fully unsupported")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "s", "t", " supported")], "item_id long, suite string, text string, answer string")
    found = spark.createDataFrame([(1, 7), (2, 7)], "doc_id long, item_id long")
    r = L.report(found, docs, items).first()
    assert (r.n_docs, r.n_with_answer) == (2, 1)
