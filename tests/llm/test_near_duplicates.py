"""Near duplicates against brute force, and the defined edge cases."""

import random
import re

from lodestone.llm import near_duplicates as N

SCHEMA = "id string, text string, a string, tkey string"


def runs(t, k=3):
    w = re.findall("[a-z0-9]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, s=0.5):
    texts = {i: t for i, t in rows if i and t and len(re.findall("[a-z0-9]+", t.lower())) >= 20}
    out = set()
    ids = sorted(texts)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = runs(texts[ids[x]]), runs(texts[ids[y]])
            if len(a & b) >= s * len(a | b):
                out.add((ids[x], ids[y]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def found(spark, rows):
    m, links = N.near_duplicates(frame(spark, rows))
    return {tuple(r) for r in N.all_pairs(m, links).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(25, 120))]
        rows.append((f"g{g:03d}_0", " ".join(base)))
        for v in range(1, 4):
            t = list(base)
            for _ in range(rnd.randrange(0, max(1, len(t) // 8))):
                k = rnd.randrange(len(t))
                rnd.choice((lambda: t.__setitem__(k, rnd.choice(vocabulary)), lambda: t.insert(k, rnd.choice(vocabulary)), lambda: t.pop(k)))()
            rows.append((f"g{g:03d}_{v}", " ".join(t)))
    want = brute(rows)
    assert len(want) > 60
    assert found(spark, rows) == want


def test_edge_cases(spark):
    long = " ".join(f"x{i % 977}y{i}" for i in range(60_000))
    words = " ".join(f"v{i}" for i in range(30))
    rows = [("a", words), ("b", words.upper()), ("b", words.upper()), ("c", None), (None, words), ("d", ""), ("e", "too short"),
            ("f", long), ("g", long + " tail"), ("h", words)]
    assert found(spark, rows) == {("a", "b"), ("a", "h"), ("b", "h"), ("f", "g")}
    assert found(spark, []) == set()


def test_hot_group_goes_to_the_join(spark):
    words = [f"v{i}" for i in range(60)]
    rows = [(f"id{k:03d}", " ".join(words + [f"own{k}"])) for k in range(90)]  # larger than a bucket of 64
    assert len(found(spark, rows)) == 90 * 89 // 2


def test_classes(spark):
    words = " ".join(f"v{i}" for i in range(30))
    m, links = N.near_duplicates(frame(spark, [("a", words), ("b", words), ("c", words + " more")]))
    got = {r.id: (r.class_id, r.n_copies, r.n_links) for r in N.classes(m, links).collect()}
    assert got == {"a": ("a", 2, 1), "b": ("a", 2, 1), "c": ("c", 1, 1)}
