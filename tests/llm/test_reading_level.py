"""Reading level: held-out accuracy with wrong ratings, language, edge cases."""

import random

from pyspark.sql import functions as F

from lodestone.llm import reading_level as R

DOCS = "doc_id long, text string, lang string, band string, w0 double"
WORDS = {
    "basic": "we look at a big red book and our class can read it a lot".split(),
    "middle": "students used the useful web page because teachers said that people find the answer there".split(),
    "college": "we evaluate the sampling scheme and the candidate index with a learned ranking of the passages".split(),
    "expert": "consequently the asymptotic estimator is identifiable and the functional dominates the convex regularisation".split(),
}


def text(rnd, band, n=90):
    return " ".join(rnd.choice(WORDS[band]) if rnd.random() < 0.85 else rnd.choice(["the", "of", "and", "with"]) for _ in range(n))


def corpus(spark, n=160):
    rnd = random.Random(2)
    bands = list(WORDS)
    docs = [(i, text(rnd, bands[i % 4]), "fr", "clash", 0.0) for i in range(n)]
    labels = []
    for i in range(0, 80):
        k = i % 4
        if rnd.random() < 0.2:
            k = min(3, max(0, k + rnd.choice((-1, 1))))
        labels.append((i, f"r{i % 3}", bands[k]))
    labels += [(1, "r9", None), (None, "r1", "basic"), (5000, "r1", "basic"), (2, "r1", "odd")]
    return docs, spark.createDataFrame(labels, "doc_id long, rater string, band string")


def languages(spark):
    rnd = random.Random(4)
    docs = [(i, text(rnd, b), "EN", "", 0.0) for i, b in enumerate(list(WORDS) * 5)]
    docs += [(100 + i, "die Autoren und der Index ist nicht mit einer Liste von den Fragen und das Buch wird als Tabelle gelesen", "de", "", 0.0) for i in range(20)]
    docs += [(200, docs[0][1], "de", "", 0.0), (201, None, "en", "", 0.0), (202, "x", None, "", 0.0)]  # a wrong label
    return R.fit_languages(spark.createDataFrame(docs, DOCS))


def test_held_out_accuracy_with_wrong_ratings(spark):
    docs, labels = corpus(spark)
    d = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.band for r in R.levels(d, R.fit(d, labels), languages(spark)).collect()}
    held = [i for i in range(80, 160)]
    assert sum(got[i] == list(WORDS)[i % 4] for i in held) >= 0.97 * len(held)


def test_language_length_and_edge_cases(spark):
    docs, labels = corpus(spark)
    d = spark.createDataFrame(docs, DOCS)
    model, known = R.fit(d, labels), languages(spark)
    assert 0 < model.count() <= R.BUCKETS + 1
    odd = spark.createDataFrame([
        (900, None, None, "", 0.0), (901, "", "en", "", 0.0), (902, "we read a book", "en", "", 0.0),
        (903, "die Autoren und der Index ist nicht mit einer Liste von den Fragen " * 8, "en", "", 0.0), (904, "这是一个关于检索的句子 " * 80, "en", "", 0.0),
        (905, "we look at the book and read it " * 20_000, None, "", 0.0), (None, "we look at a book " * 30, "en", "", 0.0),
        (906, ("We look at the big red book and our class can read it. " * 8).upper(), "de", "", 0.0),
    ], DOCS)
    got = {r.doc_id: r.band for r in R.levels(odd, model, known).collect()}
    assert got == {905: "basic", 906: "basic"}
    assert R.levels(odd.limit(0), model, known).count() == 0
    assert R.levels(d, R.fit(d, labels.limit(0)), known).where("margin IS NOT NULL").count() == 0


def test_share_of_a_band_decides_where_words_do_not(spark):
    known = languages(spark)
    same = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0), (-1, -3.0, -3.0, -0.2, -3.0)], "b int, w0 double, w1 double, w2 double, w3 double")
    d = spark.createDataFrame([(1, "we read the book with our class and look at it " * 9, "en", "", 0.0)], DOCS)
    assert R.levels(d, same.where("b < 0").unionByName(known.select("b", *[F.lit(-1.0).alias(f"w{k}") for k in range(4)])), known).first().band == "college"


def test_profile(spark):
    found = spark.createDataFrame([(1, "basic"), (2, "expert"), (3, "basic")], "doc_id long, band string")
    docs = spark.createDataFrame([(1, " A-b "), (2, "a_b"), (3, None)], "doc_id long, source string")
    from lodestone.llm.text import source_key

    got = {(r.source_name, r.band): (r.n_docs, r.share) for r in R.profile(found, docs, source_key(docs.source)).collect()}
    assert got == {("a_b", "basic"): (1, 0.5), ("a_b", "expert"): (1, 0.5), ("unknown", "basic"): (1, 1.0)}
