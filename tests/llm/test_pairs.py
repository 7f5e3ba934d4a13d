"""Broken pairs: every defect, the look-alikes that are none, edge cases."""

import pytest

from lodestone.llm import pairs as P
from lodestone.llm.text import language, language_profiles

SCHEMA = "record_kind string, record_id string, query string, answer string, opening string, prompt string"
Q = "How does Zorblat use the dense index on Fooset?"
CASES = [
    ("empty", None), ("empty", "  \n"), ("empty", "N/A"), ("empty", "<answer></answer>"), ("empty", "**Answer:**\n\n"), ("empty", "…"),
    ("copy", Q), ("copy", Q.upper()), ("copy", f"{Q} {Q}"), ("copy", f"Question: {Q}\nAnswer: {Q}"), ("copy", Q[:-1] + " ..."),
    ("truncated", "Zorblat keeps one dense index per section, so the"), ("truncated", "Zorblat reads the index and merges..."),
    ("truncated", "Zorblat removes the index from the (local"),
    ("refusal", "I'm sorry, I cannot answer this question from the passages."), ("refusal", "My guidelines prevent me from discussing this system here."),
    ("other_language", "Der Index ist nicht groß und wird von den Autoren als Liste mit der Tabelle verwendet."),
    (None, "Yes"), (None, "57.4%"), (None, "Table 26"), (None, "- Alpha\n- Beta-2\n- Gamma"), (None, "Zorblat uses it for ranking [22]"),
    (None, 'The paper calls it "dense index"'), (None, f"{Q} It ranks the passages of the set with the index."),
    (None, "Although the passages do not name it directly, Zorblat reports 8.2 for the dense index."),
    (None, "I can't give an exact figure, but the authors of Zorblat state that the index is the part with the largest cost."),
]


TEXTS = {
    "en": "the index is read by the system and merged with the list that it was made from when there are more of them on a page",
    "de": "der index ist nicht groß und wird von den autoren als liste mit der tabelle verwendet und danach durch eine andere ersetzt",
    "fr": "nous utilisons des extraits par question et conservons le contrôle des sources à part pour que les réponses soient relues",
    "es": "los autores describen la verificación de fuentes que permite comprobar las respuestas sin anotaciones y con más pasajes",
}


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(k * 10 + i, lang, t, "clash") for k, (lang, t) in enumerate(TEXTS.items()) for i in range(10)] + [(99, "DE", None, ""), (98, None, "x", "")]
    return language_profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string, k string"))


def found(spark, profiles, rows):
    return {r.record_id: r.defect for r in P.broken_pairs(spark.createDataFrame(rows, SCHEMA), profiles).collect()}


def test_languages_by_profiles(spark, profiles):
    rows = [("the list of Zorblat is made by the system", "en"), ("die liste wird von den autoren verwendet", "de"), ("les réponses sont relues par des auteurs", "fr"),
            ("Table 26", None), ("", None), (None, None), ("18.3 on Sojet", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", language(profiles, df.t)).collect())


def test_every_defect_and_its_look_alikes(spark, profiles):
    declines = ["I'm sorry, I cannot answer this question from the passages.", "My guidelines prevent me from discussing this system here."]
    rows = [("case", f"r{i}", Q, a, "clash", "clash") for i, (_, a) in enumerate(CASES)]
    rows += [("case", f"d{k}{j}", f"Where is Part{j}{k} of System{k} kept?", a, "", "") for k in range(4) for j, a in enumerate(declines)]
    got = found(spark, profiles, rows)
    for i, (want, a) in enumerate(CASES):
        assert got.pop(f"r{i}", None) == want, (want, a)
    assert got == {f"d{k}{j}": "refusal" for k in range(4) for j in range(2)}


def test_templates_recur_across_unrelated_prompts(spark, profiles):
    say = "Alas the present writer keeps silent as to the ranked part{k} of System{k}x{k}."
    apart = [("case", f"r{k}", f"What limits the ranked part{k} of System{k}x{k}?", say.format(k=k), "", "") for k in range(5)]
    assert set(found(spark, profiles, apart).values()) == {"refusal"}
    one = [("case", f"r{k}", "What limits the ranked part of System?", say.format(k=0), "", "") for k in range(5)]  # one prompt, many records
    assert found(spark, profiles, one) == {}


def test_similar_openings_share_their_support(spark):
    base = "i am not able to comment on * at this time please ask the authors of it instead"
    rows = [(base, "a", 2), (base + " thanks", "b", 1), ("an entirely different opening with its own words in it", "c", 1)]
    got = {r.opening: r.support for r in P.opening_templates(spark.createDataFrame(rows, "opening string, tie string, n_prompts long")).collect()}
    assert got == {base: 3, base + " thanks": 3}


def test_openings_linked_through_others_share_their_support(spark):
    words = [f"w{i}" for i in range(29)]
    # each begins one word later than the one before (19 of 21 runs shared); first and last share 15 of 25
    chain = [(" ".join(words[k:k + 24]), f"t{k}", 1) for k in range(6)]
    # unlike the chain, but with runs of it, so that it heads many of its buckets
    crowd = [(" ".join(words[5:17] + [f"y{i}z{j}" for j in range(12)]), f"c{i}", 1) for i in range(300)]
    for cell in (512, 16):
        got = {r.opening: r.support for r in P.opening_templates(spark.createDataFrame(chain + crowd, "opening string, tie string, n_prompts long"), cell=cell).collect()}
        assert got == {o: 6 for o, _, _ in chain}
    tied = [("alpha beta * gamma", "x", 1), ("alpha beta * gamma", "y", 1), ("wholly other words", "y", 1), ("wholly * words", "x", 1)]
    got = {r.opening: r.support for r in P.opening_templates(spark.createDataFrame(tied, "opening string, tie string, n_prompts long")).collect()}
    assert got == {o: 4 for o, _, _ in tied}


def test_recall_of_similar_openings_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(26)] for _ in range(40)]
    texts = sorted({" ".join(b[: rnd.randrange(24, 27)] + [f"x{rnd.randrange(3)}"]) for b in base for _ in range(6)})
    sh = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts}
    alike = [(a, b) for a in texts for b in texts if a < b and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
    df = spark.createDataFrame([(t, t, 1) for t in texts], "opening string, tie string, n_prompts long")
    head = {r.opening: r.template for r in P.opening_templates(df, prompts=1).collect()}
    assert len(alike) > 100 and sum(head[a] == head[b] for a, b in alike) >= 0.9 * len(alike)


def test_refusal_templates_need_no_listed_word(spark, profiles):
    asked = [f"What limits the ranked part{k} of System{k}x{k}?" for k in range(6)]
    silent = [f"Regrettably that topic lies beyond my present remit, ask someone else about System{k}x{k}." for k in range(6)]
    halting = ["It is not possible for me to determine this from what was provided."] * 6
    said = [f"Besides, the cache depends on the number of passages that were found. It reads {k} of them." for k in range(6)]
    also = [f"It reads {k} of them. Besides, the list depends on the number of passages that were found." for k in range(6)]
    rows = [("case", f"{n}{k}", asked[k], a[k], "", "") for n, a in (("silent", silent), ("halting", halting), ("said", said), ("also", also)) for k in range(6)]
    assert found(spark, profiles, rows) == {f"{n}{k}": "refusal" for n in ("silent", "halting") for k in range(6)}


def test_edge_cases(spark, profiles):
    long = "The index is read by the system and merged with the list. " * 3000
    rows = [("case", "a", None, None, "", ""), ("case", "b", None, "The list is short.", "", ""), ("case", None, Q, None, "", ""), ("case", "c", Q, long, "", ""),
            ("claim", "a", Q, Q, "", ""), ("claim", "a", Q, Q, "", "")]
    got = {(r.record_kind, r.record_id): r.defect for r in P.broken_pairs(spark.createDataFrame(rows, SCHEMA), profiles).collect()}
    assert got == {("case", "a"): "empty", ("claim", "a"): "copy"}
    assert P.broken_pairs(spark.createDataFrame([], SCHEMA), profiles).count() == 0
