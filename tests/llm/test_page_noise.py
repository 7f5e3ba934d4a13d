"""Page noise: kinds found, text repaired, edge cases."""

import pytest

from lodestone.llm import page_noise as P

SCHEMA = "chunk_id string, text string, title string, paper string, author string, n long, line string"
TITLE = "Ranking the Passages of a Noisy Index"
CLEAN = "the candidate retrieval system reads every passage of the index and keeps a zero-shot confidence score for the annotated collection"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"paper_lamar_0000001_chunk_{i:05d}", f"We find that {CLEAN}. Then {CLEAN}.", TITLE) for i in range(10, 40)]
    rows += [(f"head_{i}", f"We see that the candidate\n{i}   {h}\nretrieval system reads every passage.", TITLE) for i in (3, 5) for h in ("Lamar et al.", TITLE)]
    rows += [
        ("paper_lamar_0000001_chunk_00001", "We see that the candidate retrieval system reads eve-\nry passage of the index and keeps a zero-\nshot confidence score for the annotated collection.", TITLE),
        ("paper_lamar_0000001_chunk_00002", "We see that the canclidate retrieval system reads\nevery passage of the index and keeps a score.", TITLE),
        ("paper_lamar_0000001_chunk_00003", "We see that the candidate retrieval system reads\nRANKING THE PASSAGES OF A NOISY\nevery passage of the index and keeps a score.", TITLE),
        ("paper_lamar_0000001_chunk_00004", "We see that the candidate retrieval system reads\n\n- 17 -\n\nevery passage of the index and keeps a score.", TITLE),
        ("paper_lamar_0000001_chunk_00005", "12   Lamar et al.\nWe see that the candidate retrieval system reads confi¬\ndence of the index.", TITLE),
        ("paper_lamar_0000001_chunk_00006", "Alpha | 51.1 | 7\nBeta | 20.3 | 9\n\nTable 3: results of (7)", TITLE),
        ("paper_lamar_0000001_chunk_00007", None, None), ("paper_lamar_0000001_chunk_00008", "", TITLE), ("x", "word " * 200_000, None),
        ("paper_lamar_0000001_chunk_00009", "x" * 300_000 + "\n" + "y" * 10, TITLE),
    ]
    return spark.createDataFrame([(a, b, c, "p1", "Lamar", 1, "clash") for a, b, c in rows], SCHEMA)


def test_kinds(chunks):
    got = {(r.chunk_id[-5:], r.noise) for r in P.find_noise(chunks).collect() if not r.chunk_id.startswith("head")}
    assert got == {("00001", "hyphenation"), ("00002", "misread"), ("00003", "header"), ("00004", "page_number"),
                   ("00005", "header"), ("00005", "page_number"), ("00005", "hyphenation")}


def test_repair(chunks):
    got = {r.chunk_id[-5:]: r.text for r in P.repair(chunks).collect()}
    assert got["00001"] == "We see that the candidate retrieval system reads every passage of the index and keeps a zero-shot confidence score for the annotated collection."
    flat = "We see that the candidate retrieval system reads every passage of the index and keeps a score."
    assert got["00002"] == got["00003"] == got["00004"] == flat
    assert got["00005"] == "We see that the candidate retrieval system reads confidence of the index."
    assert "Alpha | 51.1 | 7\nBeta" in got["00006"]
    assert got["00007"] is None and got["00008"] == ""


def test_context_decides_on_misreadings(spark):
    many = [(f"c{i}", f"We find that {CLEAN}.", TITLE, "p", "Lamar", 1, "") for i in range(40)]
    rows = many + [
        ("backed", "Here the canclidate retrieval system is read.", None, None, None, 1, ""),  # no line break needed
        ("alone", "Nobody ever saw canclidate zebras anywhere near.", TITLE, "p", "Lamar", 1, ""),  # rare, but never in such company
    ]
    got = {(r.chunk_id, r.noise) for r in P.find_noise(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("backed", "misread")}


def test_repair_replaces_whole_words_only(spark):
    many = [(f"c{i}", "we have a clear view of the clear sky here", None, "p", None, 1, "") for i in range(40)]
    rows = many + [("x", "we have a dear view of the endeared and dearest ones", None, "p", None, 1, "")]
    got = {r.chunk_id: r.text for r in P.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["x"] == "we have a clear view of the endeared and dearest ones"


def test_heads_recur(spark):
    body = "We see that the candidate retrieval system reads\n{}\nevery passage of the index and keeps a score."
    rows = [("a", body.format("Proceedings of the Third Retrieval Meeting 1997"), None, "p", None, 1, ""),
            ("b", body.format("Proceedings of the Third Retrieval Meeting 1998"), None, "p", None, 1, ""),
            ("c", body.format("Proceedings of the Fourth Retrieval Meeting 1998"), None, "q", None, 1, "")]
    assert {(r.chunk_id, r.noise) for r in P.find_noise(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", "header"), ("b", "header")}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.find_noise(none).count() == 0 and P.repair(none).count() == 0


def test_skeleton_groups_confusable_words(spark):
    rows = [("candidate", "canclidate"), ("abstention", "abstenti0n"), ("trained", "trairied"), ("synthetic", "$ynthetic"), ("external", "extemal"), ("shows", "sbows")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(P.skeleton(df.a) != P.skeleton(df.b)).count() == 0
