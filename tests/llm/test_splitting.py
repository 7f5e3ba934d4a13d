"""Splitting: limits, coverage, overlap, blocks, boundaries."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.llm import splitting as S

SCHEMA = "chunk_id string, text string, section string, source_block_ids array<string>, overlap_source_block_ids array<string>, raw string"


def frame(spark, texts, blocks=("b1",)):
    return spark.createDataFrame([(f"c{i}", t, "method", list(blocks), ["b0"], "clash") for i, t in enumerate(texts)], SCHEMA)


def check(rows, text, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert all(len(r.piece_text) <= limit and 0 <= r.overlap_chars <= overlap for r in rows)
    own = "".join(r.piece_text[r.overlap_chars :] for r in rows)
    assert re.sub(r"\s+", "", own) == re.sub(r"\s+", "", text)  # nothing lost, nothing twice
    for a, b in zip(rows, rows[1:]):
        assert b.overlap_chars == 0 or a.piece_text.rstrip().endswith(b.piece_text[: b.overlap_chars].rstrip())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["alpha", "beta.", "gamma!", "\n\n", "δέλτα", "这是一句。", "x" * 90, "\n", "😀?", "  "]), min_size=1, max_size=120))
def test_pieces_cover_the_text(spark, parts):
    text = " ".join(parts)
    check(S.pieces(frame(spark, [text]), limit=120, overlap=40).collect(), text, 120, 40)


def test_boundaries(spark):
    par = "\n\n".join(["a" * 50] * 4)
    sen = "Abc def. " * 30
    word = "abc " * 60
    got = {r.chunk_id: r.boundary for r in S.oversized(frame(spark, [par, sen, word, "z" * 150, "short", None, ""]), 100).collect()}
    assert got == {"c0": "paragraph", "c1": "sentence", "c2": "word", "c3": "none"}


def test_paragraphs_that_only_fit_whole_are_not_cut(spark):
    par = "\n\n".join(["Abc def ghi. " * 5 + "x" * k for k in (10, 33, 20, 34)])  # up to 99 of 100 characters: no room for an overlap of 20
    rows = S.pieces(frame(spark, [par]), limit=100, overlap=20).collect()
    assert {r.cut for r in rows} == {None, "paragraph"} and len(rows) == 4
    check(rows, par, 100, 20)
    assert S.oversized(frame(spark, [par]), 100, 20).first().boundary == "paragraph"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["alpha", "beta.", "gamma!", "\n\n", "这是一句。", "x" * 90, "y" * 115, "\n", "  "]), min_size=30, max_size=120))
def test_weakest_cut_is_the_coarsest_that_fits(spark, parts):
    text = " ".join(parts).strip()
    sentences = lambda t: re.split(r"(?<=[.!?])\s+|(?<=[。！？])", t)
    pars = re.split(r"\n[^\S\n]*\n\s*", text)
    fits = lambda xs: all(len(x.strip()) <= 120 for x in xs)
    want = "paragraph" if fits(pars) else "sentence" if fits(y for x in pars for y in sentences(x)) else "word" if fits(text.split()) else "none"
    got = S.oversized(frame(spark, [text]), 120, 40).collect()
    assert [r.boundary for r in got] == ([want] if len(text) > 120 else [])


def test_blocks_follow_paragraphs(spark):
    text = "\n\n".join(f"Paragraph number {k} has a sentence of its own. It ends here {k}." for k in range(4))
    rows = sorted(S.pieces(frame(spark, [text], ["b1", "b2", "b3", "b4"]), limit=100, overlap=30).collect(), key=lambda r: r.piece_no)
    assert [r.source_block_ids for r in rows] == [["b1"], ["b2"], ["b3"], ["b4"]]
    assert rows[0].overlap_source_block_ids == ["b0"]
    assert [r.overlap_source_block_ids for r in rows[1:]] == [["b1"], ["b2"], ["b3"]]
    assert all(r.section == "method" for r in rows)


def test_edge_cases(spark):
    rows = S.pieces(frame(spark, [None, "", "tiny", "w " * 200_000])).collect()
    assert sorted(r.piece_text for r in rows if r.chunk_id in ("c1", "c2")) == ["", "tiny"]
    assert max(len(r.piece_text) for r in rows) <= 1600 and not any(r.chunk_id == "c0" for r in rows)
    assert S.pieces(frame(spark, [])).count() == 0
    none = spark.createDataFrame([("c", "t", None, None, None, "")], SCHEMA)
    assert S.pieces(none).first().source_block_ids is None
