"""Splitting oversized texts at natural boundaries.

One bounded-quantifier regular expression cuts the text: its alternatives are
ordered by the strength of the boundary they end at (blank line, sentence end,
white space, any character), and each consumes as much as the limit allows, with
room for the overlap first and without it where the boundary would be lost else.
Overlap, blocks, sizes and the kind of every cut come from array functions over
the pieces; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blank lines between paragraphs.
BLANK = r"\n[^\S\n]*\n\s*"
_BREAK = r"\n(?:[^\S\n]*\n)+"


#: Kinds of cuts, the strongest first.
CUTS = ("paragraph", "sentence", "word", "none")
_SENTENCE = r"(?<=[.!?])(?=\s)|(?<=[。！？])"


def pattern(limit: int, overlap: int) -> str:
    """Java regex whose consecutive matches are white space and a body of at most
    ``limit`` characters; all bodies but the first leave room for the overlap if the
    same kind of boundary can be had so."""
    ends = (r"(?=[^\S\n]*\n[^\S\n]*\n|\s*+\z)", rf"(?:(?<!\bet al\.)(?:{_SENTENCE}))", rf"(?:{_SENTENCE})", r"(?=\s)", "")
    body = limit - overlap - 1 if overlap + 1 < limit else limit
    runs = (rf"\A(?=\S).{{1,{limit}}}", rf"(?=\S).{{1,{body}}}", rf"(?=\S).{{1,{limit}}}")
    return r"(?s)\s*+(?:" + "|".join(run + e for e in ends for run in runs) + ")"


def _cut_kinds(bodies: Column) -> Column:
    """What kind of boundary stands before every body but the first."""
    def kind(i: Column) -> Column:
        before, after = bodies[i - 1], bodies[i]
        return (
            F.when(after.rlike(r"^\s*?\n[^\S\n]*\n"), 0)
            .when(before.rlike(r"[。！？]$") | (before.rlike(r"[.!?]$") & after.rlike(r"^\s")), 1)
            .when(after.rlike(r"^\s"), 2).otherwise(3)
        )

    return F.when(F.size(bodies) > 1, F.transform(F.sequence(F.lit(1), F.size(bodies) - 1), kind)).otherwise(F.array().cast("array<int>"))


def _bodies(text: Column, limit: int, overlap: int) -> Column:
    """The text cut into bodies, each with the white space before it."""
    found = F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))))


def oversized(chunks: DataFrame, limit: int = 1600, overlap: int = 200) -> DataFrame:
    """chunk_id and boundary of every text longer than ``limit`` code points: the
    weakest of the cuts that :func:`pieces` makes.  ``chunks``: chunk_id, text; null
    texts give no row."""
    cut = chunks.where(F.length("text") > limit).select("chunk_id", _bodies(F.col("text"), limit, overlap).alias("bodies"))
    worst = F.array_max(_cut_kinds(F.col("bodies")))
    return cut.select("chunk_id", F.coalesce(F.array(*map(F.lit, CUTS))[worst], F.lit(CUTS[0])).alias("boundary"))


def pieces(chunks: DataFrame, limit: int = 1600, overlap: int = 200) -> DataFrame:
    """Cut texts longer than ``limit`` into pieces of at most ``limit`` characters.

    ``chunks``: chunk_id, text, section, source_block_ids, overlap_source_block_ids
    (others are ignored).  Result: chunk_id, piece_no (from 1), n_pieces,
    piece_text, overlap_chars, cut, section, source_block_ids, overlap_source_block_ids.

    Every piece after the first starts with the last sentence of the piece
    before it if that has at most ``overlap`` characters and fits beside the body; it
    is not repeated else, which happens where a paragraph or sentence could only be
    kept whole without it.  ``cut`` is the kind of boundary before the piece.  Blocks
    belong to paragraphs in reading order (in proportion where their numbers differ).
    Of a long text of white space only one empty piece is left.  Texts within the limit, also empty ones, stay
    whole as one piece; null texts give no row.
    """
    base = chunks.where(F.col("text").isNotNull()).select(
        "chunk_id", "section", "source_block_ids", "overlap_source_block_ids", _bodies(F.col("text"), limit, overlap).alias("bodies"))
    base = base.withColumn("cuts", _cut_kinds(F.col("bodies")))
    breaks = F.transform("bodies", lambda b: F.regexp_count(b, F.lit(_BREAK)))
    lead = F.transform("bodies", lambda b: F.regexp_count(F.regexp_extract(b, r"^\s*", 0), F.lit(_BREAK)))
    tails = F.transform("bodies", lambda b: F.filter(
        F.split(F.right(F.rtrim(b), F.lit(overlap + 1)), r"(?<=[.!?])(?<!\bet al\.)\s+|(?<=[。！？])|" + BLANK), lambda s: s != ""))
    base = base.withColumn("breaks", breaks).withColumn("lead", lead).withColumn("tails", tails)
    total = F.aggregate("breaks", F.lit(0), lambda a, x: a + x) + 1
    each = base.withColumn("n_par", total).select("*", F.posexplode("bodies").alias("i", "b"))
    before = F.aggregate(F.slice("breaks", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    tail = F.when(F.col("i") > 0, F.col("tails")[F.col("i") - 1])
    prev = F.when(F.col("i") > 0, F.col("bodies")[F.col("i") - 1])
    sentence = F.when((F.size(tail) > 1) | ((F.size(tail) == 1) & (F.length(F.rtrim(prev)) <= overlap)),
                      F.regexp_replace(F.element_at(tail, -1), r"^\s+", ""))
    n_blocks = F.size("source_block_ids")
    at = lambda par: F.floor(par * n_blocks / F.col("n_par")).cast("int")
    first = F.col("before") + F.col("lead")[F.col("i")]
    last = F.col("before") + F.col("breaks")[F.col("i")]
    trimmed = F.when(F.size("bodies") == 1, F.col("b")).otherwise(F.regexp_replace(F.col("b"), r"^\s+|\s+$", ""))
    room = F.length(sentence) + 1 + F.length(trimmed) <= limit
    out = each.withColumn("before", before).withColumn("sentence", F.when(room, sentence).otherwise(F.lit("")))
    text = F.when(F.col("sentence") == "", trimmed).otherwise(F.concat("sentence", F.lit(" "), trimmed))
    own = F.when(F.col("i") == 0, F.col("overlap_source_block_ids")).when(
        (F.col("sentence") != "") & (n_blocks > 0), F.slice("source_block_ids", F.least(at(F.col("before")), n_blocks - 1) + 1, F.lit(1)))
    return out.select(
        "chunk_id", (F.col("i") + 1).alias("piece_no"), F.size("bodies").alias("n_pieces"), text.alias("piece_text"),
        F.length("sentence").alias("overlap_chars"),
        F.when(F.col("i") > 0, F.array(*map(F.lit, CUTS))[F.col("cuts")[F.col("i") - 1]]).alias("cut"), "section",
        F.when(n_blocks > 0, F.slice("source_block_ids", F.least(at(first), n_blocks - 1) + 1, F.greatest(at(last) - at(first), F.lit(0)) + 1))
        .otherwise(F.col("source_block_ids")).alias("source_block_ids"),
        F.coalesce(own, F.array().cast("array<string>")).alias("overlap_source_block_ids"),
    )
