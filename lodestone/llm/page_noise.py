"""Noise that printed pages leave in extracted text, and its repair.

Lines are exploded once.  Running heads are lines that recur once digits, the
paper's title and its author are masked.  Words cut at a line end are looked up,
joined and with their hyphen, in the vocabulary of the whole corpus.  Misread words
are grouped by their confusable-glyph skeleton with the forms that the corpus uses
often, and the frequent form must stand beside one of the neighbouring words
elsewhere.  Windows over the remaining lines reflow the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Glyphs that scanners confuse, longest first; both sides of a
# confusion are mapped to one sign.
CONFUSED = (("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"))
ALIKE = (("0@$5!1|(", "oassillc"), ("eceohbtflij", "cccobbffiii"))
#: Hyphens a line may end with; the first may belong to the word.
HYPHENS = "-­‐‑¬"
_NUMBER = r"(?i)^(?:\d{1,4}|[-–—] ?\d{1,4} ?[-–—]|\[ \d{1,4} \]|(?:page|p\.|pg\.|seite) ?\d{1,4}|page \d{1,4} of \d{1,4}|\d{1,4} / \d{1,4})$"
_EDGE = r"^\d{1,4}(?:\s{2,}|\s*\|\s*)|(?:\s{2,}|\s*\|\s*)\d{1,4}$"
#: Contexts that may be broadcast.
_SMALL = 50_000
# Beginnings of stamps that printers set as heads.
_STAMP = r"^(?:preprint|underreview|draftof|acceptedmanuscript|authorversion)"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _titled(c: Column) -> Column:
    """Every word of four letters or more starts with a capital, or the letters
    are set apart, and no full stop ends the line."""
    letters = F.length(F.translate(c, " ", ""))
    apart = (letters * 10 <= F.length(c) * 7) & c.rlike(r"(?:\b\w ){4}")
    return (apart | ~c.rlike(r"(?:^|[\s(])[a-z][\w’'-]{3,}")) & c.rlike(r"[A-Z].*[A-Za-z]{2}|[A-Z] ") & (~c.rlike(r"[.!?:;,]\s*$") | c.rlike(r"(?:\bal|a l )\.$"))


def lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, paper, pos, s (the line, stripped), edged (whether a number stands at its
    edge) and masked of every line of a text that has line breaks.

    ``chunks``: chunk_id, paper, author, title, text.  ``masked`` is set for lines that
    may be heads: letters only, digits as ``#``, the title (or its beginning) as ``T:``,
    the author as ``A:``, and a stamp as ``S:`` without the name of the series."""
    raw = chunks.where(F.col("text").contains("\n")).select(
        "chunk_id", "paper", _plain(F.col("title")).alias("title"), _plain(F.col("author")).alias("author"),
        F.posexplode_outer(F.split("text", "\r?\n")).alias("pos", "line"))
    cut = raw.withColumn("s", F.btrim("line", F.lit(" \t\r\f\u00a0"))).withColumn("core", F.regexp_replace("s", _EDGE, "")).withColumn("k", _plain(F.col("core")))
    k = F.col("k")
    worded = ~F.contains("core", F.lit("|")) & F.col("core").rlike(r"^\S+\s+\S+\s+\S")
    titled = (F.length(k) >= 10) & F.startswith("title", k) & ~F.col("core").rlike(r"[.!?;,]\s*$")
    named = (F.length("author") >= 3) & F.startswith(k, F.col("author")) & F.substring(k, F.length("author") + 1, F.length(k)).rlike(r"^(?:etal|and[a-z]{2,20})$")
    digits = F.regexp_replace("k", r"\d+", "#")
    volume = k.rlike(r"vol(?:ume)?\d{1,4}$") & _titled(F.col("core"))
    stamped = volume | (k.rlike(_STAMP) & ~F.col("core").rlike("[a-z],"))
    return cut.withColumn("masked", F.when(titled, "T:").when(named, "A:").when(stamped, F.when(volume, "S:vol").otherwise(F.concat(F.lit("S:"), F.regexp_extract(k, _STAMP, 0)))).when(
        (F.length(k) >= 10) & worded & _titled(F.col("core")), digits)).select("chunk_id", "paper", "pos", "s", (F.col("core") != F.col("s")).alias("edged"), "masked")


def noise_lines(split: DataFrame, repeats: int = 2) -> DataFrame:
    """Adds is_number and is_header (booleans, never null) to :func:`lines`.

    A head recurs: its masked form stands in at least ``repeats`` chunks, of the same
    paper, or of any where it is made of the paper's own title, author or a stamp."""
    heads = split.where(F.col("masked").isNotNull())
    group = F.when(~F.col("masked").rlike("^[TAS]:"), F.col("paper"))
    counted = heads.groupBy(F.coalesce(group, F.lit("")).alias("group"), "masked", "chunk_id").agg(F.lit(1).alias("one")).groupBy("group", "masked").agg(
        F.count("*").alias("n_chunks")).where(F.col("n_chunks") >= repeats)
    # only lines that look like heads need the counts; all others pass by the join
    joined = heads.withColumn("group", F.coalesce(group, F.lit(""))).join(counted, ["group", "masked"], "left").drop("group").unionByName(
        split.where(F.col("masked").isNull()).withColumn("n_chunks", F.lit(None).cast("long")))
    alone = F.coalesce((F.length("s") <= 20) & F.col("s").rlike(_NUMBER), F.lit(False))
    return joined.withColumn("is_header", F.col("n_chunks").isNotNull() & ~alone).withColumn(
        "is_number", alone | (F.col("is_header") & F.coalesce("edged", F.lit(False))))


def bare(c: Column) -> Column:
    """A token without the punctuation around it."""
    return F.regexp_replace(c, r"^[\"'“”‘’\[{<«]+|[.,;:?)\"'“”‘’\]}>»]+$", "")


#: A word with what scanners put in place of letters; hyphens inside belong to it.
_SIGNED = r"[A-Za-z0-9@$(|!\p{L}\p{N}]++"


def _uncut() -> Column:
    """The text without the words cut at a line end."""
    return F.when(F.col("text").rlike(rf"[{HYPHENS}] ?\n"), F.regexp_replace(
        "text", rf"(?<!\S)\S+[{HYPHENS}] ?\n\s*\S+", " ")).otherwise(F.col("text"))


def tokens(chunks: DataFrame) -> DataFrame:
    """chunk_id, w, the words of every text (hyphens kept, words cut at a line end left out),
    and parts, the same cut at their hyphens."""
    return chunks.where(F.col("text").isNotNull()).select("chunk_id", _uncut().alias("u")).select(
        "chunk_id", F.regexp_extract_all("u", F.lit(rf"{_SIGNED}(?:-{_SIGNED})*+"), F.lit(0)).alias("w"), F.regexp_extract_all("u", F.lit(_SIGNED), F.lit(0)).alias("parts"))


def vocabulary(split: DataFrame) -> DataFrame:
    """word and n: how often each of the :func:`tokens` occurs."""
    return split.select(F.explode_outer("w").alias("word")).where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))


def cut_words(marked: DataFrame, words: DataFrame) -> DataFrame:
    """Words cut at a line end: chunk_id, pos, word_left, word_right, joined (the
    repaired form), hyphenated (true where the hyphen is not the word's own)."""
    body = marked.where(~F.col("is_header") & ~F.col("is_number") & (F.col("s") != ""))
    w = Window.partitionBy("chunk_id").orderBy("pos")
    pairs = body.select("chunk_id", "pos", "s", F.lead("s").over(w).alias("after")).where(
        F.col("s").rlike(rf"[\p{{L}}][{HYPHENS}]$") & F.col("after").rlike(r"^[\p{L}0-9]"))
    left = bare(F.regexp_extract("s", rf"([^\s\u00a0]+)[{HYPHENS}]$", 1))
    right = bare(F.regexp_extract("after", r"^([^\s\u00a0]+)", 1))
    own = F.endswith(F.col("s"), F.lit("-"))
    p = pairs.select("chunk_id", "pos", left.alias("word_left"), right.alias("word_right"), own.alias("plain_hyphen")).where(
        (F.col("word_left") != "") & (F.col("word_right") != ""))
    forms = {"joined": F.concat("word_left", "word_right"), "whole": F.concat("word_left", F.lit("-"), "word_right"), "l": F.col("word_left"), "r": F.col("word_right")}
    asked = p.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("word")) for k, v in forms.items()])).alias("q")).select(
        "chunk_id", "pos", "word_left", "word_right", "plain_hyphen", "q.form", "q.word")
    known = asked.join(words, "word", "left").groupBy("chunk_id", "pos", "word_left", "word_right", "plain_hyphen").agg(
        *[F.coalesce(F.max(F.when(F.col("form") == k, F.col("n"))), F.lit(0)).alias(k) for k in forms])
    parted = F.when(F.col("joined") != F.col("whole"), F.col("joined") > F.col("whole")).when(
        F.col("word_right").rlike(r"^[\p{Lu}0-9]"), False).otherwise(~((F.col("l") > 1) & (F.col("r") > 1)))
    return known.select("chunk_id", "pos", "word_left", "word_right", (~F.col("plain_hyphen") | parted).alias("hyphenated"))


def skeleton(word: Column) -> Column:
    """The word with every group of confusable glyphs written as one sign; capitals stay."""
    s = F.translate(word, *ALIKE[0])
    for a, b in CONFUSED:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, *ALIKE[1])


def misreadings(words: DataFrame, ratio: int = 10, least: int = 3) -> DataFrame:
    """Forms that may be another word misread: word, right.

    Among the forms of one skeleton the most frequent one of letters only is the right
    one for all that are ``ratio`` times rarer or have a sign inside."""
    forms = words.where((F.length("word") >= least) & F.col("word").rlike(r"^[\p{L}\p{N}@$!|(]+$") & F.col("word").rlike(r"[\p{L}]{2}")).select(
        "word", "n", skeleton(F.col("word")).alias("shape"))
    clean = F.col("word").rlike(r"^\p{L}+$")
    top = forms.groupBy("shape").agg(F.max(F.when(clean, F.struct("n", "word"))).alias("top")).where(F.col("top").isNotNull())
    signed = F.col("word").rlike(r"[@$!|(0-9]")
    return forms.join(top, "shape").where(F.col("word") != F.col("top.word")).where(
        (F.col("top.n") >= F.col("n") * ratio) | (signed & (F.col("top.n") >= F.col("n")))).select("word", F.col("top.word").alias("right"))


def misread_words(split: DataFrame, words: DataFrame) -> DataFrame:
    """Misread words: chunk_id, word, right.

    ``split``: :func:`tokens`; ``words``: their :func:`vocabulary`.  A possible misreading
    counts where the right form is backed by its context: together with the word before
    or after it (the next but one where that is misread too) it occurs elsewhere."""
    parts = words.select(F.explode(F.split("word", "-")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    bad = written(misreadings(parts), "misread-forms")
    none = F.array(F.lit(None).cast("string"))
    flat = split.select("chunk_id", F.col("parts").alias("w"))
    around = {"b2": F.concat(none, none, "w"), "b1": F.concat(none, "w"), "word": F.col("w"), "a1": F.slice("w", F.lit(2), F.size("w")), "a2": F.slice("w", F.lit(3), F.size("w"))}
    own = flat.select("chunk_id", F.explode(F.arrays_zip(*[c.alias(k) for k, c in around.items()])).alias("z")).select("chunk_id", "z.*").where(F.length("word") >= 3)
    found = written(own.join(bad, "word"), "misread-found")
    sides = [F.struct(F.lit(d).alias("d"), x.alias("x"), y.alias("y")) for d, x, y in (
        (1, F.col("b1"), F.col("right")), (1, F.col("right"), F.col("a1")), (2, F.col("b2"), F.col("right")), (2, F.col("right"), F.col("a2")))]
    asked = found.select("chunk_id", "word", "right", F.explode(F.array(*sides)).alias("p")).select(
        "chunk_id", "word", "right", "p.d", "p.x", "p.y").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    wanted = asked.select("d", "x", "y").distinct()
    if wanted.limit(_SMALL + 1).count() <= _SMALL:  # else Spark joins both sides by a shuffle
        wanted = F.broadcast(wanted)
    near = [F.struct(F.lit(1).alias("d"), F.col("z.w").alias("x"), F.col("z.a1").alias("y")), F.struct(F.lit(2).alias("d"), F.col("z.w").alias("x"), F.col("z.a2").alias("y"))]
    pairs = flat.select(F.explode(F.arrays_zip(F.col("w").alias("w"), around["a1"].alias("a1"), around["a2"].alias("a2"))).alias("z")).select(
        F.explode(F.array(*near)).alias("p")).select("p.*").where(F.col("y").isNotNull()).join(wanted, ["d", "x", "y"], "left_semi").distinct()
    return asked.join(pairs, ["d", "x", "y"], "left_semi").select("chunk_id", "word", "right").distinct()


def _prepared(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts, marked lines, tokens, vocabulary), each written once and read by several jobs."""
    texts = written(chunks.select("chunk_id", "paper", "author", "title", "text"), "page-texts")
    cut = written(lines(texts), "page-cut")
    marked = written(noise_lines(cut).select("chunk_id", "pos", "s", "is_header", "is_number"), "page-lines")
    split = written(tokens(texts), "page-tokens")
    return texts, marked, split, written(vocabulary(split), "page-words")


def find_noise(chunks: DataFrame) -> DataFrame:
    """chunk_id and noise, one row per chunk and kind: ``hyphenation``, ``misread``,
    ``header``, ``page_number``.  ``chunks``: chunk_id (unique), paper, author, title,
    text.  Null and empty texts give no row; without title or author (null) heads are
    found by their recurrence in the paper."""
    _, marked, split, words = _prepared(chunks)
    heads = marked.where("is_header").select("chunk_id", F.lit("header").alias("noise"))
    numbers = marked.where("is_number").select("chunk_id", F.lit("page_number").alias("noise"))
    cut = cut_words(marked, words).where("hyphenated").select("chunk_id", F.lit("hyphenation").alias("noise"))
    misread = misread_words(split, words).select("chunk_id", F.lit("misread").alias("noise"))
    return heads.unionByName(numbers).unionByName(cut).unionByName(misread).distinct()


def repair(chunks: DataFrame) -> DataFrame:
    """chunk_id and text of every chunk, in continuous paragraphs.

    Running heads and page numbers are taken out, cut words joined, misread
    words replaced (whole words only, all in one pass), and lines that were broken
    inside a sentence joined; blank lines, list items and table rows stay where they
    are.  ``chunks`` as in :func:`find_noise`.  Null texts stay null.
    """
    texts, marked, split, words = _prepared(chunks)
    cut = cut_words(marked, words).select("chunk_id", "pos", "word_right", F.col("hyphenated"))
    body = marked.where(~F.col("is_header") & ~F.col("is_number"))
    w = Window.partitionBy("chunk_id").orderBy("pos")
    # a page break inside a sentence leaves a blank line on either side of its head: those blanks go too
    near = marked.withColumn("near", F.coalesce(F.lag(F.col("is_header") | F.col("is_number")).over(w), F.lit(False)) | F.coalesce(
        F.lead(F.col("is_header") | F.col("is_number")).over(w), F.lit(False))).select("chunk_id", "pos", "near")
    row = body.join(near, ["chunk_id", "pos"]).join(cut, ["chunk_id", "pos"], "left").where(~((F.col("s") == "") & F.col("near")))
    after = F.lead("s").over(w)
    listed = r"^(?:[-*•]|\[\d+\]|\d+[.)])\s|\|"
    keep = after.isNull() | (after == "") | (F.col("s") == "") | after.rlike(listed) | F.col("s").rlike(r"\|")
    glue = F.when(F.col("hyphenated"), "").when(F.col("word_right").isNotNull(), "").when(keep, F.when(after.isNull(), "").otherwise("\n")).otherwise(" ")
    text = F.when(F.col("hyphenated"), F.regexp_replace("s", rf"[{HYPHENS}]+$", "")).otherwise(F.col("s"))
    flowed = row.select("chunk_id", "pos", F.concat(text, glue).alias("part")).groupBy("chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("flowed"))
    wrong = misread_words(split, words).groupBy("chunk_id", "word").agg(F.min("right").alias("right")).groupBy("chunk_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "right"))).alias("wrong"))
    out = texts.select("chunk_id", "text").join(flowed, "chunk_id", "left").join(wrong, "chunk_id", "left")
    base = F.coalesce("flowed", "text")
    pieces = F.regexp_extract_all(base, F.lit(r"(?s)[A-Za-z0-9@$|(!\p{L}\p{N}]++|[^A-Za-z0-9@$|(!\p{L}\p{N}]++"), F.lit(0))  # words and what is between them
    fixed = F.when(F.col("wrong").isNull(), base).otherwise(F.array_join(F.transform(pieces, lambda x: F.coalesce(F.col("wrong")[x], x)), ""))
    return out.select("chunk_id", F.regexp_replace(fixed, r"\n{3,}", "\n\n").alias("text"))
