"""Broken prompt and response pairs, each with its kind of defect.

Refusals are revealed by templates alone: openings are written with slots for names
and for the prompt's own words, equal ones collapse, MinHash buckets bring similar
ones together, all that share a bucket are compared, and linked ones form one
template.  A template that recurs across unrelated prompts is a refusal where its
records add next to nothing to it and its wording is met nowhere else.  Row-level
checks (nothing said, query given back, broken off, other language) label the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import HAN, language, squash

# Labels before a text, placeholders for no text, first words of a short
# answer that recurs and is none the less one, and words that are never the prompt's own.
_LABEL = r"(?i)(question|answer|response|frage|antwort|réponse|pregunta|respuesta|问题|回答|答案)\s*[:：]"
_PLACEHOLDER = r"(?i)^\s*(n/?a|null|none|nil|nan|undefined|no (output|answer|response)|empty|leer|vide|vacío|无|空|暂无)\s*$"
_YES = ("yes", "ja", "oui", "sí", "si", "是")
_STOP = (
    "the of and to in is that for with as on are this be by it from which at an or not was can we has its than been their does how what why who where when "
    "der die das und ist nicht mit ein eine einen einem einer auf für von den dem des im zu sich wird werden als auch davon wie wir dass durch nach wurden wurde kann welche warum wozu hat haben "
    "le la les de et est que pour dans une un du sur avec par qui ne pas ce cette aux sont plus nous au à été quelles quels comment pourquoi quel quelle mieux se il elle tandis où "
    "el los las y es para con una del por en al como más no lo su fue son qué cómo cuánto sin mejor mientras debido cuáles dónde esto este esta todo tiene"
).split()


def _said(text: Column) -> Column:
    """What a response says: without tags, markup, labels and placeholders."""
    t = F.regexp_replace(text, r"<[^<>]{0,40}>", " ")
    t = F.regexp_replace(t, r"[\[\](){}\"'`*_#…\s ​﻿-]+", " ")
    t = F.regexp_replace(t, r"(?i)^\s*" + _LABEL[4:], " ")
    t = F.regexp_replace(t, _PLACEHOLDER.replace(r"\s*$", r"[\s.!]*$"), "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def is_empty(text: Column) -> Column:
    return text.isNull() | (_said(text) == "")


def is_copy(a: Column, q: Column) -> Column:
    """Only the query: once or repeated, in other case or punctuation, cut at its
    end, or with a few characters changed.  Both squashed, ``a`` without labels."""
    left = F.length(F.replace(a, q, F.lit("")))
    alike = F.abs(F.length(a) - F.length(q)) * 100 <= F.length(q) * 12
    return (q != "") & (a != "") & (
        ((left * 10 <= F.length(q)) & (F.length(a) >= F.length(q)))
        | ((F.length(a) * 10 >= F.length(q) * 6) & F.startswith(q, a))
        | (alike & (F.length(q) >= 12) & F.when(alike, F.levenshtein(a, q) * 100 <= F.length(q) * 12))
    )


def is_truncated(text: Column) -> Column:
    """Breaks off: no ending, and no complete short form (name, number, list, quote, citation)."""
    t = F.regexp_replace(text, r"[\s ​]+$", "")
    closed = t.rlike(r"(?s)(?<![.…])[.!?。！？][\"'”’»)\]*_」』]*$") | t.rlike(r"\((see )?\[?\d+\]?\)$|\[\d+(, ?\d+)*\]$")
    quoted = t.rlike(r"(?s)[\"“«„「][^\"”»」]+[\"”»」]$")
    listed = t.rlike(r"(?s)^\s*([-*•]|\d+[.)])\s+\S.*\n\s*([-*•]|\d+[.)])\s+\S+( \S+){0,6}$")
    parts = F.split(F.trim(t), r"\s+")
    end = F.element_at(parts, -1)
    figure = t.rlike(r"^\W*[\d.,]+\s?%?( (on|in|auf|bei|sur|en|para) \S+( \S+)?)?$")
    brief = (F.size(parts) <= 3) & (F.size(parts) >= 1) & end.rlike(r"^[\p{Lu}\d][\p{L}\d%+./-]*[\p{L}\d%]$|^[\p{Lu}\d]$") & ~t.rlike(f"[{HAN}]")
    brief = brief & ~F.lower(end).isin(_STOP)
    one = (F.size(parts) == 1) & t.rlike(r"^\p{L}+$") & ~t.rlike(f"[{HAN}]")
    return ~(closed | quoted | listed | figure | brief | one)


def _tokens(c: Column) -> Column:
    """Words; Han characters one by one."""
    spaced = F.regexp_replace(F.lower(c), f"([{HAN}])", " $1 ")
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _slotted(tokens: Column, asked: Column) -> Column:
    """Words with a slot for every run of names and of the prompt's own words, so that
    a template shows the same wording whatever it was asked about."""
    slotted = F.transform(tokens, lambda w: F.when(F.array_contains(asked, w), "*").otherwise(w))
    return F.regexp_replace(F.array_join(slotted, " "), r"\*( \*)+", "*")


def _names(text: Column) -> Column:
    """Words with a capital, but for those that begin a sentence, in lower case.
    (Numbers are no slots: they tell something.)"""
    part = rf"[\p{{L}}\p{{N}}&&[^{HAN}]]"
    found = F.regexp_extract_all(text, F.lit(rf"(?<=[\p{{L}}\p{{N}},;:)»”] |[^\s\p{{L}}\p{{N}}.!?。！？]|[{HAN}])(?={part}*\p{{Lu}}){part}{{2,}}"), F.lit(0))
    return F.coalesce(F.transform(found, lambda w: F.lower(w)), F.array().cast("array<string>"))


def _shingles(opening: Column, k: int) -> Column:
    w = F.split(opening, " ")
    n = F.size(w)
    return F.array_distinct(F.when(n <= k, F.array(opening)).otherwise(
        F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))


def _least(shingles: Column, seed: int) -> Column:
    """MinHash value number ``seed``."""
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))


def _groups(links: DataFrame) -> DataFrame:
    """oid, head of everything linked: the smallest oid of its connected group.
    The labels of a round are the smallest among a row and its neighbours, and then
    that label's own label, until nothing changes."""
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "pair-links")
    label = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("head"))
    label = written(label.select(F.col("a").alias("oid"), "head"), "pair-labels")
    while True:
        near = edges.join(label.select(F.col("oid").alias("b"), "head"), "b").groupBy(F.col("a").alias("oid")).agg(F.min("head").alias("near"))
        step = label.join(near, "oid").select("oid", F.col("head").alias("was"), F.least("head", "near").alias("to"))
        jump = step.join(label.select(F.col("oid").alias("to"), F.col("head").alias("on")), "to")
        moved = written(jump.select("oid", F.least("to", "on").alias("head"), "was"), "pair-labels")
        label = moved.select("oid", "head")
        if not moved.where(F.col("head") < F.col("was")).take(1):
            return label


def opening_templates(openings: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 8, rows: int = 2,
                      prompts: int = 3, cell: int = 512) -> DataFrame:
    """Openings that recur across unrelated prompts: opening, template, support.

    ``openings``: opening, tie, n_prompts.  Openings with a tie in common belong
    together, and so do those at least ``similarity`` alike (Jaccard of word runs):
    all that share a MinHash bucket are compared.  Openings connected directly or
    through others form one template, whose support is the number of prompts of all
    of them.  A bucket is joined in cells of about ``cell`` openings, so that no task
    gets a large one whole.
    """
    known = openings.groupBy("opening").agg(F.sum("n_prompts").alias("n_prompts"), F.min(F.xxhash64("tie")).alias("tid"))
    known = written(known.withColumn("oid", F.xxhash64("opening")), "pair-known")
    sh = known.select("oid", "tid", _shingles(F.col("opening"), shingle).alias("s"))
    keys = F.array(*[F.xxhash64(F.lit(b), *[_least(F.col("s"), b * rows + j) for j in range(rows)]) for b in range(bands)])
    runs = F.transform("s", lambda x: F.xxhash64(x))
    member = written(sh.select("oid", "tid", runs.alias("s"), F.explode(keys).alias("key")), "pair-buckets")
    # openings of one tie belong together anyhow: only buckets with several ties are compared
    cells = member.groupBy("key").agg(F.count("*").alias("n"), (F.min("tid") != F.max("tid")).alias("mixed")).where("mixed").select(
        "key", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    placed = member.join(cells, "key")
    one = placed.select("key", F.pmod("oid", "cells").cast("int").alias("cell"), F.col("tid").alias("a"), F.col("s").alias("sa"))
    other = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("tid").alias("b"), F.col("s").alias("sb"))
    m, n = F.size("sa") + F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    # sets of too unlike sizes cannot be alike enough
    sized = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * similarity - 1e-9
    links = one.join(other, ["key", "cell"]).where((F.col("a") < F.col("b")) & sized & (n >= similarity * (m - n))).select("a", "b")
    several = openings.join(known.select("opening", "tid"), "opening").select(F.col("tid").alias("a"), F.xxhash64("tie").alias("b")).where(F.col("a") < F.col("b"))
    placed = known.join(_groups(links.unionByName(several).distinct()).withColumnRenamed("oid", "tid"), "tid", "left").select(
        "opening", "n_prompts", F.coalesce("head", "tid").alias("template"))
    support = placed.groupBy("template").agg(F.sum("n_prompts").alias("support")).where(F.col("support") >= prompts)
    return placed.join(support, "template").select("opening", "template", "support")


def _runs(text: Column, k: int = 3) -> Column:
    """Different runs of k words without a slot, as hashes."""
    runs = F.filter(_shingles(text, k), lambda r: (F.size(F.split(r, " ")) == k) & ~F.contains(r, F.lit("*")))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def silent_templates(said: DataFrame, template: DataFrame, least: int = 5) -> DataFrame:
    """The templates that tell nothing by themselves: opening, template, support.

    ``said``: opening, prompt, tail - the records that say something; ``template``:
    opening, template, support.  Records of such a template go on in at most half as
    many ways as it has prompts, and with most of its prompts the opening has
    ``least`` words or more besides slots, no number, and does not begin with a yes.
    """
    w = F.split("opening", " ")
    told = (F.size(F.filter(w, lambda x: x != "*")) >= least) & ~F.col("opening").rlike(r"\p{N}") & ~w[0].isin(*_YES)
    plain = said.join(template, "opening").groupBy("template").agg(
        F.countDistinct("prompt").alias("n"), F.countDistinct("tail").alias("n_tails"), F.countDistinct(F.when(told, F.col("prompt"))).alias("n_told"))
    return template.join(plain.where((F.col("n_tails") * 2 <= F.col("n") + 1) & (F.col("n_told") * 2 >= F.col("n"))).select("template"), "template", "left_semi")


def refusal_templates(said: DataFrame, silent: DataFrame) -> DataFrame:
    """The openings of the silent templates that answer nothing.

    The wording of a template is the runs of three words that at least half of its
    prompts have in common.  Answers are built of wording that recurs anywhere, so
    wording counts as an answer's where the records of no silent template, or what
    follows any opening, have it with at least a fifth of the template's number of
    prompts.  A template is a refusal if less than half of its wording is an answer's.
    """
    member = said.join(silent, "opening", "left").select("prompt", "opening", "template", "support", "words", "rest")
    own = member.where(F.col("template").isNotNull()).select("template", "support", "prompt", F.explode(_runs(F.col("opening"))).alias("run")).groupBy(
        "template", "support", "run").agg(F.countDistinct("prompt").alias("n"))
    own = written(own.where(F.col("n") * 2 >= F.col("support")).select("template", "support", "run"), "pair-runs")
    text = F.when(F.col("template").isNull(), F.col("words")).otherwise(F.col("rest"))
    met = member.select("prompt", F.explode(_runs(text)).alias("run")).join(own.select("run").distinct(), "run", "left_semi").groupBy("run").agg(
        F.countDistinct("prompt").alias("n_met"))
    common = F.coalesce("n_met", F.lit(0)) * 5 >= F.col("support")
    refusing = own.join(met, "run", "left").groupBy("template").agg(F.count_if(common).alias("n_common"), F.count("*").alias("n_runs")).where(
        F.col("n_common") * 2 < F.col("n_runs"))
    return silent.join(refusing, "template", "left_semi").select("opening")


def broken_pairs(records: DataFrame, profiles, prompts: int = 3, start: int = 6) -> DataFrame:
    """record_kind, record_id, defect of every record that is no usable response.

    ``records``: record_kind, record_id, query, answer; ``profiles``:
    :func:`.text.language_profiles`.  One defect per record, in this order:
    ``empty``, ``copy``, ``refusal``, ``truncated``, ``other_language``.  A null
    answer is empty; with a null query only empty, refusal and truncated can be
    told.  Prompts with the same names count as one: ``prompts`` unrelated ones make
    a template, and openings that share their first ``start`` words belong together.  Rows without record_id are left out; repeated rows collapse; of
    differing rows of one record the greatest counts.  An empty table gives no row.
    """
    one = records.where(F.col("record_id").isNotNull()).groupBy("record_kind", "record_id").agg(
        F.max(F.struct("answer", "query")).alias("r")).select("record_kind", "record_id", "r.*")
    a, q = F.col("answer"), F.col("query")
    # each derived text is a column of its own, so that it is made once per row
    base = one.select(
        "record_kind", "record_id", "answer", "query", squash(F.regexp_replace(a, _LABEL, " ")).alias("sa"), squash(q).alias("sq"),
        language(profiles, a).alias("la"), language(profiles, q).alias("lq"), _tokens(a).alias("ta"), _tokens(q).alias("tq"),
        F.size(_tokens(F.split(F.trim(a), r"(?<=[.!?])\s+|(?<=[。！？])", 2)[0])).alias("n_own"), _names(a).alias("na"), _names(q).alias("nq"),
    )
    own = F.array_except(F.coalesce("tq", F.array().cast("array<string>")), F.array(*map(F.lit, _STOP)))
    base = base.withColumn("asked", F.array_union(own, "na")).withColumn("n_own", F.when(F.col("n_own") >= 3, F.col("n_own")).otherwise(F.size("ta")))
    flags = base.select(
        "record_kind", "record_id", F.xxhash64(F.coalesce(F.when(F.size("nq") > 0, F.sort_array(F.array_distinct("nq"))), "tq")).alias("prompt"),
        _slotted(F.slice("ta", F.lit(1), F.col("n_own")), F.col("asked")).alias("opening"), F.array_join("ta", " ").alias("words"),
        _slotted(F.slice("ta", F.lit(1), F.least("n_own", F.lit(start))), F.col("na")).alias("tie"),
        _slotted(F.slice("ta", F.col("n_own") + 1, F.size("ta")), F.col("asked")).alias("rest"),
        F.when(is_empty(a), "empty").when(F.coalesce(is_copy(F.col("sa"), F.col("sq")), F.lit(False)), "copy").alias("first_defect"),
        F.when(F.coalesce(is_truncated(a), F.lit(False)), "truncated").when(F.coalesce(F.col("la") != F.col("lq"), F.lit(False)), "other_language").alias("last_defect"),
    )
    flags = written(flags.withColumn("tail", F.xxhash64("rest")), "pair-flags")  # read several times below, so it is made once
    speaks = flags.where(F.col("first_defect").isNull() & (F.col("opening") != ""))
    distinct = speaks.groupBy("opening", "tie").agg(F.countDistinct("prompt").alias("n_prompts"))
    template = written(opening_templates(distinct, prompts=prompts), "pair-openings")
    silent = written(silent_templates(speaks, template), "pair-silent")
    refusing = refusal_templates(speaks, silent).select("opening", F.lit(True).alias("refuses"))
    defect = F.coalesce(F.col("first_defect"), F.when(F.col("refuses").isNotNull(), "refusal"), F.col("last_defect"))
    return flags.join(refusing, "opening", "left").select("record_kind", "record_id", defect.alias("defect")).where(F.col("defect").isNotNull())
