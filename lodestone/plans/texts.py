"""Pieces of texts and what they are: units, lines, headings, paragraphs, entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..tables import load
from .audit import _ALIGN, _claims, _expected
from .corpus import CH

# Signs that tell of a wrong decoding.
MOJIBAKE = "璇鎵胯鏂鍦鏈瀵浣锛紝銆€鏄涓鐨妯瀛鐞鎽鍏骞寮庣綔泦枃"
PART = r"\n\s*\n|\r?\n"


def _texts(spark, sf_dir):
    return C.chunks(load(spark, sf_dir, "retrieval_hits")).select("chunk_id", "section", F.coalesce("text", F.lit("")).alias("text"))


def chunk_units(spark, sf_dir):
    """Paragraphs of all chunks by what they are: table, figure, algorithm, table_like, equation or paragraph."""
    p = _texts(spark, sf_dir).select(F.explode(F.split("text", r"\n[ \t]*\n")).alias("p")).select(F.regexp_replace("p", r"^\s+|\s+$", "").alias("p")).where("p <> ''")
    n_lines = F.size(F.split("p", "\n"))
    tabular = (F.length("p") - F.length(F.replace("p", F.lit("|"), F.lit(""))) >= 4) | (F.col("p").rlike(r"(?i)\b(row|column|accuracy|score|metric)\b") & (n_lines >= 3))
    kind = F.when(F.col("p").rlike(r"(?i)^(table|tab\.|表)\s*\d+"), "table").when(F.col("p").rlike(r"(?i)^(figure|fig\.|图)\s*\d+"), "figure").when(
        F.col("p").rlike(r"(?i)^(algorithm|算法)"), "algorithm").when(tabular, "table_like").when(
        F.col("p").rlike(r"\\begin\{equation\}|\\\[|^\(?\d+\)?$") & (F.length("p") < 1200), "equation").otherwise("paragraph")
    return p.groupBy(kind.alias("unit")).agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


def noise_lines(spark, sf_dir):
    """Lines of every chunk that are noise: blank, only digits, or a preprint mark."""
    lines = _texts(spark, sf_dir).select("chunk_id", F.explode(F.split("text", "\n")).alias("l")).select("chunk_id", F.lower(F.regexp_replace("l", r"^\s+|\s+$", "")).alias("l"))
    return lines.groupBy("chunk_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("l") == "").alias("n_blank"), F.count_if(F.col("l").rlike("^[0-9]+$")).alias("n_digits"),
        F.count_if(F.col("l").startswith("arxiv:") | F.col("l").isin("preprint", "under review")).alias("n_marks"))


def heading_forms(spark, sf_dir):
    """Headings without number, signs and case, with how many spellings each has."""
    h = load(spark, sf_dir, "retrieval_hits").select("section_heading").where("section_heading IS NOT NULL").distinct()
    s = F.regexp_replace(F.trim("section_heading"), r"^(?i:[0-9]{1,2}|[ivx]+)(\.[0-9]{1,2})*\s*[.)]?\s+", "")
    s = F.regexp_replace(F.replace(F.regexp_replace(s, r"^[A-Z]\s*[.)]\s+", ""), F.lit("&"), F.lit(" and ")), "[^A-Za-z0-9 ]+", " ")
    return h.select(F.trim(F.lower(F.regexp_replace(s, " +", " "))).alias("form")).groupBy("form").agg(F.count("*").alias("n_spellings"))


def mojibake_counts(spark, sf_dir):
    """Texts with signs of a wrong decoding, and how many."""
    n = F.length("text") - F.length(F.regexp_replace("text", f"[{MOJIBAKE}]", ""))
    return _texts(spark, sf_dir).select("chunk_id", n.alias("n")).where("n > 0")


def claim_alignment_unicode(spark, sf_dir):
    """The most similar found claim of every expected one, by letters and digits of any script."""
    words = lambda: F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    e, f = _expected(spark, sf_dir).select("case_id", "exp_no", words().alias("et")), _claims(spark, sf_dir).select("case_id", "claim_id", words().alias("ft"))
    w = Window.partitionBy("case_id", "exp_no").orderBy(F.desc("score"), "claim_id")
    return e.join(f, "case_id").select("case_id", "exp_no", "claim_id", F.round(T.dice(F.col("et"), F.col("ft")), 6).alias("score")).withColumn(
        "n", F.row_number().over(w)).where("n = 1").drop("n")


def merged_paragraphs(spark, sf_dir):
    """Parts of every chunk, those of under 45 characters added to the one before, those of 30 kept."""
    p = _texts(spark, sf_dir).select("chunk_id", F.posexplode(F.filter(F.transform(F.split("text", PART), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")).alias("pos", "part"))
    w = Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = p.withColumn("no", F.sum(((F.length("part") >= 45) | (F.col("pos") == 0)).cast("int")).over(w))
    return g.groupBy("chunk_id", "no").agg((F.sum(F.length("part")) + F.count("*") - 1).alias("n_chars"), F.count("*").alias("n_parts")).where("n_chars >= 30")


def sentence_pieces(spark, sf_dir):
    """Long sentences of the documents cut at the last blank before 200 characters, or there
    where the blank comes before nine tenths of a half: number of pieces, what they hold, the limit kept."""
    most, least = 200, 90
    s = load(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).where(F.length("s") > most)
    pattern = rf"(?s)(?=\S)(?:.{{1,{most}}}\z|.{{{least},{most - 1}}}(?=\s)|.{{{most}}})"
    cut = F.regexp_extract_all("s", F.lit(pattern), F.lit(0))
    bare = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    return s.withColumn("p", cut).select("doc_id", "pos", bare(F.array_join("p", "")).alias("n_chars"), (~F.exists("p", lambda x: F.length(x) > most)).alias("in_limit"),
                                         (F.size("p") >= F.ceil(F.length("s") / most)).alias("enough"))


def reference_entries(spark, sf_dir):
    """Entries of the reference lists with numbers, per chunk."""
    t = _texts(spark, sf_dir).where(F.col("text").rlike(r"(?m)^\s*\[[0-9]+\]\s"))
    parts = F.filter(F.split("text", r"(?m)(?=^[ \t]*\[[0-9]+\]\s)"), lambda x: F.trim(x) != "")
    return t.select("chunk_id", F.size(F.filter(parts, lambda x: x.rlike(r"^\s*\[[0-9]+\]\s"))).alias("n_entries"))


def repeated_blocks(spark, sf_dir):
    """Blocks that several chunks hold, and how many of these repeat it on purpose (as their overlap)."""
    h = load(spark, sf_dir, "retrieval_hits")
    own = h.select("chunk_id", F.explode("source_block_ids").alias("block_id")).distinct()
    over = h.select("chunk_id", F.explode("overlap_source_block_ids").alias("block_id")).distinct().withColumn("o", F.lit(1))
    return own.join(over, ["chunk_id", "block_id"], "left").groupBy("block_id").agg(F.count("*").alias("n_chunks"), F.count("o").alias("n_overlaps")).where("n_chunks > 1")


QUERIES = {f.__name__: f for f in (
    chunk_units, noise_lines, heading_forms, mojibake_counts, claim_alignment_unicode, merged_paragraphs, sentence_pieces, reference_entries, repeated_blocks)}

_T = f"{CH}, t AS (SELECT chunk_id, coalesce(text, '') AS text FROM ch)"
_U = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_MARK = "chr(1)"
ORACLE = {
    "chunk_units": f"""WITH {_T}, p AS (SELECT regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p FROM (SELECT unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS p FROM t)),
        k AS (SELECT p, CASE WHEN regexp_matches(p, '(?i)^(table|tab\\.|表)\\s*\\d+') THEN 'table' WHEN regexp_matches(p, '(?i)^(figure|fig\\.|图)\\s*\\d+') THEN 'figure' WHEN regexp_matches(p, '(?i)^(algorithm|算法)') THEN 'algorithm'
        WHEN length(p) - length(replace(p, '|', '')) >= 4 OR (regexp_matches(p, '(?i)\\b(row|column|accuracy|score|metric)\\b') AND len(string_split(p, chr(10))) >= 3) THEN 'table_like'
        WHEN regexp_matches(p, '\\\\begin\\{{equation\\}}|\\\\\\[|^\\(?\\d+\\)?$') AND length(p) < 1200 THEN 'equation' ELSE 'paragraph' END AS unit FROM p WHERE p <> '') SELECT unit, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM k GROUP BY 1""",
    "noise_lines": f"""WITH {_T}, l AS (SELECT chunk_id, lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS l FROM (SELECT chunk_id, unnest(string_split(text, chr(10))) AS l FROM t))
        SELECT chunk_id, count(*) AS n_lines, count(*) FILTER (WHERE l = '') AS n_blank, count(*) FILTER (WHERE regexp_matches(l, '^[0-9]+$')) AS n_digits,
        count(*) FILTER (WHERE starts_with(l, 'arxiv:') OR l IN ('preprint', 'under review')) AS n_marks FROM l GROUP BY 1""",
    "heading_forms": """WITH h AS (SELECT DISTINCT section_heading AS h FROM retrieval_hits WHERE section_heading IS NOT NULL), a AS (SELECT regexp_replace(trim(h), '^(?i:[0-9]{1,2}|[ivx]+)(\\.[0-9]{1,2})*\\s*[.)]?\\s+', '') AS s FROM h),
        b AS (SELECT regexp_replace(replace(regexp_replace(s, '^[A-Z]\\s*[.)]\\s+', ''), '&', ' and '), '[^A-Za-z0-9 ]+', ' ', 'g') AS s FROM a) SELECT trim(lower(regexp_replace(s, ' +', ' ', 'g'))) AS form, count(*) AS n_spellings FROM b GROUP BY 1""",
    "mojibake_counts": f"WITH {_T} SELECT * FROM (SELECT chunk_id, CAST(length(text) - length(regexp_replace(text, '[{MOJIBAKE}]', '', 'g')) AS INTEGER) AS n FROM t) WHERE n > 0",
    "claim_alignment_unicode": "WITH " + _ALIGN.format(tok=_U.format(c="ex.text"), tok2=_U.format(c="cl.text")) + """
        SELECT case_id, exp_no, claim_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, exp_no ORDER BY score DESC, claim_id) AS n FROM
        (SELECT case_id, exp_no, claim_id, round(coalesce(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0), 6) AS score FROM d)) WHERE n = 1""",
    "merged_paragraphs": f"""WITH {_T}, l AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n|\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM t),
        p AS (SELECT chunk_id, i, l[i] AS part FROM (SELECT chunk_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)), g AS (SELECT *, sum(CASE WHEN length(part) >= 45 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS no FROM p)
        SELECT * FROM (SELECT chunk_id, CAST(no AS BIGINT) AS no, CAST(sum(length(part)) + count(*) - 1 AS BIGINT) AS n_chars, count(*) AS n_parts FROM g GROUP BY 1, 2) WHERE n_chars >= 30""",
    "sentence_pieces": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || {_MARK}, 'g'), '([。！？])', '\\1' || {_MARK}, 'g'), {_MARK}), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS l
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), s AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l))
        SELECT doc_id, pos, CAST(length(regexp_replace(s, '\\s', '', 'g')) AS INTEGER) AS n_chars, true AS in_limit, true AS enough FROM s WHERE length(s) > 200""",
    "reference_entries": f"""WITH {_T} SELECT chunk_id, CAST(len(regexp_extract_all(text, '(?m)^[ \\t]*\\[[0-9]+\\]\\s')) AS INTEGER) AS n_entries FROM t WHERE regexp_matches(text, '(?m)^\\s*\\[[0-9]+\\]\\s')""",
    "repeated_blocks": """WITH o AS (SELECT DISTINCT chunk_id, unnest(source_block_ids) AS block_id FROM retrieval_hits), v AS (SELECT DISTINCT chunk_id, unnest(overlap_source_block_ids) AS block_id, 1 AS o FROM retrieval_hits)
        SELECT o.block_id, count(*) AS n_chunks, count(v.o) AS n_overlaps FROM o LEFT JOIN v ON o.chunk_id = v.chunk_id AND o.block_id = v.block_id GROUP BY 1 HAVING count(*) > 1""",
}
