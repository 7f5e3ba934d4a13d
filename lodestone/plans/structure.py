"""Structure queries: neighbours, headings, blocks, sizes, chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import order as O
from ..operators import structure as S
from ..tables import load
from .corpus import CH


def _manifest(spark, sf_dir):
    m = load(spark, sf_dir, "corpus_manifest")
    return m.groupBy("chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("section").alias("section"), F.min("page_start").alias("page"), F.max("char_count").alias("chars"))


def _part(chunk_id: str):
    """Bucket of a chunk along its paper: chunks are numbered with leading zeros."""
    return F.floor(F.coalesce(F.regexp_extract(chunk_id, "([0-9]+)$", 1).try_cast("long"), F.lit(0)) / 500)


def neighbor_links(spark, sf_dir):
    return O.neighbours(_manifest(spark, sf_dir), "doc_id", "chunk_id", _part("chunk_id"))


def page_chunk_numbers(spark, sf_dir):
    w = Window.partitionBy("doc_id", "page").orderBy("chunk_id")
    return _manifest(spark, sf_dir).where("page IS NOT NULL").select("chunk_id", "page", F.row_number().over(w).alias("on_page"))


def section_carry_forward(spark, sf_dir):
    """The last known heading of each chunk, carried along its paper."""
    c = C.chunks(load(spark, sf_dir, "retrieval_hits")).select(
        F.regexp_replace("chunk_id", "_chunk_[0-9]+$", "").alias("paper"), "chunk_id", "section_heading", _part("chunk_id").alias("part"))
    return O.around(c, ["paper"], "chunk_id", "part", F.col("section_heading")).select("chunk_id", F.col("before").alias("carried"))


def section_changes(spark, sf_dir):
    """Papers with the number of section changes and of body chunks after references."""
    m = _manifest(spark, sf_dir).withColumn("paper", F.coalesce("doc_id", F.lit(""))).withColumn("part", _part("chunk_id"))
    # what stands before a row: its own value set aside by looking from the row before
    prev = O.neighbours(m, "paper", "chunk_id", F.col("part")).select("chunk_id", "prev_id")
    before = m.select(F.col("chunk_id").alias("prev_id"), F.col("section").alias("before"))
    first_ref = m.where("section = 'references'").groupBy("paper").agg(F.min("chunk_id").alias("first_ref"))
    j = m.join(prev, "chunk_id").join(before, "prev_id", "left").join(first_ref, "paper", "left")
    return j.groupBy("doc_id").agg(F.count_if(F.col("before").isNotNull() & ~F.col("section").eqNullSafe(F.col("before"))).alias("n_changes"),
                                   F.count_if((F.col("chunk_id") > F.col("first_ref")) & (F.col("section") != "references")).alias("n_after_references"))


def dominant_section(spark, sf_dir):
    """The section with the most characters on every page of a paper."""
    s = _manifest(spark, sf_dir).where("page IS NOT NULL").groupBy("doc_id", "page", "section").agg(F.sum("chars").alias("chars"))
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("chars"), "section")
    return s.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "page", "section", "chars")


def chunk_stats(spark, sf_dir):
    """Sizes per section: nearest-rank p10, upper median, p90, true median, interpolated p95."""
    v = _manifest(spark, sf_dir).where("chars IS NOT NULL")
    rank = lambda q: lambda n: F.bround((n - 1) * F.lit(q), 0)
    mid, median = O.interpolated("median", 0.5)
    high, p95 = O.interpolated("p95", 0.95)
    s = O.order_statistics(v, ["section"], "chars", {
        "least": lambda n: F.lit(0), "p10": rank(0.1), "upper_median": lambda n: F.floor(n / 2), "p90": rank(0.9), "most": lambda n: n - 1, **mid, **high}, 64)
    mean = v.groupBy(F.col("section").alias("of")).agg(F.round(F.avg("chars"), 2).alias("mean"))
    return s.join(mean, F.col("section").eqNullSafe(F.col("of"))).select(
        "section", F.col("n").cast("int").alias("n"), "least", "p10", "upper_median", "p90", "most", "mean", median.cast("double").alias("median"), F.round(p95, 4).alias("p95"))


def _blocks(spark, sf_dir):
    h = load(spark, sf_dir, "retrieval_hits")
    return h.select("chunk_id", F.explode("source_block_ids").alias("block_id")).distinct()


def block_coverage(spark, sf_dir):
    """Blocks per chunk, and how many of them other chunks hold as well."""
    b = _blocks(spark, sf_dir)
    n = b.groupBy("block_id").agg(F.count("*").alias("n"))
    return b.join(n, "block_id").groupBy("chunk_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("n") > 1).alias("n_shared"))


def lost_blocks(spark, sf_dir):
    """Overlap blocks that no chunk has as a source, per paper."""
    h = load(spark, sf_dir, "retrieval_hits")
    o = h.select(F.explode("overlap_source_block_ids").alias("block_id")).distinct()
    return o.join(_blocks(spark, sf_dir).select("block_id").distinct(), "block_id", "left_anti").groupBy(
        F.regexp_replace("block_id", "_p[0-9]+_b[0-9]+$", "").alias("paper")).agg(F.count("*").alias("n_lost"))


def heading_scores(spark, sf_dir):
    h = load(spark, sf_dir, "retrieval_hits").select("section_heading").where("section_heading IS NOT NULL").distinct()
    s = S.heading_score(F.col("section_heading"))
    return h.select("section_heading", F.round(s, 4).alias("score"), F.round(S.heading_confidence(s), 6).alias("confidence"), (s >= 4.8).alias("is_heading"))


def heading_levels(spark, sf_dir):
    h = load(spark, sf_dir, "retrieval_hits")
    return h.groupBy(F.size("heading_path").alias("depth"), F.element_at("heading_path", 1).alias("top")).agg(F.countDistinct("chunk_id").alias("n_chunks"))


def inferred_chunk_types(spark, sf_dir):
    """The type that the content types imply, against the stored one."""
    t = F.array_distinct(F.transform("content_types", lambda x: F.when(x == "reference_entry", "reference").when(x.isin("caption", "table", "equation"), x).otherwise("text")))
    h = load(spark, sf_dir, "retrieval_hits").select("chunk_id", "section", "chunk_type", F.array_sort(t).alias("t")).distinct()
    special = F.size(F.array_except("t", F.array(F.lit("text"), F.lit("reference"))))
    kind = F.when(F.col("section") == "references", "references").when(F.array_join("t", ",") == "equation", "equation").when(
        F.array_join("t", ",").isin("table", "caption,table"), "table").when(special > 0, "mixed").otherwise("text")
    return h.groupBy(kind.alias("inferred"), "chunk_type").agg(F.count("*").alias("n"))


def nearest_body_chunk(spark, sf_dir):
    """The nearest plain chunk of the same paper and section for every chunk with a table:
    of the same page where there is one, then by number.  The nearest ones before and
    after come from the order of the paper, on the page and in all."""
    c = C.chunks(load(spark, sf_dir, "retrieval_hits")).where("section IS NOT NULL").select(
        F.regexp_replace("chunk_id", "_chunk_[0-9]+$", "").alias("paper"), "section", "chunk_id", F.coalesce("page_start", F.lit(-1)).alias("page"),
        F.regexp_extract("chunk_id", "([0-9]+)$", 1).cast("int").alias("no"), "has_table", "chunk_type", _part("chunk_id").alias("part"))
    body = F.when(F.expr("NOT has_table AND chunk_type = 'body'"), F.struct("no", F.col("chunk_id").alias("id")))
    a = O.around(c, ["paper", "section"], "chunk_id", "part", body).withColumnsRenamed({"before": "b1", "after": "a1"})
    both = O.around(a, ["paper", "section", "page"], "chunk_id", "part", body).where("has_table")
    near = [F.struct(F.lit(far).alias("far"), F.abs(F.col("no") - F.col(x)["no"]).alias("d"), F.col(x)["no"].alias("no"), F.col(x)["id"].alias("id"))
            for far, x in ((0, "before"), (0, "after"), (1, "b1"), (1, "a1"))]
    least = F.array_min(F.filter(F.array(*near), lambda z: z["id"].isNotNull()))
    return both.withColumn("near", least).where("near IS NOT NULL").select("chunk_id", F.col("near.id").alias("body_id"))


def _doc_blocks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("section", F.lit("body")).alias("section"), F.posexplode(F.split("text", r"\n\s*\n")).alias("block_no", "text"))


def document_blocks(spark, sf_dir):
    return _doc_blocks(spark, sf_dir).select("doc_id", "block_no", F.length("text").alias("n_chars"))


def chunk_documents(spark, sf_dir):
    return S.build_chunks(_doc_blocks(spark, sf_dir))


def chunk_validation_counters(spark, sf_dir):
    c = chunk_documents(spark, sf_dir)
    return c.agg(F.count("*").alias("n_chunks"), F.count_if(F.length("text") > 1600).alias("n_oversized"), F.count_if(F.trim("text") == "").alias("n_blank"),
                 F.count_if(F.col("n_overlap") > 0).alias("n_overlapping"), F.count_if((F.col("section") == "references") & (F.col("n_overlap") > 0)).alias("n_bad_overlap"))


QUERIES = {f.__name__: f for f in (
    neighbor_links, page_chunk_numbers, section_carry_forward, section_changes, dominant_section, chunk_stats, block_coverage, lost_blocks, heading_scores,
    heading_levels, inferred_chunk_types, nearest_body_chunk, document_blocks, chunk_documents, chunk_validation_counters)}

_M = "m AS (SELECT chunk_id, max(doc_id) AS doc_id, max(section) AS section, min(page_start) AS page, max(char_count) AS chars FROM corpus_manifest GROUP BY 1)"
_B = "b AS (SELECT DISTINCT chunk_id, unnest(source_block_ids) AS block_id FROM retrieval_hits)"
_HS = """(CASE WHEN regexp_matches(h, '^[0-9]+(\\.[0-9]+)*\\.?\\s') THEN 3.0 ELSE 0.0 END + CASE WHEN upper(h) = h AND regexp_matches(h, '[A-Z]') THEN 1.4 ELSE 0.0 END
 + CASE WHEN regexp_matches(lower(h), '\\b(abstract|introduction|related work|method|experiments?|results?|limitations?|conclusion|references|appendix)\\b') THEN 3.2 ELSE 0.0 END
 + CASE WHEN len(regexp_split_to_array(trim(h), '\\s+')) <= 8 THEN 1.0 ELSE 0.0 END - CASE WHEN regexp_matches(h, '[.!?]$') THEN 2.0 ELSE 0.0 END)"""
ORACLE = {
    "neighbor_links": f"""WITH {_M} SELECT doc_id, chunk_id, CAST(row_number() OVER w AS INTEGER) AS n, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)""",
    "page_chunk_numbers": f"WITH {_M} SELECT chunk_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY chunk_id) AS INTEGER) AS on_page FROM m WHERE page IS NOT NULL",
    "section_carry_forward": f"""WITH {CH} SELECT chunk_id, last_value(section_heading IGNORE NULLS) OVER (PARTITION BY regexp_replace(chunk_id, '_chunk_[0-9]+$', '') ORDER BY chunk_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM ch""",
    "section_changes": f"""WITH {_M}, x AS (SELECT *, lag(section) OVER w AS before, max(CASE WHEN section = 'references' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
        FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id)) SELECT doc_id, count(*) FILTER (WHERE before IS NOT NULL AND section IS DISTINCT FROM before) AS n_changes,
        count(*) FILTER (WHERE seen = 1 AND section <> 'references') AS n_after_references FROM x GROUP BY 1""",
    "dominant_section": f"""WITH {_M} SELECT doc_id, page, section, chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY chars DESC, section) AS n FROM
        (SELECT doc_id, page, section, CAST(sum(chars) AS BIGINT) AS chars FROM m WHERE page IS NOT NULL GROUP BY 1, 2, 3)) WHERE n = 1""",
    "chunk_stats": f"""WITH {_M}, g AS (SELECT section, list(chars ORDER BY chars) AS v, round(avg(chars), 2) AS mean, CAST(median(chars) AS DOUBLE) AS median, round(quantile_cont(chars, 0.95), 4) AS p95 FROM m WHERE chars IS NOT NULL GROUP BY 1)
        SELECT section, CAST(len(v) AS INTEGER) AS n, v[1] AS least, v[CAST(round_even((len(v) - 1) * 0.1, 0) AS INTEGER) + 1] AS p10, v[len(v) // 2 + 1] AS upper_median,
        v[CAST(round_even((len(v) - 1) * 0.9, 0) AS INTEGER) + 1] AS p90, v[-1] AS most, mean, median, p95 FROM g""",
    "block_coverage": f"WITH {_B}, n AS (SELECT block_id, count(*) AS n FROM b GROUP BY 1) SELECT chunk_id, count(*) AS n_blocks, count(*) FILTER (WHERE n > 1) AS n_shared FROM b JOIN n USING (block_id) GROUP BY 1",
    "lost_blocks": f"""WITH {_B}, o AS (SELECT DISTINCT unnest(overlap_source_block_ids) AS block_id FROM retrieval_hits) SELECT regexp_replace(block_id, '_p[0-9]+_b[0-9]+$', '') AS paper, count(*) AS n_lost
        FROM o WHERE block_id NOT IN (SELECT block_id FROM b WHERE block_id IS NOT NULL) GROUP BY 1""",
    "heading_scores": f"""WITH h AS (SELECT DISTINCT section_heading AS h FROM retrieval_hits WHERE section_heading IS NOT NULL)
        SELECT h AS section_heading, round(CAST({_HS} AS DOUBLE), 4) AS score, round(1 / (1 + exp(-({_HS} - 5.8) / 1.4)), 6) AS confidence, {_HS} >= 4.8 AS is_heading FROM h""",
    "heading_levels": "SELECT CAST(len(heading_path) AS INTEGER) AS depth, heading_path[1] AS top, count(DISTINCT chunk_id) AS n_chunks FROM retrieval_hits GROUP BY 1, 2",
    "inferred_chunk_types": """WITH h AS (SELECT DISTINCT chunk_id, section, chunk_type, list_sort(list_distinct(list_transform(content_types, lambda x: CASE WHEN x = 'reference_entry' THEN 'reference' WHEN x IN ('caption', 'table', 'equation') THEN x ELSE 'text' END))) AS t FROM retrieval_hits)
        SELECT CASE WHEN section = 'references' THEN 'references' WHEN t = ['equation'] THEN 'equation' WHEN t = ['table'] OR t = ['caption', 'table'] THEN 'table'
        WHEN len(list_filter(t, lambda x: x NOT IN ('text', 'reference'))) > 0 THEN 'mixed' ELSE 'text' END AS inferred, chunk_type, count(*) AS n FROM h GROUP BY 1, 2""",
    "nearest_body_chunk": f"""WITH {CH}, c AS (SELECT *, regexp_replace(chunk_id, '_chunk_[0-9]+$', '') AS paper, CAST(regexp_extract(chunk_id, '([0-9]+)$', 1) AS INTEGER) AS no FROM ch)
        SELECT chunk_id, body_id FROM (SELECT t.chunk_id, b.chunk_id AS body_id, row_number() OVER (PARTITION BY t.chunk_id ORDER BY CASE WHEN t.page_start IS NOT DISTINCT FROM b.page_start THEN 0 ELSE 1 END, abs(t.no - b.no), b.no, b.chunk_id) AS n
        FROM c t JOIN c b ON t.paper = b.paper AND t.section = b.section WHERE t.has_table AND NOT b.has_table AND b.chunk_type = 'body') WHERE n = 1""",
    "document_blocks": """WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS l FROM documents WHERE text IS NOT NULL)
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i - 1 AS INTEGER) AS block_no, CAST(length(l[i]) AS INTEGER) AS n_chars FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""",
}
