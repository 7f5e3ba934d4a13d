"""Retrieval and audit metrics that go beyond the ranks: pages, sections, keywords,
evidence, and means over a long table of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import plain_tokens
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators.references import normal_id
from ..tables import load
from .corpus import CH
from .references import _norm

CUTS = (1, 3, 5, 10)


def _hits(spark, sf_dir):
    """Fused hits of every query: query_id, chunk_id, rank, doc_id, section, pages."""
    h = load(spark, sf_dir, "retrieval_hits").where("fusion_rank IS NOT NULL AND chunk_id IS NOT NULL AND query_id IS NOT NULL")
    return h.groupBy("query_id", normal_id(F.col("chunk_id")).alias("chunk_id")).agg(
        F.min("fusion_rank").alias("rank"), *[F.max(c).alias(c) for c in ("doc_id", "section", "page_start", "page_end")])


def _wanted(spark, sf_dir):
    """The evidence of every case with where it stands."""
    places = C.chunks(load(spark, sf_dir, "retrieval_hits")).select(
        normal_id(F.col("chunk_id")).alias("chunk_id"), F.col("doc_id").alias("w_doc"), F.col("section").alias("w_section"), F.col("page_start").alias("w_from"), F.col("page_end").alias("w_to"))
    places = places.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("w_doc", "w_section", "w_from", "w_to")])
    return M.judgements(load(spark, sf_dir, "citation_audit_v1_queries")).withColumnRenamed("chunk_id", "w_chunk").join(
        places.withColumnRenamed("chunk_id", "w_chunk"), "w_chunk")


def place_recall(spark, sf_dir):
    """Share of the cases whose first k hits hold a document, section or page of their evidence, per k."""
    j = _wanted(spark, sf_dir).join(_hits(spark, sf_dir), "query_id")
    doc = F.col("doc_id") == F.col("w_doc")
    section = doc & (F.col("section") == F.col("w_section"))
    page = doc & (F.col("page_start") <= F.col("w_to")) & (F.col("page_end") >= F.col("w_from"))
    best = j.groupBy("query_id").agg(*[F.min(F.when(c, F.col("rank"))).alias(n) for n, c in (("document", doc), ("section", section), ("page", page))])
    cases = _wanted(spark, sf_dir).select("query_id").distinct().join(best, "query_id", "left")
    long = cases.select(F.explode(F.create_map(*[x for n in ("document", "section", "page") for x in (F.lit(n), F.col(n))])).alias("place", "best"))
    return long.groupBy("place").agg(F.count("*").alias("n_cases"), *[F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")), 6).alias(f"hit_{k}") for k in CUTS])


def keyword_recall(spark, sf_dir):
    """Share of the query's own words that the texts of its first five hits hold, per case."""
    q = load(spark, sf_dir, "citation_audit_v1_queries").groupBy(F.col("case_id").alias("query_id")).agg(F.max("query").alias("query"))
    words = q.select("query_id", F.explode(plain_tokens(F.col("query"))).alias("word"))
    texts = C.chunks(load(spark, sf_dir, "retrieval_hits")).select(normal_id(F.col("chunk_id")).alias("chunk_id"), "text").where("text IS NOT NULL")
    held = _hits(spark, sf_dir).where("rank <= 5").select("query_id", "chunk_id").join(texts, "chunk_id").select("query_id", F.explode(plain_tokens(F.col("text"))).alias("word")).distinct()
    return words.join(held.withColumn("held", F.lit(1)), ["query_id", "word"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_words"), F.count("held").alias("n_held"), F.round(F.count("held") / F.count("*"), 6).alias("recall"))


def evidence_metrics(spark, sf_dir):
    """Of the chunks that claims cite: how many rows have all five fields of a source, stand in
    the manifest, and are among the candidates of their claim; share of claims without any."""
    c = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"])
    cited = c.select("claim_id", "candidate_chunk_ids", F.explode("citations").alias("s")).select(
        "claim_id", normal_id(F.col("s.chunk_id")).alias("chunk_id"),
        F.expr("s.chunk_id IS NOT NULL AND s.doc_id IS NOT NULL AND s.section IS NOT NULL AND s.page_start IS NOT NULL AND s.page_end IS NOT NULL").alias("whole"))
    known = load(spark, sf_dir, "corpus_manifest").select(normal_id(F.col("chunk_id")).alias("chunk_id"), F.lit(1).alias("known")).distinct()
    asked = M.ids_of(load(spark, sf_dir, "audited_claims"), "claim_id", "candidate_chunk_ids").withColumn("asked", F.lit(1))
    j = cited.join(known, "chunk_id", "left").join(asked, ["claim_id", "chunk_id"], "left")
    n = c.agg(F.count("*")).scalar()
    return j.agg(F.count("*").alias("n_citations"), F.count_if("whole").alias("n_whole"), F.count("known").alias("n_known"), F.count("asked").alias("n_asked"),
                 F.round(1 - F.countDistinct("claim_id") / n, 6).alias("without_citation"))


def metric_means(spark, sf_dir):
    """A long table of metrics (case, name, value, passed), as mean and pass rate per name."""
    e = load(spark, sf_dir, "evidence_sufficiency").dropDuplicates(["result_id"]).select(F.col("case_id"), F.explode(F.create_map(
        F.lit("confidence"), F.col("confidence"), F.lit("latency_ms"), F.col("latency_ms"), F.lit("answerable"), F.col("answerable").cast("double"))).alias("name", "value"))
    a = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"]).select("case_id", F.lit("claim_confidence").alias("name"), F.col("confidence").alias("value"))
    s = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"]).select("case_id", F.lit("supported").alias("name"), (F.col("support_level") == "supported").cast("double").alias("value"))
    r = _hits(spark, sf_dir).groupBy("query_id").agg(F.count("*").cast("double").alias("value")).select(F.col("query_id").alias("case_id"), F.lit("n_hits").alias("name"), "value")
    long = e.unionByName(a).unionByName(s).unionByName(r).where("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"), F.round(F.avg("value"), 6).alias("mean"),
                                    F.round(F.avg((F.col("value") >= 0.5).cast("double")), 6).alias("pass_rate"))


def answer_category_rollup(spark, sf_dir):
    """Answers per category and in all: number, empty ones, mean length, share with a citation."""
    c = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(
        F.max("category").alias("category"), F.max("answer").alias("answer"), F.max(F.size("citation_chunk_ids")).alias("n_cited"))
    return c.rollup("category").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "").alias("n_empty"), F.round(F.avg(F.length("answer")), 4).alias("mean_chars"),
        F.round(F.avg((F.coalesce("n_cited", F.lit(0)) > 0).cast("double")), 6).alias("cited"), F.grouping("category").cast("int").alias("is_total"))


def latest_judgements(spark, sf_dir):
    """Every case with its latest judgement (the last one wins; cases without one stay)."""
    e = load(spark, sf_dir, "evidence_sufficiency").where("case_id IS NOT NULL").groupBy("case_id").agg(
        F.max(F.struct("judged_at", "result_id", "support_level")).alias("j"))
    c = load(spark, sf_dir, "citation_audit_v1_queries").select("case_id").distinct()
    return c.join(e, "case_id", "left").select("case_id", F.col("j.result_id").alias("result_id"), F.col("j.support_level").alias("support_level"))


def run_ledger_failures(spark, sf_dir):
    """Cases with their judgements and fallbacks (runs joined with ledger and failures)."""
    e = load(spark, sf_dir, "evidence_sufficiency").dropDuplicates(["result_id"])
    ledger = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"]).groupBy("case_id").agg(F.count("*").alias("n_claims"))
    failures = e.where("fallback_used").groupBy("case_id").agg(F.count("*").alias("n_failures"), F.min("fallback_reason").alias("first_reason"))
    runs = e.where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n_runs"))
    return runs.join(ledger, "case_id", "left").join(failures, "case_id", "left").select(
        "case_id", "n_runs", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "first_reason")


def runs_since(spark, sf_dir):
    """Judgements per day since the given moment."""
    e = load(spark, sf_dir, "evidence_sufficiency").where("judged_at >= TIMESTAMP_NTZ '2025-04-01 00:00:00'").dropDuplicates(["result_id"])
    return e.groupBy(F.date_format("judged_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def call_multiset_difference(spark, sf_dir):
    """Calls per user and kind in March against those in April: what was taken away and what was added."""
    e = load(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy("user_id", "event_type").agg(
        F.count_if(F.dayofmonth("ts") <= 15).alias("a"), F.count_if(F.dayofmonth("ts") > 15).alias("b"))
    return e.groupBy("event_type").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_fewer"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_more"))


def next_ids(spark, sf_dir):
    """The next free id per paper: the greatest number so far plus one, five digits."""
    m = load(spark, sf_dir, "corpus_manifest").select(normal_id(F.col("chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL")
    stem, no = F.regexp_extract("chunk_id", "^(.*?)([0-9]+)$", 1), F.regexp_extract("chunk_id", "([0-9]+)$", 1).try_cast("long")
    g = m.select(stem.alias("stem"), no.alias("no")).where("no IS NOT NULL").groupBy("stem").agg(F.max("no").alias("no"))
    return g.select("stem", F.concat("stem", F.lpad((F.col("no") + 1).cast("string"), 5, "0")).alias("next_id"))


QUERIES = {f.__name__: f for f in (
    place_recall, keyword_recall, evidence_metrics, metric_means, answer_category_rollup, latest_judgements, run_ledger_failures, runs_since, call_multiset_difference, next_ids)}

_HT = f"ht AS (SELECT query_id, {_norm('chunk_id')} AS chunk_id, min(fusion_rank) AS rank, max(doc_id) AS doc_id, max(section) AS section, max(page_start) AS page_start, max(page_end) AS page_end FROM retrieval_hits WHERE fusion_rank IS NOT NULL AND chunk_id IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2)"
_JD = f"jd AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT case_id AS query_id, {_norm('raw')} AS chunk_id FROM (SELECT case_id, unnest(evidence_chunk_ids) AS raw FROM citation_audit_v1_queries)) WHERE chunk_id IS NOT NULL)"
_PL = f"pl AS (SELECT {_norm('chunk_id')} AS chunk_id, max(doc_id) AS w_doc, max(section) AS w_section, max(page_start) AS w_from, max(page_end) AS w_to FROM ch GROUP BY 1)"
_AVG = ", ".join(f"round(avg(CASE WHEN best <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}" for k in CUTS)
_PT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: length(x) > 1))"
_ONE = "SELECT DISTINCT ON (claim_id) * FROM audited_claims"
ORACLE = {
    "place_recall": f"""WITH {CH}, {_HT}, {_JD}, {_PL}, w AS (SELECT * FROM jd JOIN pl USING (chunk_id)),
        b AS (SELECT w.query_id, min(CASE WHEN doc_id = w_doc THEN rank END) AS document, min(CASE WHEN doc_id = w_doc AND section = w_section THEN rank END) AS section,
          min(CASE WHEN doc_id = w_doc AND page_start <= w_to AND page_end >= w_from THEN rank END) AS page FROM w JOIN ht ON w.query_id = ht.query_id GROUP BY 1),
        c AS (SELECT b.* EXCLUDE (query_id) FROM (SELECT DISTINCT query_id FROM w) q LEFT JOIN b USING (query_id)),
        l AS (SELECT 'document' AS place, document AS best FROM c UNION ALL SELECT 'section', section FROM c UNION ALL SELECT 'page', page FROM c)
        SELECT place, count(*) AS n_cases, {_AVG} FROM l GROUP BY 1""",
    "keyword_recall": f"""WITH {CH}, {_HT}, q AS (SELECT case_id AS query_id, max(query) AS query FROM citation_audit_v1_queries GROUP BY 1),
        w AS (SELECT query_id, unnest({_PT.format(c='query')}) AS word FROM q), t AS (SELECT {_norm('chunk_id')} AS chunk_id, text FROM ch WHERE text IS NOT NULL),
        h AS (SELECT DISTINCT query_id, unnest({_PT.format(c='text')}) AS word FROM (SELECT query_id, text FROM ht JOIN t USING (chunk_id) WHERE rank <= 5))
        SELECT w.query_id, count(*) AS n_words, count(h.word) AS n_held, round(count(h.word) / count(*), 6) AS recall FROM w LEFT JOIN h ON w.query_id = h.query_id AND w.word = h.word GROUP BY 1""",
    "evidence_metrics": f"""WITH c AS (SELECT claim_id, unnest(citations) AS s FROM ({_ONE})), d AS (SELECT claim_id, {_norm('s.chunk_id')} AS chunk_id,
          s.chunk_id IS NOT NULL AND s.doc_id IS NOT NULL AND s.section IS NOT NULL AND s.page_start IS NOT NULL AND s.page_end IS NOT NULL AS whole FROM c),
        k AS (SELECT DISTINCT {_norm('chunk_id')} AS chunk_id, 1 AS known FROM corpus_manifest),
        a AS (SELECT DISTINCT claim_id, chunk_id, 1 AS asked FROM (SELECT claim_id, {_norm('raw')} AS chunk_id FROM (SELECT claim_id, unnest(candidate_chunk_ids) AS raw FROM audited_claims)) WHERE chunk_id IS NOT NULL)
        SELECT count(*) AS n_citations, count(*) FILTER (WHERE whole) AS n_whole, count(known) AS n_known, count(asked) AS n_asked,
          round(1 - count(DISTINCT d.claim_id) / (SELECT count(*) FROM ({_ONE})), 6) AS without_citation
        FROM d LEFT JOIN k ON d.chunk_id = k.chunk_id LEFT JOIN a ON d.claim_id = a.claim_id AND d.chunk_id = a.chunk_id""",
    "metric_means": f"""WITH {_HT}, e AS (SELECT DISTINCT ON (result_id) * FROM evidence_sufficiency), l AS (
          SELECT case_id, 'confidence' AS name, confidence AS value FROM e UNION ALL SELECT case_id, 'latency_ms', latency_ms FROM e UNION ALL SELECT case_id, 'answerable', CAST(answerable AS DOUBLE) FROM e
          UNION ALL SELECT case_id, 'claim_confidence', confidence FROM ({_ONE}) UNION ALL SELECT case_id, 'supported', CAST(support_level = 'supported' AS DOUBLE) FROM ({_ONE})
          UNION ALL SELECT query_id, 'n_hits', CAST(count(*) AS DOUBLE) FROM ht GROUP BY 1)
        SELECT name, count(*) AS n, count(DISTINCT case_id) AS n_cases, round(avg(value), 6) AS mean, round(avg(CASE WHEN value >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
        FROM l WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""",
    "answer_category_rollup": """WITH c AS (SELECT case_id, max(category) AS category, max(answer) AS answer, max(len(citation_chunk_ids)) AS n_cited FROM citation_audit_v1_queries GROUP BY 1)
        SELECT category, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(answer, ' '), '') = '') AS n_empty, round(avg(length(answer)), 4) AS mean_chars,
        round(avg(CASE WHEN coalesce(n_cited, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS cited, CAST(grouping(category) AS INTEGER) AS is_total FROM c GROUP BY ROLLUP (category)""",
    "latest_judgements": """WITH j AS (SELECT * FROM (SELECT case_id, result_id, support_level, row_number() OVER (PARTITION BY case_id ORDER BY judged_at DESC NULLS LAST, result_id DESC NULLS LAST, support_level DESC NULLS LAST) AS n
        FROM evidence_sufficiency WHERE case_id IS NOT NULL) WHERE n = 1) SELECT c.case_id, result_id, support_level FROM (SELECT DISTINCT case_id FROM citation_audit_v1_queries) c LEFT JOIN j ON c.case_id = j.case_id""",
    "run_ledger_failures": f"""WITH e AS (SELECT DISTINCT ON (result_id) * FROM evidence_sufficiency), l AS (SELECT case_id, count(*) AS n_claims FROM ({_ONE}) GROUP BY 1),
        f AS (SELECT case_id, count(*) AS n_failures, min(fallback_reason) AS first_reason FROM e WHERE fallback_used GROUP BY 1), r AS (SELECT case_id, count(*) AS n_runs FROM e WHERE case_id IS NOT NULL GROUP BY 1)
        SELECT r.case_id, n_runs, coalesce(n_claims, 0) AS n_claims, coalesce(n_failures, 0) AS n_failures, first_reason FROM r LEFT JOIN l ON r.case_id = l.case_id LEFT JOIN f ON r.case_id = f.case_id""",
    "runs_since": "SELECT strftime(judged_at, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT ON (result_id) * FROM evidence_sufficiency WHERE judged_at >= TIMESTAMP '2025-04-01 00:00:00') GROUP BY 1",
    "call_multiset_difference": """WITH e AS (SELECT user_id, event_type, count(*) FILTER (WHERE day(ts) <= 15) AS a, count(*) FILTER (WHERE day(ts) > 15) AS b FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)
        SELECT event_type, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS n_fewer, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS n_more FROM e GROUP BY 1""",
    "next_ids": f"""WITH m AS (SELECT {_norm('chunk_id')} AS c FROM corpus_manifest), g AS (SELECT regexp_extract(c, '^(.*?)([0-9]+)$', 1) AS stem, max(TRY_CAST(regexp_extract(c, '([0-9]+)$', 1) AS BIGINT)) AS no
        FROM m WHERE c IS NOT NULL AND TRY_CAST(regexp_extract(c, '([0-9]+)$', 1) AS BIGINT) IS NOT NULL GROUP BY 1) SELECT stem, stem || lpad(CAST(no + 1 AS VARCHAR), 5, '0') AS next_id FROM g""",
}
