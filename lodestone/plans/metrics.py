"""Relevance and classification metrics over cases, hits, verdicts and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import order as O
from ..tables import load
from .references import _norm


def _relevance(spark, sf_dir):
    cases = load(spark, sf_dir, "citation_audit_v1_queries")
    return M.relevance(M.ranked_modes(load(spark, sf_dir, "retrieval_hits")), M.judgements(cases))


def _claims(spark, sf_dir):
    return load(spark, sf_dir, "audited_claims").select("claim_id", "case_id", "text", "support_level", "confidence").dropDuplicates(["claim_id"])


def _verdicts(spark, sf_dir):
    return load(spark, sf_dir, "evidence_sufficiency").drop("loaded_at", "supporting_chunk_ids").dropDuplicates(["result_id"])


def relevance_judgements(spark, sf_dir):
    return M.judgements(load(spark, sf_dir, "citation_audit_v1_queries")).groupBy("query_id").agg(F.count("*").alias("n_relevant"))


def first_relevant_rank(spark, sf_dir):
    return _relevance(spark, sf_dir).where("first_rank IS NOT NULL").select("query_id", "mode", "first_rank")


def recall_at_k(spark, sf_dir):
    """Success rate (any relevant hit) and coverage (share of relevant chunks found) at k, per mode."""
    long = _relevance(spark, sf_dir).select("mode", "n_relevant", F.explode(F.create_map(*[
        x for k in (1, 3, 5, 10) for x in (F.lit(k), F.col(f"hits_{k}"))])).alias("k", "found"))
    return long.groupBy("mode", "k").agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("success"),
                                         F.round(F.avg(F.col("found") / F.col("n_relevant")), 6).alias("coverage"))


def mrr_ndcg_at_10(spark, sf_dir):
    return _relevance(spark, sf_dir).groupBy("mode").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def mode_comparison(spark, sf_dir):
    """Fused against reranked order per query: first relevant rank (11 where none in ten)."""
    r = _relevance(spark, sf_dir).where("mode IN ('fusion', 'rerank')").groupBy("query_id").pivot("mode", ["fusion", "rerank"]).agg(
        F.min(F.when(F.col("first_rank") <= 10, F.col("first_rank"))))
    r = r.select("query_id", F.coalesce("fusion", F.lit(11)).alias("fusion_rank"), F.coalesce("rerank", F.lit(11)).alias("rerank_rank"))
    d = F.col("fusion_rank") - F.col("rerank_rank")
    return r.select("query_id", "fusion_rank", "rerank_rank", d.alias("delta"), F.when(d > 0, "improved").when(d < 0, "regressed").otherwise("same").alias("outcome"))


def metrics_by_category_rollup(spark, sf_dir):
    cat = load(spark, sf_dir, "citation_audit_v1_queries").groupBy(F.col("case_id").alias("query_id")).agg(F.max("category").alias("category"))
    return _relevance(spark, sf_dir).where("mode = 'fusion'").join(cat, "query_id").rollup(F.coalesce("category", F.lit("none")).alias("category")).agg(
        F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"))


def rank_overlap_correlation(spark, sf_dir):
    """Dense against sparse: shared hits in the top ten, and the correlation of ranks (11 where missing)."""
    r = M.ranked_modes(load(spark, sf_dir, "retrieval_hits")).where("mode IN ('dense', 'sparse') AND rank <= 10")
    p = r.groupBy("query_id", "chunk_id").pivot("mode", ["dense", "sparse"]).agg(F.min("rank"))
    return p.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("dense").isNotNull() & F.col("sparse").isNotNull()).alias("n_shared"),
                 F.round(F.corr(F.coalesce("dense", F.lit(11)).cast("double"), F.coalesce("sparse", F.lit(11)).cast("double")), 6).alias("rank_corr"))


def no_answer_fpr(spark, sf_dir):
    """Of the cases judged unanswerable: how many retrieval answers anyway, how many the gate lets through."""
    v = M.latest(_verdicts(spark, sf_dir), ["case_id"], ["judged_at", "result_id"]).where("NOT answerable")
    hit = load(spark, sf_dir, "retrieval_hits").where("fusion_rank <= 10").select(F.col("query_id").alias("case_id")).distinct().withColumn("hit", F.lit(1))
    j = v.join(hit, "case_id", "left")
    return j.agg(F.count("*").alias("n"), F.count("hit").alias("n_retrieved"), F.count_if(F.col("support_level") == "strong").alias("n_passed"))


def confusion_metrics(spark, sf_dir):
    v = _verdicts(spark, sf_dir).withColumn("passed", F.col("support_level") == "strong")
    return M.confusion(v, "answerable", "passed")


def per_class_precision_recall(spark, sf_dir):
    """The first judgement of a case against its last one, per support level."""
    v = _verdicts(spark, sf_dir).groupBy("case_id").agg(F.min(F.struct("judged_at", "result_id", "support_level")).alias("a"),
                                                         F.max(F.struct("judged_at", "result_id", "support_level")).alias("b"), F.count("*").alias("n"))
    return M.per_class(v.where("n > 1").select(F.col("a.support_level").alias("first"), F.col("b.support_level").alias("last")), "first", "last")


def confusion_cube(spark, sf_dir):
    return _verdicts(spark, sf_dir).cube("answerable", "support_level").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("gid"))


def grounding_score(spark, sf_dir):
    lev = F.col("support_level")
    return _claims(spark, sf_dir).groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if(lev == "supported").alias("supported"), F.count_if(lev == "partial").alias("partial"),
        F.count_if(lev == "unsupported").alias("unsupported")).withColumn("score", M.ratio(F.col("supported"), F.col("n"))).withColumn(
        "all_supported", F.col("supported") == F.col("n"))


def claim_metrics(spark, sf_dir):
    """Support rate with partial counting half, mean confidence, per category."""
    cat = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("category").alias("category"))
    lev = F.col("support_level")
    weight = F.when(lev == "supported", 1.0).when(lev == "partial", 0.5).otherwise(0.0)
    return _claims(spark, sf_dir).join(cat, "case_id").groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.avg(weight), 6).alias("support_like"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def citation_micro_pr(spark, sf_dir):
    """Micro precision and recall of the cited against the evidence chunk ids."""
    cases = load(spark, sf_dir, "citation_audit_v1_queries")
    ev = M.judgements(cases).withColumnRenamed("query_id", "case_id")
    ci = M.ids_of(cases, "case_id", "citation_chunk_ids")
    both = ci.withColumn("c", F.lit(1)).join(ev.withColumn("e", F.lit(1)), ["case_id", "chunk_id"], "full_outer").agg(
        F.count("c").alias("cited"), F.count("e").alias("evidence"), F.count_if(F.col("c").isNotNull() & F.col("e").isNotNull()).alias("both"))
    return both.select("cited", "evidence", "both", M.ratio(F.col("both"), F.col("cited")).alias("prec"), M.ratio(F.col("both"), F.col("evidence")).alias("rec"))


def latency_by_model(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    ranks, p95 = O.interpolated("p95", 0.95)
    high = O.order_statistics(v, ["model", "prompt_version"], "latency_ms", ranks, 20).select(F.col("model").alias("m"), F.col("prompt_version").alias("p"), F.round(p95, 4).alias("p95_ms"))
    base = v.groupBy("model", "prompt_version").agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        F.sum("api_call_count").alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.count_if("cache_hit").alias("cache_hits"),
        F.count_if("fallback_used").alias("fallbacks"))
    return base.join(high, base["model"].eqNullSafe(F.col("m")) & base["prompt_version"].eqNullSafe(F.col("p")), "left").drop("m", "p")


def support_level_rollup(spark, sf_dir):
    return _verdicts(spark, sf_dir).rollup("model", "support_level").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


QUERIES = {f.__name__: f for f in (
    relevance_judgements, first_relevant_rank, recall_at_k, mrr_ndcg_at_10, mode_comparison, metrics_by_category_rollup, rank_overlap_correlation,
    no_answer_fpr, confusion_metrics, per_class_precision_recall, confusion_cube, grounding_score, claim_metrics, citation_micro_pr, latency_by_model,
    support_level_rollup)}

_J = f"jd AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT case_id AS query_id, {_norm('raw')} AS chunk_id FROM (SELECT case_id, unnest(evidence_chunk_ids) AS raw FROM citation_audit_v1_queries)) WHERE chunk_id IS NOT NULL)"
_R = "rk AS (SELECT query_id, chunk_id, mode, min(rank) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT query_id, {_norm('chunk_id')} AS chunk_id, '{m}' AS mode, {m}_rank AS rank FROM retrieval_hits WHERE {m}_rank IS NOT NULL" for m in M.MODES) + ") GROUP BY 1, 2, 3)"
_REL = f"""{_J}, {_R}, nr AS (SELECT query_id, count(*) AS n_relevant FROM jd GROUP BY 1),
ev AS (SELECT query_id, n_relevant, unnest(['dense', 'sparse', 'fusion', 'rerank']) AS mode FROM nr),
ht AS (SELECT query_id, mode, min(rank) AS first_rank, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, count(*) FILTER (WHERE rank <= 1) AS hits_1,
 count(*) FILTER (WHERE rank <= 3) AS hits_3, count(*) FILTER (WHERE rank <= 5) AS hits_5, count(*) FILTER (WHERE rank <= 10) AS hits_10 FROM rk SEMI JOIN jd USING (query_id, chunk_id) GROUP BY 1, 2),
re AS (SELECT ev.query_id, ev.mode, n_relevant, first_rank, coalesce(hits_1, 0) AS hits_1, coalesce(hits_3, 0) AS hits_3, coalesce(hits_5, 0) AS hits_5, coalesce(hits_10, 0) AS hits_10,
 CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0.0 END AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
 FROM ev LEFT JOIN ht ON ev.query_id = ht.query_id AND ev.mode = ht.mode)"""
_V = "v AS (SELECT DISTINCT ON (result_id) * FROM evidence_sufficiency)"
_C = "c AS (SELECT DISTINCT claim_id, case_id, text, support_level, confidence FROM audited_claims)"
_CI = f"ci AS (SELECT DISTINCT case_id AS query_id, chunk_id FROM (SELECT case_id, {_norm('raw')} AS chunk_id FROM (SELECT case_id, unnest(citation_chunk_ids) AS raw FROM citation_audit_v1_queries)) WHERE chunk_id IS NOT NULL)"
_RT = "round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"
ORACLE = {
    "relevance_judgements": f"WITH {_J} SELECT query_id, count(*) AS n_relevant FROM jd GROUP BY 1",
    "first_relevant_rank": f"WITH {_REL} SELECT query_id, mode, first_rank FROM re WHERE first_rank IS NOT NULL",
    "recall_at_k": f"""WITH {_REL}, lo AS (SELECT mode, n_relevant, k, CASE k WHEN 1 THEN hits_1 WHEN 3 THEN hits_3 WHEN 5 THEN hits_5 ELSE hits_10 END AS found FROM re, (SELECT CAST(unnest([1, 3, 5, 10]) AS INTEGER) AS k))
        SELECT mode, k, count(*) AS n_queries, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 6) AS success, round(avg(found / n_relevant), 6) AS coverage FROM lo GROUP BY 1, 2""",
    "mrr_ndcg_at_10": f"WITH {_REL} SELECT mode, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM re GROUP BY 1",
    "mode_comparison": f"""WITH {_REL}, p AS (SELECT query_id, coalesce(min(first_rank) FILTER (WHERE mode = 'fusion' AND first_rank <= 10), 11) AS fusion_rank,
        coalesce(min(first_rank) FILTER (WHERE mode = 'rerank' AND first_rank <= 10), 11) AS rerank_rank FROM re GROUP BY 1)
        SELECT *, fusion_rank - rerank_rank AS delta, CASE WHEN fusion_rank > rerank_rank THEN 'improved' WHEN fusion_rank < rerank_rank THEN 'regressed' ELSE 'same' END AS outcome FROM p""",
    "metrics_by_category_rollup": f"""WITH {_REL}, cat AS (SELECT case_id, coalesce(max(category), 'none') AS category FROM citation_audit_v1_queries GROUP BY 1)
        SELECT category, count(*) AS n, round(avg(rr), 6) AS mrr FROM re JOIN cat ON re.query_id = cat.case_id WHERE mode = 'fusion' GROUP BY ROLLUP (category)""",
    "rank_overlap_correlation": f"""WITH {_R}, p AS (SELECT query_id, chunk_id, min(rank) FILTER (WHERE mode = 'dense') AS d, min(rank) FILTER (WHERE mode = 'sparse') AS s FROM rk
        WHERE mode IN ('dense', 'sparse') AND rank <= 10 GROUP BY 1, 2) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE d IS NOT NULL AND s IS NOT NULL) AS n_shared,
        round(corr(coalesce(d, 11), coalesce(s, 11)), 6) AS rank_corr FROM p""",
    "no_answer_fpr": f"""WITH {_V}, l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY judged_at DESC NULLS LAST, result_id DESC) = 1),
        h AS (SELECT DISTINCT query_id FROM retrieval_hits WHERE fusion_rank <= 10)
        SELECT count(*) AS n, count(h.query_id) AS n_retrieved, count(*) FILTER (WHERE support_level = 'strong') AS n_passed FROM l LEFT JOIN h ON l.case_id = h.query_id WHERE NOT answerable""",
    "confusion_metrics": f"""WITH {_V}, x AS (SELECT coalesce(answerable, FALSE) AS t, coalesce(support_level = 'strong', FALSE) AS p FROM v),
        n AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM x)
        SELECT *, {_RT.format(a='tp + tn', b='tp + tn + fp + fn')} AS accuracy, {_RT.format(a='tp', b='tp + fp')} AS prec, {_RT.format(a='tp', b='tp + fn')} AS rec,
        {_RT.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1, {_RT.format(a='fp', b='fp + tn')} AS fpr FROM n""",
    "per_class_precision_recall": f"""WITH {_V}, o AS (SELECT case_id, support_level, row_number() OVER (PARTITION BY case_id ORDER BY judged_at NULLS FIRST, result_id, support_level) AS a,
        row_number() OVER (PARTITION BY case_id ORDER BY judged_at DESC NULLS LAST, result_id DESC, support_level DESC) AS b, count(*) OVER (PARTITION BY case_id) AS n FROM v),
        p AS (SELECT x.support_level AS e, y.support_level AS p FROM o x JOIN o y ON x.case_id = y.case_id AND x.a = 1 AND y.b = 1 WHERE x.n > 1),
        l AS (SELECT e AS label FROM p UNION SELECT p FROM p)
        SELECT label, count(*) FILTER (WHERE e = label) AS n_expected, count(*) FILTER (WHERE p = label) AS n_predicted,
        {_RT.format(a='count(*) FILTER (WHERE e = label AND p = label)', b='count(*) FILTER (WHERE p = label)')} AS prec,
        {_RT.format(a='count(*) FILTER (WHERE e = label AND p = label)', b='count(*) FILTER (WHERE e = label)')} AS rec FROM l, p GROUP BY label""",
    "confusion_cube": f"WITH {_V} SELECT answerable, support_level, count(*) AS n, CAST(grouping(answerable, support_level) AS INTEGER) AS gid FROM v GROUP BY CUBE (answerable, support_level)",
    "grounding_score": f"""WITH {_C} SELECT case_id, count(*) AS n, count(*) FILTER (WHERE support_level = 'supported') AS supported, count(*) FILTER (WHERE support_level = 'partial') AS partial,
        count(*) FILTER (WHERE support_level = 'unsupported') AS unsupported, {_RT.format(a="count(*) FILTER (WHERE support_level = 'supported')", b='count(*)')} AS score,
        count(*) FILTER (WHERE support_level = 'supported') = count(*) AS all_supported FROM c GROUP BY 1""",
    "claim_metrics": f"""WITH {_C}, cat AS (SELECT case_id, max(category) AS category FROM citation_audit_v1_queries GROUP BY 1) SELECT category, count(*) AS n,
        round(avg(CASE support_level WHEN 'supported' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 6) AS support_like, round(avg(confidence), 6) AS mean_confidence FROM c JOIN cat USING (case_id) GROUP BY 1""",
    "citation_micro_pr": f"""WITH {_J}, {_CI}, x AS (SELECT ci.query_id AS c, jd.query_id AS e FROM ci FULL OUTER JOIN jd ON ci.query_id = jd.query_id AND ci.chunk_id = jd.chunk_id),
        n AS (SELECT count(c) AS cited, count(e) AS evidence, count(*) FILTER (WHERE c IS NOT NULL AND e IS NOT NULL) AS "both" FROM x)
        SELECT *, {_RT.format(a='"both"', b='cited')} AS prec, {_RT.format(a='"both"', b='evidence')} AS rec FROM n""",
    "latency_by_model": f"""WITH {_V} SELECT model, prompt_version, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms,
        CAST(sum(api_call_count) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE fallback_used) AS fallbacks FROM v GROUP BY 1, 2""",
    "support_level_rollup": f"WITH {_V} SELECT model, support_level, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM v GROUP BY ROLLUP (model, support_level)",
}
