"""Lexical audit queries: claims, evidence, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import corpus as C
from ..operators import filters as P
from ..operators import metrics as M
from ..operators.references import normal_id
from ..session import written
from ..tables import load
from .references import _norm
from .retrieval import NOTICES


def _claims(spark, sf_dir):
    return load(spark, sf_dir, "audited_claims").select("claim_id", "case_id", "text").dropDuplicates(["claim_id"])


def _evidence(spark, sf_dir):
    return C.chunks(load(spark, sf_dir, "retrieval_hits")).select(normal_id(F.col("chunk_id")).alias("chunk_id"), "text")


def _scored(spark, sf_dir):
    pairs = M.ids_of(load(spark, sf_dir, "audited_claims"), "claim_id", "candidate_chunk_ids")
    return A.overlaps(_claims(spark, sf_dir), _evidence(spark, sf_dir), pairs)


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("answer").alias("answer"), F.max("query").alias("query"))


def claim_evidence_overlap(spark, sf_dir):
    return _scored(spark, sf_dir).select("claim_id", "chunk_id", "score")


def claim_verdicts(spark, sf_dir):
    return A.verdicts(_claims(spark, sf_dir), _scored(spark, sf_dir))


def claim_verdict_summary(spark, sf_dir):
    v = claim_verdicts(spark, sf_dir)
    return v.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == x).alias(x) for x in ("supported", "partial", "unsupported")],
                 F.round(F.avg((F.col("verdict") == "supported").cast("double")), 4).alias("support_rate"))


def numeric_consistency(spark, sf_dir):
    return A.numeric_consistency(_claims(spark, sf_dir), _scored(spark, sf_dir))


def polarity_contradiction(spark, sf_dir):
    return A.polarity(_claims(spark, sf_dir), _scored(spark, sf_dir))


def overclaim_severity(spark, sf_dir):
    return _claims(spark, sf_dir).select("claim_id", T.overclaim(F.col("text")).alias("severity"))


def error_type_precedence(spark, sf_dir):
    """One error type per claim: number, then contradiction, then severe overclaim, then lack of support."""
    claims, scored = _claims(spark, sf_dir), written(_scored(spark, sf_dir), "claim-pairs")  # pairs are scored once
    j = A.verdicts(claims, scored).join(A.numeric_consistency(claims, scored).withColumnRenamed("status", "num"), "claim_id").join(
        A.polarity(claims, scored).withColumnRenamed("status", "pol"), "claim_id").join(overclaim_severity(spark, sf_dir), "claim_id")
    kind = F.when(F.col("num") == "numerical_error", "numerical").when(F.col("pol") == "contradiction", "contradiction").when(
        (F.col("severity") == "severe") & (F.col("verdict") != "supported"), "overclaim").when(F.col("verdict") == "unsupported", "unsupported").when(
        F.col("verdict") == "partial", "review").otherwise("supported")
    return j.select("claim_id", kind.alias("error_type"))


def claim_sentences(spark, sf_dir):
    """Sentences of the answers that are long enough to be claims."""
    s = _answers(spark, sf_dir).select("case_id", F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence"))
    return s.where(F.length("sentence") >= 20).select("case_id", "pos", F.length("sentence").alias("n_chars"), T.word_count(F.col("sentence")).alias("n_words"))


def citation_marks(spark, sf_dir):
    c = _answers(spark, sf_dir).select("case_id", T.citations(F.col("answer")).alias("c")).where(F.size("c") > 0)
    return c.select("case_id", F.array_join("c", ";").alias("marks"))


def evidence_quality(spark, sf_dir):
    """Score 0 to 100 and label of every chunk text, by readability and noise."""
    t = C.chunks(load(spark, sf_dir, "retrieval_hits")).select("chunk_id", F.coalesce("text", F.lit("")).alias("t"))
    n_words = F.size(F.regexp_extract_all("t", F.lit("[A-Za-z]{2,}"), F.lit(0)))
    low = F.lower("t")
    signs = 1 - F.length(F.regexp_replace("t", "[^A-Za-z0-9一-鿿]", "")) / F.greatest(F.lit(1), F.length("t"))
    reasons = [P.has_phrase(F.col("t"), NOTICES), F.length("t") < 60, low.startswith("table ") | low.startswith("figure "), signs > 0.42, n_words < 8]
    bonus = F.when((n_words >= 18) & F.col("t").rlike("[.。;；]"), 18).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 45 + bonus - 16 * sum(r.cast("int") for r in reasons)))
    hard = reasons[0] | reasons[2] | reasons[3] | (F.length("t") < 40)
    return t.select("chunk_id", score.alias("score"), F.when(hard, "unusable").when(score >= 70, "high").when(score >= 48, "medium").when(
        score >= 30, "low").otherwise("unusable").alias("label"))


def _expected(spark, sf_dir):
    c = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("expected_claims").alias("e"))
    return c.select("case_id", F.posexplode("e").alias("exp_no", "x")).select("case_id", "exp_no", F.col("x.text").alias("text"), F.col("x.support_level").alias("level"))


def claim_alignment_dice(spark, sf_dir):
    return A.best_alignment(_expected(spark, sf_dir), _claims(spark, sf_dir))


def claim_alignment_greedy(spark, sf_dir):
    return A.align(_expected(spark, sf_dir), _claims(spark, sf_dir))


def gate_decision(spark, sf_dir):
    e = load(spark, sf_dir, "evidence_sufficiency")
    ids = M.ids_of(e, "result_id", "supporting_chunk_ids").groupBy("result_id").agg(F.collect_set("chunk_id").alias("ids"))
    j = e.select("result_id", "support_level", "confidence", "answerable").dropDuplicates(["result_id"]).join(ids, "result_id", "left")
    known = load(spark, sf_dir, "corpus_manifest").select(normal_id(F.col("chunk_id")).alias("chunk_id")).distinct()
    return A.gate(j, known)


def citation_integrity(spark, sf_dir):
    """Per case: ids it cites, and of those how many its own hits do not hold."""
    cited = M.ids_of(load(spark, sf_dir, "citation_audit_v1_queries"), "case_id", "citation_chunk_ids")
    own = load(spark, sf_dir, "retrieval_hits").select(F.col("query_id").alias("case_id"), normal_id(F.col("chunk_id")).alias("chunk_id")).distinct()
    lost = cited.join(own, ["case_id", "chunk_id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("n_lost"))
    return cited.groupBy("case_id").agg(F.count("*").alias("n_cited")).join(lost, "case_id", "left").select("case_id", "n_cited", F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def missing_entities(spark, sf_dir):
    """Names and numbers of a query that its answer does not mention."""
    names = F.array_distinct(F.regexp_extract_all("query", F.lit(r"[A-Z][a-z]+[A-Z0-9-][A-Za-z0-9-]*"), F.lit(0)))
    m = _answers(spark, sf_dir).select("case_id", F.filter(names, lambda n: ~F.contains(F.coalesce("answer", F.lit("")), n)).alias("m"))
    return m.where(F.size("m") > 0).select("case_id", F.array_join(F.array_sort("m"), ";").alias("missing"))


def rerank_backend_scores(spark, sf_dir):
    """The lexical reranker over the stored hits, through the backend slot.  A hit stored
    without text is judged by the text of its chunk; hits of chunks without any stay out."""
    hits = load(spark, sf_dir, "retrieval_hits")
    h = hits.where("fusion_rank <= 20").groupBy("hit_id").agg(*[F.max(c).alias(c) for c in ("query_id", "chunk_id", "text")])
    lacking = h.where("text IS NULL").drop("text").join(C.chunks(hits).where("text IS NOT NULL").select("chunk_id", "text"), "chunk_id")
    h = h.where("text IS NOT NULL").unionByName(lacking)
    q = _answers(spark, sf_dir).select(F.col("case_id").alias("query_id"), F.col("query").alias("question"))
    rows = h.join(q, "query_id").select(F.col("hit_id").cast("string").alias("id"), "question", F.col("text").alias("passage"))
    return A.judge_with(rows, A.lexical_backend, "score double")


QUERIES = {f.__name__: f for f in (
    claim_evidence_overlap, claim_verdicts, claim_verdict_summary, numeric_consistency, polarity_contradiction, overclaim_severity, error_type_precedence,
    claim_sentences, citation_marks, evidence_quality, claim_alignment_dice, claim_alignment_greedy, gate_decision, citation_integrity, missing_entities,
    rerank_backend_scores)}

_CH = f"chx AS (SELECT chunk_id, max(text) AS text FROM retrieval_hits WHERE chunk_id IS NOT NULL GROUP BY 1), ev AS (SELECT {_norm('chunk_id')} AS chunk_id, text FROM chx)"
_HAN = "regexp_extract_all(t, '[一-鿿]{2,}')"
_AT = f"list_distinct(list_concat(list_concat(regexp_extract_all(t, '[a-z][a-z0-9_-]+|[0-9]+(?:\\.[0-9]+)?%?'), {_HAN}), flatten(list_transform({_HAN}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
_CL = "cl AS (SELECT DISTINCT ON (claim_id) claim_id, case_id, text FROM audited_claims)"
_PR = f"pr AS (SELECT DISTINCT claim_id, chunk_id FROM (SELECT claim_id, {_norm('raw')} AS chunk_id FROM (SELECT claim_id, unnest(candidate_chunk_ids) AS raw FROM audited_claims)) WHERE chunk_id IS NOT NULL)"
_SC = f"""{_CH}, {_CL}, {_PR}, ct AS (SELECT claim_id, text AS claim, {_AT} AS ct FROM (SELECT claim_id, text, lower(coalesce(text, '')) AS t FROM cl)),
et AS (SELECT chunk_id, text AS evidence, {_AT} AS et FROM (SELECT chunk_id, text, lower(coalesce(text, '')) AS t FROM ev)),
sc AS (SELECT claim_id, chunk_id, claim, evidence, ct, et, round(len(list_intersect(ct, et)) / greatest(1, len(ct)), 6) AS score FROM pr JOIN ct USING (claim_id) JOIN et USING (chunk_id))"""
_VD = """vd AS (SELECT cl.claim_id, coalesce(b.best, 0) AS best_score, CASE WHEN coalesce(b.best, 0) >= 0.18 THEN 'supported' WHEN coalesce(b.best, 0) >= 0.10 THEN 'partial' ELSE 'unsupported' END AS verdict,
coalesce(b.evidence, '') AS evidence FROM cl LEFT JOIN (SELECT claim_id, max(score) AS best, array_to_string((list(chunk_id ORDER BY chunk_id))[1:3], ',') AS evidence FROM
(SELECT *, max(score) OVER (PARTITION BY claim_id) AS best FROM sc WHERE score > 0) WHERE score = best GROUP BY 1) b ON cl.claim_id = b.claim_id)"""


def _nums(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '\\[[0-9 ,;–-]+\\]', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b(figure|fig\\.?|table|section|sec\\.?)\\s*[0-9]+(\\.[0-9]+)*', ' ', 'g')"
    t = f"regexp_replace({t}, '[A-Za-z][A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*', ' ', 'g')"
    return f"list_distinct(regexp_extract_all({t}, '[0-9]+(?:\\.[0-9]+)?%?'))"


_NC = f"""nc AS (SELECT cl.claim_id, CASE WHEN len({_nums('cl.text')}) = 0 THEN 'not_applicable' WHEN s.hit THEN 'consistent' WHEN s.any_number THEN 'numerical_error' ELSE 'uncertain' END AS status
FROM cl LEFT JOIN (SELECT claim_id, bool_or(len({_nums('evidence')}) > 0) AS any_number, bool_or(list_has_any({_nums('evidence')}, {_nums('claim')})) AS hit FROM sc WHERE score >= 0.2 GROUP BY 1) s ON cl.claim_id = s.claim_id)"""
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda t, words: "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in words) + ")"
_OPP = " OR ".join(f"({_ANY('claim', a)} AND {_ANY('evidence', b)}) OR ({_ANY('claim', b)} AND {_ANY('evidence', a)})" for a, b in A.OPPOSED)
_PO = f"""po AS (SELECT cl.claim_id, CASE WHEN s.flip IS NULL THEN 'uncertain' WHEN s.flip THEN 'contradiction' ELSE 'consistent' END AS status FROM cl LEFT JOIN
(SELECT claim_id, bool_or((list_has_any(ct, {_LIST(T.NEGATIONS)}) <> list_has_any(et, {_LIST(T.NEGATIONS)})) AND score >= 0.35 AND ({_OPP})) AS flip FROM sc WHERE score >= 0.14 GROUP BY 1) s ON cl.claim_id = s.claim_id)"""
_OC = f"oc AS (SELECT claim_id, CASE WHEN {_ANY('coalesce(text, ' + chr(39) * 2 + ')', T.SEVERE_TERMS)} THEN 'severe' WHEN {_ANY('coalesce(text, ' + chr(39) * 2 + ')', T.MILD_TERMS)} THEN 'mild' ELSE 'none' END AS severity FROM cl)"
_AN = "an AS (SELECT case_id, max(answer) AS answer, max(query) AS query FROM citation_audit_v1_queries GROUP BY 1)"
_BOIL = " OR ".join(f"contains(low, '{w}')" for w in NOTICES)
_ALIGN = f"""ex AS (SELECT case_id, CAST(i - 1 AS INTEGER) AS exp_no, e[i].text AS text FROM (SELECT case_id, max(expected_claims) AS e, unnest(range(1, len(max(expected_claims)) + 1)) AS i FROM citation_audit_v1_queries GROUP BY case_id)), {_CL},
d AS (SELECT ex.case_id, exp_no, claim_id, {{tok}} AS a, {{tok2}} AS b FROM ex JOIN cl ON ex.case_id = cl.case_id)"""
_PT = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: length(x) > 1))"
_PW = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]{{2,}}'))"
ORACLE = {
    "claim_evidence_overlap": f"WITH {_SC} SELECT claim_id, chunk_id, score FROM sc",
    "claim_verdicts": f"WITH {_SC}, {_VD} SELECT * FROM vd",
    "claim_verdict_summary": f"""WITH {_SC}, {_VD} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'partial') AS partial,
        count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported, round(avg(CASE WHEN verdict = 'supported' THEN 1.0 ELSE 0.0 END), 4) AS support_rate FROM vd""",
    "numeric_consistency": f"WITH {_SC}, {_NC} SELECT * FROM nc",
    "polarity_contradiction": f"WITH {_SC}, {_PO} SELECT * FROM po",
    "overclaim_severity": f"WITH {_CL}, {_OC} SELECT * FROM oc",
    "error_type_precedence": f"""WITH {_SC}, {_VD}, {_NC}, {_PO}, {_OC} SELECT vd.claim_id, CASE WHEN nc.status = 'numerical_error' THEN 'numerical' WHEN po.status = 'contradiction' THEN 'contradiction'
        WHEN severity = 'severe' AND verdict <> 'supported' THEN 'overclaim' WHEN verdict = 'unsupported' THEN 'unsupported' WHEN verdict = 'partial' THEN 'review' ELSE 'supported' END AS error_type
        FROM vd JOIN nc ON vd.claim_id = nc.claim_id JOIN po ON vd.claim_id = po.claim_id JOIN oc ON vd.claim_id = oc.claim_id""",
    "claim_sentences": f"""WITH {_AN}, s AS (SELECT case_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(answer, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x)), lambda x: length(x) > 0) AS l FROM an), e AS (SELECT case_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS s FROM (SELECT case_id, l, unnest(range(1, len(l) + 1)) AS i FROM s))
        SELECT case_id, pos, CAST(length(s) AS INTEGER) AS n_chars, CAST(len(string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ')) AS INTEGER) AS n_words FROM e WHERE length(s) >= 20""",
    "citation_marks": f"""WITH {_AN}, c AS (SELECT case_id, list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(coalesce(answer, ''), '\\[[0-9]{{1,3}}\\]'),
        regexp_extract_all(coalesce(answer, ''), '[A-Z][A-Za-z-]+ et al\\.?\\s*\\([0-9]{{4}}\\)')), regexp_extract_all(coalesce(answer, ''), '\\([A-Z][A-Za-z-]+,\\s*[0-9]{{4}}\\)')))) AS c FROM an)
        SELECT case_id, array_to_string(c, ';') AS marks FROM c WHERE len(c) > 0""",
    "evidence_quality": f"""WITH {_CH}, t AS (SELECT chunk_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{2,}}')) AS nw FROM chx),
        r AS (SELECT *, ({_BOIL}) AS r1,
        length(t) < 60 AS r2, starts_with(low, 'table ') OR starts_with(low, 'figure ') AS r3, 1 - length(regexp_replace(t, '[^A-Za-z0-9一-鿿]', '', 'g')) / greatest(1, length(t)) > 0.42 AS r4, nw < 8 AS r5 FROM t),
        s AS (SELECT *, greatest(0, least(100, 45 + CASE WHEN nw >= 18 AND regexp_matches(t, '[.。;；]') THEN 18 ELSE 0 END - 16 * (CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) + CAST(r4 AS INT) + CAST(r5 AS INT)))) AS score FROM r)
        SELECT chunk_id, CAST(score AS INTEGER) AS score, CASE WHEN r1 OR r3 OR r4 OR length(t) < 40 THEN 'unusable' WHEN score >= 70 THEN 'high' WHEN score >= 48 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'unusable' END AS label FROM s""",
    "claim_alignment_dice": "WITH " + _ALIGN.format(tok=_PT.format(c="ex.text"), tok2=_PT.format(c="cl.text")) + """
        SELECT case_id, exp_no, claim_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, exp_no ORDER BY score DESC, claim_id) AS n FROM
        (SELECT case_id, exp_no, claim_id, round(coalesce(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0), 6) AS score FROM d)) WHERE n = 1""",
    "gate_decision": f"""WITH e AS (SELECT DISTINCT ON (result_id) result_id, support_level, confidence, answerable FROM evidence_sufficiency),
        i AS (SELECT DISTINCT result_id, chunk_id FROM (SELECT result_id, {_norm('raw')} AS chunk_id FROM (SELECT result_id, unnest(supporting_chunk_ids) AS raw FROM evidence_sufficiency)) WHERE chunk_id IS NOT NULL),
        n AS (SELECT result_id, count(*) AS n, count(*) FILTER (WHERE chunk_id NOT IN (SELECT {_norm('chunk_id')} FROM corpus_manifest)) AS f FROM i GROUP BY 1),
        r AS (SELECT e.result_id, CASE WHEN NOT coalesce(support_level IN ('strong', 'partial', 'unsupported'), FALSE) THEN 'unknown_level' WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'bad_confidence'
        WHEN coalesce(f, 0) > 0 THEN 'foreign_evidence' WHEN support_level <> 'unsupported' AND coalesce(n, 0) = 0 THEN 'no_evidence' WHEN support_level = 'strong' AND NOT coalesce(answerable, FALSE) THEN 'level_mismatch'
        WHEN support_level <> 'strong' THEN 'not_strong' ELSE '' END AS reason FROM e LEFT JOIN n ON e.result_id = n.result_id) SELECT *, CASE WHEN reason = '' THEN 'accept' ELSE 'reject' END AS decision FROM r""",
    "citation_integrity": f"""WITH c AS (SELECT DISTINCT case_id, chunk_id FROM (SELECT case_id, {_norm('raw')} AS chunk_id FROM (SELECT case_id, unnest(citation_chunk_ids) AS raw FROM citation_audit_v1_queries)) WHERE chunk_id IS NOT NULL),
        h AS (SELECT DISTINCT query_id, {_norm('chunk_id')} AS chunk_id FROM retrieval_hits) SELECT c.case_id, count(*) AS n_cited, count(*) FILTER (WHERE h.chunk_id IS NULL) AS n_lost FROM c LEFT JOIN h ON c.case_id = h.query_id AND c.chunk_id = h.chunk_id GROUP BY 1""",
    "missing_entities": f"""WITH {_AN}, m AS (SELECT case_id, list_sort(list_filter(list_distinct(regexp_extract_all(query, '[A-Z][a-z]+[A-Z0-9-][A-Za-z0-9-]*')), lambda n: NOT contains(coalesce(answer, ''), n))) AS m FROM an)
        SELECT case_id, array_to_string(m, ';') AS missing FROM m WHERE len(m) > 0""",
    "rerank_backend_scores": f"""WITH {_AN}, {_CH}, h AS (SELECT hit_id, max(query_id) AS query_id, max(chunk_id) AS chunk_id, max(text) AS text FROM retrieval_hits WHERE fusion_rank <= 20 GROUP BY 1),
        t AS (SELECT h.hit_id, {_PW.format(c='an.query')} AS q, {_PW.format(c='coalesce(h.text, chx.text)')} AS p FROM h JOIN an ON an.case_id = h.query_id LEFT JOIN chx ON h.chunk_id = chx.chunk_id WHERE coalesce(h.text, chx.text) IS NOT NULL)
        SELECT CAST(hit_id AS VARCHAR) AS id, round(len(list_intersect(q, p)) / greatest(1, len(q)), 6) AS score FROM t""",
    "claim_alignment_greedy": "WITH RECURSIVE " + _ALIGN.format(tok=_PT.format(c="ex.text"), tok2=_PT.format(c="cl.text")) + """,
        s AS (SELECT * FROM (SELECT case_id, exp_no, claim_id, round(coalesce(2 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0), 0), 6) AS score FROM d) WHERE score >= 0.55),
        r AS (SELECT case_id, [exp_no] AS te, [claim_id] AS tf, exp_no, claim_id, score FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, exp_no, claim_id) = 1
          UNION ALL (SELECT case_id, list_append(te, e), list_append(tf, c), e, c, x FROM (SELECT r.case_id, te, tf, s.exp_no AS e, s.claim_id AS c, s.score AS x,
            row_number() OVER (PARTITION BY r.case_id ORDER BY s.score DESC, s.exp_no, s.claim_id) AS n FROM r JOIN s ON r.case_id = s.case_id
            WHERE NOT list_contains(te, s.exp_no) AND NOT list_contains(tf, s.claim_id)) WHERE n = 1))
        SELECT case_id, exp_no, claim_id, score FROM r""",
}
