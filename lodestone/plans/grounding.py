"""Whether claims, citations and answers stand on the evidence of their case."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import metrics as M
from ..operators.references import normal_id
from ..tables import load
from .audit import _AN, _AT, _CH, _CL, _SC, _answers, _claims, _evidence, _scored
from .references import _norm


def _case_pairs(spark, sf_dir):
    """Every claim with every chunk that the hits of its case hold."""
    own = load(spark, sf_dir, "retrieval_hits").where("query_id IS NOT NULL").select(
        F.col("query_id").alias("case_id"), normal_id(F.col("chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    return _claims(spark, sf_dir).select("claim_id", "case_id").join(own, "case_id").select("claim_id", "chunk_id")


def claim_case_overlap(spark, sf_dir):
    """Every claim against all evidence of its case: the best score, how many chunks reach a
    tenth, and the verdict.  Claims without any evidence stay, as unsupported."""
    claims, scored = _claims(spark, sf_dir), A.overlaps(_claims(spark, sf_dir), _evidence(spark, sf_dir), _case_pairs(spark, sf_dir))
    best = scored.groupBy("claim_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= A.PARTIAL).alias("n_near"))
    s = F.coalesce("best", F.lit(0.0))
    return claims.select("claim_id").join(best, "claim_id", "left").select(
        "claim_id", s.alias("best_score"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(s >= A.SUPPORTED, "supported").when(s >= A.PARTIAL, "partial").otherwise("unsupported").alias("verdict"))


def audit_candidates(spark, sf_dir):
    """Up to ten chunks per claim to be judged: those it cites first, then by overlap, then by id."""
    scored = A.overlaps(_claims(spark, sf_dir), _evidence(spark, sf_dir), _case_pairs(spark, sf_dir)).select("claim_id", "chunk_id", "score")
    c = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"]).select("claim_id", F.explode("citations").alias("s"))
    cited = c.select("claim_id", normal_id(F.col("s.chunk_id")).alias("chunk_id")).distinct().withColumn("cited", F.lit(True))
    w = Window.partitionBy("claim_id").orderBy(F.desc("cited"), F.desc("score"), "chunk_id")
    return scored.join(cited, ["claim_id", "chunk_id"], "left").withColumn("cited", F.coalesce("cited", F.lit(False))).where("cited OR score > 0").withColumn(
        "place", F.row_number().over(w)).where("place <= 10")


def citation_in_paper(spark, sf_dir):
    """Every citation of a claim: supported where the cited chunk shares enough of its words, invalid
    where no chunk has that id, else mis_citation."""
    c = load(spark, sf_dir, "audited_claims").dropDuplicates(["claim_id"]).select("claim_id", F.explode("citations").alias("s"))
    cited = c.select("claim_id", normal_id(F.col("s.chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    scored = A.overlaps(_claims(spark, sf_dir), _evidence(spark, sf_dir), cited).select("claim_id", "chunk_id", "score")
    return cited.join(scored, ["claim_id", "chunk_id"], "left").select(
        "claim_id", "chunk_id", F.when(F.col("score").isNull(), "invalid_citation").when(F.col("score") >= A.SUPPORTED, "supported").otherwise("mis_citation").alias("status"))


# The thresholds of direct support, and words that contradict.
DIRECT, INTERNAL = 0.25, 0.28
AGAINST = ("contradict", "inconsistent", "in contrast", "however", "fails to")


def reference_support(spark, sf_dir):
    """Every claim and candidate: contradictory, direct, partial or irrelevant, by the words they share."""
    tokens = lambda c: T.audit_tokens(F.col(c))
    pairs = M.ids_of(load(spark, sf_dir, "audited_claims"), "claim_id", "candidate_chunk_ids")
    against = F.exists(F.array(*map(F.lit, AGAINST)), lambda w: F.contains(F.lower(F.coalesce("text", F.lit(""))), w))
    e = _evidence(spark, sf_dir).select("chunk_id", tokens("text").alias("et"), against.alias("against"))
    j = pairs.join(_claims(spark, sf_dir).select("claim_id", tokens("text").alias("ct")), "claim_id").join(e, "chunk_id")
    n = F.size(F.array_intersect("ct", "et"))
    j = j.select("claim_id", "chunk_id", "against", n.alias("n"), F.round(n / F.greatest(F.lit(1), F.size("ct")), 6).alias("share"))
    return j.select("claim_id", "chunk_id", F.when(F.col("against") & (F.col("share") >= DIRECT), "contradictory").when((F.col("n") >= 2) & (F.col("share") >= DIRECT), "direct").when(
        F.col("n") >= 1, "partial").otherwise("irrelevant").alias("support"))


def internal_support(spark, sf_dir):
    """Every claim by the best of its candidates: direct, partial or unsupported."""
    best = _scored(spark, sf_dir).groupBy("claim_id").agg(F.max("score").alias("s"))
    return _claims(spark, sf_dir).select("claim_id").join(best, "claim_id", "left").select("claim_id", F.when(F.col("s") >= INTERNAL, "direct").when(
        F.col("s") >= A.PARTIAL, "partial").otherwise("unsupported").alias("support"))


def answer_guard(spark, sf_dir):
    """Whether an answer may stand: its latest judgement is strong, it cites something, and
    all it cites is among the ids that support the judgement.  The first reason against it wins."""
    e = load(spark, sf_dir, "evidence_sufficiency").where("case_id IS NOT NULL").groupBy("case_id").agg(F.max(F.struct("judged_at", "result_id", "support_level")).alias("j")).select(
        "case_id", "j.result_id", "j.support_level")
    ids = M.ids_of(load(spark, sf_dir, "evidence_sufficiency"), "result_id", "supporting_chunk_ids")
    allowed = e.join(ids, "result_id").select("case_id", "chunk_id", F.lit(1).alias("ok"))
    cited = M.ids_of(load(spark, sf_dir, "citation_audit_v1_queries"), "case_id", "citation_chunk_ids")
    n = cited.join(allowed, ["case_id", "chunk_id"], "left").groupBy("case_id").agg(F.count("*").alias("n_cited"), F.count_if(F.col("ok").isNull()).alias("n_foreign"))
    reason = F.when(F.col("result_id").isNull(), "not_judged").when(~F.coalesce(F.col("support_level") == "strong", F.lit(False)), "not_strong").when(
        F.col("n_cited").isNull(), "no_citation").when(F.col("n_foreign") > 0, "foreign_citation").otherwise("")
    return _answers(spark, sf_dir).select("case_id").join(e, "case_id", "left").join(n, "case_id", "left").select("case_id", reason.alias("reason"), (reason == "").alias("stands"))


def error_type_counts(spark, sf_dir):
    """How many claims have each kind of error."""
    from .audit import error_type_precedence

    return error_type_precedence(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n"))


def strong_terms_added(spark, sf_dir):
    """Claims that say something stronger than any of their candidates, with how strong."""
    words = list(T.SEVERE_TERMS + T.MILD_TERMS)
    strong = lambda c: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    own = _claims(spark, sf_dir).select("claim_id", F.explode(strong("text")).alias("term"))
    pairs = M.ids_of(load(spark, sf_dir, "audited_claims"), "claim_id", "candidate_chunk_ids")
    held = pairs.join(_evidence(spark, sf_dir), "chunk_id").select("claim_id", F.explode(strong("text")).alias("term")).distinct()
    return own.join(held, ["claim_id", "term"], "left_anti").groupBy("claim_id").agg(F.count("*").alias("n_added"), F.min("term").alias("first"))


def claim_dedupe(spark, sf_dir):
    """Claims that say the same but for case, signs and what follows the 180th character: the least id stays."""
    key = F.left(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(180))
    return _claims(spark, sf_dir).groupBy(F.sha2(key, 256).alias("key")).agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("n")).select("claim_id", "n")


def evidence_dedupe(spark, sf_dir):
    """Every chunk of the evidence once, with its best rank and where that was."""
    h = load(spark, sf_dir, "retrieval_hits").where("fusion_rank IS NOT NULL").select(normal_id(F.col("chunk_id")).alias("chunk_id"), "fusion_rank", "query_id").where("chunk_id IS NOT NULL AND query_id IS NOT NULL")
    return h.groupBy("chunk_id").agg(F.min(F.struct("fusion_rank", "query_id")).alias("b"), F.countDistinct("query_id").alias("n_queries")).select(
        "chunk_id", F.col("b.fusion_rank").alias("best_rank"), F.col("b.query_id").alias("query_id"), "n_queries")


def source_merge(spark, sf_dir):
    """Hits of a query merged by paper and chunk, or by paper and text where the chunk is unknown, and numbered anew."""
    h = load(spark, sf_dir, "retrieval_hits").where("query_id IS NOT NULL AND fusion_rank IS NOT NULL")
    key = F.coalesce(normal_id(F.col("chunk_id")), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    g = h.groupBy("query_id", key.alias("key")).agg(F.min("fusion_rank").alias("rank"), F.countDistinct("hit_id").alias("n_hits"))
    return g.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))).select("query_id", "key", "source_no", "n_hits")


def neighbour_expansion(spark, sf_dir):
    """The five best chunks of every query and their neighbours in the paper, each once, with how it came in."""
    from .structure import neighbor_links

    best = source_merge(spark, sf_dir).where("source_no <= 5").select("query_id", F.col("key").alias("chunk_id"))
    links = neighbor_links(spark, sf_dir).select(normal_id(F.col("chunk_id")).alias("chunk_id"), normal_id(F.col("prev_id")).alias("prev_id"), normal_id(F.col("next_id")).alias("next_id"))
    more = best.join(links, "chunk_id").select("query_id", F.explode(F.array(
        F.struct(F.lit("before").alias("how"), F.col("prev_id").alias("id")), F.struct(F.lit("after").alias("how"), F.col("next_id").alias("id")))).alias("x")).select(
        "query_id", F.col("x.id").alias("chunk_id"), F.col("x.how").alias("how")).where("chunk_id IS NOT NULL")
    return best.withColumn("how", F.lit("self")).unionByName(more).groupBy("query_id", "chunk_id").agg(F.max("how").alias("how"))


def distinct_entities(spark, sf_dir):
    """Names in a query, without those that are a part of another one."""
    names = F.array_distinct(F.regexp_extract_all("query", F.lit(r"[A-Z][A-Za-z0-9-]+"), F.lit(0)))
    q = _answers(spark, sf_dir).select("case_id", names.alias("n"))
    whole = F.filter("n", lambda x: ~F.exists("n", lambda y: (x != y) & F.contains(y, x)))
    return q.select("case_id", F.array_join(F.array_sort(whole), ";").alias("names"))


def query_constraints(spark, sf_dir):
    """Whether a query negates, compares or asks for a time, and whether its answer keeps that."""
    q = _answers(spark, sf_dir)
    kinds = {"negation": r"(?i)\b(not|no|without|never)\b", "comparison": r"(?i)\b(compare|than|versus|vs|over|better|best)\b", "time": r"(?i)\b(before|after|since|until|when|[12][0-9]{3})\b"}
    return q.select("case_id", *[F.coalesce(F.col("query").rlike(p), F.lit(False)).alias(k) for k, p in kinds.items()],
                    *[(F.coalesce(F.col("query").rlike(p), F.lit(False)) & ~F.coalesce(F.col("answer").rlike(p), F.lit(False))).alias(f"lost_{k}") for k, p in kinds.items()])


QUERIES = {f.__name__: f for f in (
    claim_case_overlap, audit_candidates, citation_in_paper, reference_support, internal_support, answer_guard, error_type_counts, strong_terms_added, claim_dedupe,
    evidence_dedupe, source_merge, neighbour_expansion, distinct_entities, query_constraints)}

_CP = f"cp AS (SELECT DISTINCT claim_id, {_norm('h.chunk_id')} AS chunk_id FROM cl JOIN retrieval_hits h ON h.query_id = cl.case_id)"
_TOKENS = f"""{_CH}, {_CL}, ct AS (SELECT claim_id, {_AT} AS ct FROM (SELECT claim_id, lower(coalesce(text, '')) AS t FROM cl)),
et AS (SELECT chunk_id, text, {_AT} AS et FROM (SELECT chunk_id, text, lower(coalesce(text, '')) AS t FROM ev))"""
_CS = f"{_TOKENS}, {_CP}, cs AS (SELECT claim_id, chunk_id, round(len(list_intersect(ct, et)) / greatest(1, len(ct)), 6) AS score FROM cp JOIN ct USING (claim_id) JOIN et USING (chunk_id))"
_CI = f"ci AS (SELECT DISTINCT claim_id, {_norm('s.chunk_id')} AS chunk_id FROM (SELECT claim_id, unnest(citations) AS s FROM (SELECT DISTINCT ON (claim_id) * FROM audited_claims)))"
_IDS = "SELECT DISTINCT {k}, chunk_id FROM (SELECT {k}, {n} AS chunk_id FROM (SELECT {k}, unnest({i}) AS raw FROM {t})) WHERE chunk_id IS NOT NULL"
_ids = lambda k, i, t: _IDS.format(k=k, n=_norm("raw"), i=i, t=t)
_STRONG = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.SEVERE_TERMS + T.MILD_TERMS)) + "]"
_TERMS = f"list_filter({_STRONG}, lambda w: contains(lower(coalesce({{c}}, '')), w))"
_SM = f"""sm AS (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS INTEGER) AS source_no, n_hits FROM (SELECT query_id, coalesce({_norm('chunk_id')}, 'text:' || sha256(coalesce(text, ''))) AS key,
  min(fusion_rank) AS rank, count(DISTINCT hit_id) AS n_hits FROM retrieval_hits WHERE query_id IS NOT NULL AND fusion_rank IS NOT NULL GROUP BY 1, 2))"""
_LAST = "j AS (SELECT * FROM (SELECT case_id, result_id, support_level, row_number() OVER (PARTITION BY case_id ORDER BY judged_at DESC NULLS LAST, result_id DESC NULLS LAST, support_level DESC NULLS LAST) AS n FROM evidence_sufficiency WHERE case_id IS NOT NULL) WHERE n = 1)"
_KIND = {"negation": "(?i)\\b(not|no|without|never)\\b", "comparison": "(?i)\\b(compare|than|versus|vs|over|better|best)\\b", "time": "(?i)\\b(before|after|since|until|when|[12][0-9]{3})\\b"}
_has = lambda c, k: f"coalesce(regexp_matches({c}, '{_KIND[k]}'), FALSE)"
ORACLE = {
    "claim_case_overlap": f"""WITH {_CS}, b AS (SELECT claim_id, max(score) AS s, count(*) FILTER (WHERE score >= 0.1) AS n FROM cs GROUP BY 1)
        SELECT cl.claim_id, coalesce(s, 0.0) AS best_score, coalesce(n, 0) AS n_near, CASE WHEN coalesce(s, 0) >= 0.18 THEN 'supported' WHEN coalesce(s, 0) >= 0.1 THEN 'partial' ELSE 'unsupported' END AS verdict FROM cl LEFT JOIN b ON cl.claim_id = b.claim_id""",
    "audit_candidates": f"""WITH {_CS}, {_CI}, r AS (SELECT cs.*, ci.chunk_id IS NOT NULL AS cited FROM cs LEFT JOIN ci ON cs.claim_id = ci.claim_id AND cs.chunk_id = ci.chunk_id)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY cited DESC, score DESC, chunk_id) AS INTEGER) AS place FROM r WHERE cited OR score > 0) WHERE place <= 10""",
    "citation_in_paper": f"""WITH {_TOKENS}, {_CI} SELECT ci.claim_id, ci.chunk_id, CASE WHEN et.chunk_id IS NULL OR ct.claim_id IS NULL THEN 'invalid_citation' WHEN round(len(list_intersect(ct, et)) / greatest(1, len(ct)), 6) >= 0.18 THEN 'supported' ELSE 'mis_citation' END AS status
        FROM ci LEFT JOIN ct ON ci.claim_id = ct.claim_id LEFT JOIN et ON ci.chunk_id = et.chunk_id WHERE ci.chunk_id IS NOT NULL""",
    "reference_support": f"""WITH {_TOKENS}, pr AS ({_ids('claim_id', 'candidate_chunk_ids', 'audited_claims')}), s AS (SELECT claim_id, chunk_id, len(list_intersect(ct, et)) AS n, round(len(list_intersect(ct, et)) / greatest(1, len(ct)), 6) AS share,
        ({' OR '.join(f"contains(lower(coalesce(text, {chr(39) * 2})), '{w}')" for w in AGAINST)}) AS against FROM pr JOIN ct USING (claim_id) JOIN et USING (chunk_id))
        SELECT claim_id, chunk_id, CASE WHEN against AND share >= 0.25 THEN 'contradictory' WHEN n >= 2 AND share >= 0.25 THEN 'direct' WHEN n >= 1 THEN 'partial' ELSE 'irrelevant' END AS support FROM s""",
    "internal_support": f"""WITH {_SC}, b AS (SELECT claim_id, max(score) AS s FROM sc GROUP BY 1) SELECT cl.claim_id, CASE WHEN s >= 0.28 THEN 'direct' WHEN s >= 0.1 THEN 'partial' ELSE 'unsupported' END AS support FROM cl LEFT JOIN b ON cl.claim_id = b.claim_id""",
    "answer_guard": f"""WITH {_LAST}, i AS ({_ids('result_id', 'supporting_chunk_ids', 'evidence_sufficiency')}), a AS (SELECT DISTINCT case_id, chunk_id FROM j JOIN i ON j.result_id = i.result_id),
        c AS ({_ids('case_id', 'citation_chunk_ids', 'citation_audit_v1_queries')}), n AS (SELECT c.case_id, count(*) AS n_cited, count(*) FILTER (WHERE a.chunk_id IS NULL) AS n_foreign FROM c LEFT JOIN a ON c.case_id = a.case_id AND c.chunk_id = a.chunk_id GROUP BY 1),
        r AS (SELECT q.case_id, CASE WHEN result_id IS NULL THEN 'not_judged' WHEN NOT coalesce(support_level = 'strong', FALSE) THEN 'not_strong' WHEN n_cited IS NULL THEN 'no_citation' WHEN n_foreign > 0 THEN 'foreign_citation' ELSE '' END AS reason
        FROM (SELECT DISTINCT case_id FROM citation_audit_v1_queries) q LEFT JOIN j ON q.case_id = j.case_id LEFT JOIN n ON q.case_id = n.case_id) SELECT case_id, reason, reason = '' AS stands FROM r""",
    "strong_terms_added": f"""WITH {_CH}, {_CL}, o AS (SELECT claim_id, unnest({_TERMS.format(c='text')}) AS term FROM cl), pr AS ({_ids('claim_id', 'candidate_chunk_ids', 'audited_claims')}),
        h AS (SELECT DISTINCT claim_id, unnest({_TERMS.format(c='text')}) AS term FROM pr JOIN ev USING (chunk_id)) SELECT o.claim_id, count(*) AS n_added, min(o.term) AS first FROM o LEFT JOIN h ON o.claim_id = h.claim_id AND o.term = h.term WHERE h.term IS NULL GROUP BY 1""",
    "claim_dedupe": f"""WITH {_CL} SELECT min(claim_id) AS claim_id, count(*) AS n FROM (SELECT claim_id, substr(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), 1, 180) AS k FROM cl) GROUP BY k""",
    "evidence_dedupe": f"""WITH h AS (SELECT {_norm('chunk_id')} AS chunk_id, fusion_rank, query_id FROM retrieval_hits WHERE fusion_rank IS NOT NULL AND query_id IS NOT NULL)
        SELECT chunk_id, min(fusion_rank) AS best_rank, (list(query_id ORDER BY fusion_rank, query_id))[1] AS query_id, count(DISTINCT query_id) AS n_queries FROM h WHERE chunk_id IS NOT NULL GROUP BY 1""",
    "source_merge": f"WITH {_SM} SELECT * FROM sm",
    "neighbour_expansion": f"""WITH {_SM}, b AS (SELECT query_id, key AS chunk_id FROM sm WHERE source_no <= 5),
        m AS (SELECT chunk_id, max(doc_id) AS doc_id FROM corpus_manifest GROUP BY 1), k AS (SELECT {_norm('chunk_id')} AS chunk_id, {_norm('p')} AS p, {_norm('n')} AS n FROM (SELECT chunk_id, lag(chunk_id) OVER w AS p, lead(chunk_id) OVER w AS n FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id))),
        a AS (SELECT query_id, chunk_id, 'self' AS how FROM b UNION ALL SELECT query_id, p, 'before' FROM b JOIN k USING (chunk_id) WHERE p IS NOT NULL UNION ALL SELECT query_id, n, 'after' FROM b JOIN k USING (chunk_id) WHERE n IS NOT NULL)
        SELECT query_id, chunk_id, max(how) AS how FROM a GROUP BY 1, 2""",
    "distinct_entities": f"""WITH {_AN}, n AS (SELECT case_id, list_distinct(regexp_extract_all(query, '[A-Z][A-Za-z0-9-]+')) AS n FROM an)
        SELECT case_id, array_to_string(list_sort(list_filter(n, lambda x: len(list_filter(n, lambda y: x <> y AND contains(y, x))) = 0)), ';') AS names FROM n""",
    "query_constraints": f"""WITH {_AN} SELECT case_id, {', '.join(f"{_has('query', k)} AS {k}" for k in _KIND)}, {', '.join(f"{_has('query', k)} AND NOT {_has('answer', k)} AS lost_{k}" for k in _KIND)} FROM an""",
}
from .audit import ORACLE as _AUDIT  # noqa: E402

ORACLE["error_type_counts"] = f"SELECT error_type, count(*) AS n FROM ({_AUDIT['error_type_precedence']}) GROUP BY 1"
