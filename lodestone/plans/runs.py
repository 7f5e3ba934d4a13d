"""Run analytics over events, cases and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import runs as R
from ..operators import order as O
from ..operators import structure as S
from ..tables import load

WORDS = ["retrieval", "dense", "label", "memory"]


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events")


def latest_run_state(spark, sf_dir):
    return M.latest(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


def duplicate_tool_calls(spark, sf_dir):
    d = R.repeats(_events(spark, sf_dir), "user_id", ["event_type", "props"], ["ts", "event_id"])
    return d.groupBy("event_type").agg(F.count("*").alias("n_repeats"), F.countDistinct("user_id").alias("n_runs"))


def tool_success_rate(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors")).withColumn(
        "success_rate", M.ratio(F.col("n_calls") - F.col("n_errors"), F.col("n_calls")))


def unnecessary_calls_multiset(spark, sf_dir):
    """Calls of the second half of the month beyond those of the first half, counted as multisets."""
    e = _events(spark, sf_dir).select("user_id", "event_type", (F.dayofmonth("ts") > 15).alias("late"))
    extra = e.where("late").select("user_id", "event_type").exceptAll(e.where("NOT late").select("user_id", "event_type"))
    return extra.groupBy("user_id", "event_type").agg(F.count("*").alias("n_extra"))


def run_timeline_latency(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    g = _events(spark, sf_dir).select("event_type", ((micros(F.col("ts")) - micros(F.lag("ts").over(w))) / 1000000.0).alias("gap"))
    g = g.where("gap IS NOT NULL")
    ranks, p95 = O.interpolated("p95", 0.95)
    high = O.order_statistics(g, ["event_type"], "gap", ranks, 60).select(F.col("event_type").alias("t"), F.round(p95, 3).alias("p95_gap_s"))
    mean = g.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("mean_gap_s"))
    return mean.join(high, mean["event_type"].eqNullSafe(F.col("t"))).drop("t")


def line_gap_sessions(spark, sf_dir):
    s = S.gap_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("value"))


def run_keyword_search(spark, sf_dir):
    q = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("query").alias("query"))
    return q.select("case_id", R.keyword_score(WORDS, F.col("query")).alias("score")).where("score > 0")


def failure_classes(spark, sf_dir):
    e = load(spark, sf_dir, "evidence_sufficiency").dropDuplicates(["result_id"])
    status = F.when(F.col("answerable"), "completed").otherwise("rejected")
    reason = F.coalesce("fallback_reason", "reason")
    return e.groupBy(R.failure_class(status, reason, F.coalesce(F.size("supporting_chunk_ids"), F.lit(0)) > 0).alias("failure")).agg(F.count("*").alias("n"))


def plan_task_classes(spark, sf_dir):
    q = load(spark, sf_dir, "citation_audit_v1_queries").groupBy("case_id").agg(F.max("query").alias("query"))
    return q.groupBy(R.task_class(F.col("query")).alias("task")).agg(F.count("*").alias("n"))


def run_efficiency(spark, sf_dir):
    """Elapsed time, calls and repeated calls of every run."""
    e = _events(spark, sf_dir)
    rep = R.repeats(e, "user_id", ["event_type", "props"], ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n_repeats"))
    ms = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000
    return e.groupBy("user_id").agg(F.greatest(F.lit(0), F.floor(ms)).cast("long").alias("elapsed_ms"), F.count("*").alias("n_calls")).join(rep, "user_id", "left").select(
        "user_id", "elapsed_ms", "n_calls", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))


def event_payloads(spark, sf_dir):
    """The JSON payload parsed by schema: totals per event type."""
    p = _events(spark, sf_dir).select("event_type", F.from_json("props", "k INT").alias("p"))
    return p.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("top"))


QUERIES = {f.__name__: f for f in (
    latest_run_state, duplicate_tool_calls, tool_success_rate, unnecessary_calls_multiset, run_timeline_latency, line_gap_sessions, run_keyword_search,
    failure_classes, plan_task_classes, run_efficiency, event_payloads)}

_REP = "rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 1)"
_Q = "q AS (SELECT case_id, max(query) AS query FROM citation_audit_v1_queries GROUP BY 1)"
_TASK = "CASE " + " ".join(f"WHEN regexp_matches(query, '{p}') THEN '{n}'" for n, p in R.TASKS) + " ELSE 'qa' END"
_KW = " + ".join(f"CAST(contains(lower(query), '{w}') AS INTEGER)" for w in WORDS)
ORACLE = {
    "latest_run_state": "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "duplicate_tool_calls": f"WITH {_REP} SELECT event_type, count(*) AS n_repeats, count(DISTINCT user_id) AS n_runs FROM rp GROUP BY 1",
    "tool_success_rate": """SELECT user_id, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
        round(CAST(count(*) - count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS success_rate FROM events GROUP BY 1""",
    "unnecessary_calls_multiset": """SELECT user_id, event_type, count(*) AS n_extra FROM (SELECT user_id, event_type FROM events WHERE day(ts) > 15 EXCEPT ALL SELECT user_id, event_type FROM events WHERE day(ts) <= 15) GROUP BY 1, 2""",
    "run_timeline_latency": """WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap FROM events)
        SELECT event_type, count(*) AS n, round(avg(gap), 3) AS mean_gap_s, round(quantile_cont(gap, 0.95), 3) AS p95_gap_s FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "line_gap_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS value FROM s GROUP BY 1, 2""",
    "run_keyword_search": f"WITH {_Q} SELECT * FROM (SELECT case_id, {_KW} AS score FROM q) WHERE score > 0",
    "failure_classes": """WITH e AS (SELECT DISTINCT ON (result_id) answerable, lower(coalesce(fallback_reason, reason, '')) AS r, coalesce(len(supporting_chunk_ids), 0) AS n FROM evidence_sufficiency)
        SELECT CASE WHEN contains(r, 'insufficient') THEN 'insufficient_evidence' WHEN contains(r, 'tool') OR contains(r, 'timeout') THEN 'tool_failure'
        WHEN NOT answerable THEN CASE WHEN n > 0 THEN 'rejected_answer' ELSE 'no_evidence' END ELSE 'execution_failure' END AS failure, count(*) AS n FROM e GROUP BY 1""",
    "plan_task_classes": f"WITH {_Q} SELECT {_TASK} AS task, count(*) AS n FROM q GROUP BY 1",
    "run_efficiency": f"""WITH {_REP}, n AS (SELECT user_id, count(*) AS n_repeats FROM rp GROUP BY 1), e AS (SELECT user_id, CAST(greatest(0, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000) AS BIGINT) AS elapsed_ms, count(*) AS n_calls FROM events GROUP BY 1)
        SELECT e.user_id, elapsed_ms, n_calls, coalesce(n_repeats, 0) AS n_repeats FROM e LEFT JOIN n ON e.user_id = n.user_id""",
    "event_payloads": """WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM p GROUP BY 1""",
}
