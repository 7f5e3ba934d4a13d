"""Windows over events, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from ..tables import load


def _e(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _tumbling(df):
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "cents")


def events_tumbling(spark, sf_dir):
    return _tumbling(_e(spark, sf_dir))


def events_sliding(spark, sf_dir):
    return _e(spark, sf_dir).groupBy(F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "n")


def events_session(spark, sf_dir):
    s = _e(spark, sf_dir).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def stream_tumbling(spark, sf_dir):
    """The tumbling windows as a stream: append mode gives a window once the watermark
    passed its end, so the last windows (up to the latest event less ten minutes) stay out."""
    s = E.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return E.run(_tumbling(s))


def stream_latest_state(spark, sf_dir):
    s = E.read_stream(spark, f"{sf_dir}/events.parquet", files=4).select("user_id", "event_id", "ts", "event_type")
    return E.run_batches(s, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def stream_deduplicated(spark, sf_dir):
    """Redelivered events dropped by a watermarked state: counts per type and day."""
    s = E.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return E.run(s.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))).groupBy("event_type", "day").agg(F.count("*").alias("n"))


def stream_manifest_latest(spark, sf_dir):
    """The manifest kept up by micro-batches: of every chunk the row ingested last."""
    s = E.read_stream(spark, f"{sf_dir}/corpus_manifest.parquet", files=4).where("chunk_id IS NOT NULL").select("chunk_id", "ingested_at", "loaded_at", "content_hash", "deleted_at")
    latest = E.run_batches(s, "chunk_id", ["ingested_at", "loaded_at", "content_hash", "deleted_at"])
    return latest.select("chunk_id", "content_hash", F.col("deleted_at").isNull().alias("lives"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session, stream_tumbling, stream_latest_state, stream_deduplicated, stream_manifest_latest)}

_T = "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events"
ORACLE = {
    "events_tumbling": _T + " GROUP BY 1, 2",
    "events_sliding": """SELECT start_s, count(*) AS n FROM (SELECT ts, unnest([b, b - 7200, b - 14400]) AS start_s FROM (SELECT ts, CAST(floor(epoch(ts) / 7200) AS BIGINT) * 7200 AS b FROM events)) GROUP BY 1""",
    "events_session": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_tumbling": f"SELECT * FROM ({_T} GROUP BY 1, 2) WHERE start_s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)",
    "stream_latest_state": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_deduplicated": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2",
    "stream_manifest_latest": """SELECT chunk_id, content_hash, deleted_at IS NULL AS lives FROM corpus_manifest WHERE chunk_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, loaded_at DESC NULLS LAST, content_hash DESC NULLS LAST, deleted_at DESC NULLS LAST) = 1""",
}
