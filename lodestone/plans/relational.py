"""Relational baseline on the star schema: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.structure import last_before
from ..tables import load

REVENUE = "l_extendedprice * (1 - l_discount)"


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders")


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


def join_inner(spark, sf_dir):
    return _lines(spark, sf_dir).join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue"))


def join_left(spark, sf_dir):
    """Customers with the number of their orders, also none."""
    o = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def join_full(spark, sf_dir):
    """Nations with customers and with suppliers, either side missing allowed."""
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    s = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nationkey", "full_outer").select("nationkey", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


def join_semi(spark, sf_dir):
    big = _orders(spark, sf_dir).where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def join_anti(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def join_theta_range(spark, sf_dir):
    """Lines shipped within 30 days after an order of the same supplier's nation was placed by that customer's segment:
    an equality on the order and a range on the date."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_orderpriority")
    return _lines(spark, sf_dir).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (
        F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def asof_latest_event(spark, sf_dir):
    """For every error event the last click of the same user before it."""
    e = load(spark, sf_dir, "events")
    found = last_before(e, "user_id", "ts", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")))
    return found.where("event_type = 'error'").select("event_id", F.col("last_value").alias("click_id"))


def agg_rollup(spark, sf_dir):
    return _lines(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def agg_cube(spark, sf_dir):
    return _lines(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("discount"))


def agg_distinct(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


def agg_pricing(spark, sf_dir):
    """The pricing summary: sums and averages per flag and status up to a ship date."""
    disc = F.expr(REVENUE)
    return _lines(spark, sf_dir).where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"),
        F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


def agg_pivot(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


def window_rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quart"))


def window_frame(spark, sf_dir):
    """Running and moving sums of order prices per customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _orders(spark, sf_dir).select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
                                         F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"))


def set_union(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


def set_intersect(spark, sf_dir):
    late = _orders(spark, sf_dir).where("o_orderstatus = 'O'").select("o_custkey")
    return _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_custkey").intersect(late)


def set_except(spark, sf_dir):
    late = _orders(spark, sf_dir).where("o_orderstatus = 'O'").select("o_custkey")
    return _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_custkey").exceptAll(late).groupBy("o_custkey").agg(F.count("*").alias("n"))


def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _orders(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 5").select("o_orderpriority", "o_orderkey", "n")


def revenue_by_region(spark, sf_dir):
    """Five-way join: revenue per region and year."""
    c = load(spark, sf_dir, "customer")
    j = _lines(spark, sf_dir).join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(
        load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (
    join_inner, join_left, join_full, join_semi, join_anti, join_theta_range, asof_latest_event, agg_rollup, agg_cube, agg_distinct, agg_pricing, agg_pivot,
    window_rank, window_frame, set_union, set_intersect, set_except, topk_per_group, revenue_by_region)}

_R = "l_extendedprice * (1 - l_discount)"
ORACLE = {
    "join_inner": f"SELECT o_orderpriority, count(*) AS n, round(sum({_R}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "join_full": """SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""",
    "join_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_theta_range": "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY 1",
    "asof_latest_event": """SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events) WHERE event_type = 'error'""",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (1, 2)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY CUBE (1, 2)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "agg_pricing": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_R}), 2) AS sum_disc,
        round(sum({_R} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "agg_pivot": """SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS "F", nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS "O" FROM lineitem GROUP BY 1""",
    "window_rank": """SELECT c_custkey, c_nationkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quart FROM customer
        WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)""",
    "window_frame": """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders""",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "set_except": "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1",
    "topk_per_group": "SELECT o_orderpriority, o_orderkey, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5",
    "revenue_by_region": f"""SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum({_R}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
}
