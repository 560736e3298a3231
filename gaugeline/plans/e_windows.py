"""Ranks, selections and sequences over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import windows as W
from gaugeline.registry import query, table


@query("E1_average_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_orderkey, l_discount) - 1) / 2.0 AS r FROM lineitem", "r")
def e1(spark, sf_dir):
    return W.average_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ["l_orderkey"], "l_discount").drop("l_discount")


@query("E2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "o_totalprice")
def e2(spark, sf_dir):
    """A top-k report."""
    return W.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, [F.desc("o_totalprice"), "o_orderkey"])


@query("E2_top_k_by_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def e2b(spark, sf_dir):
    return W.top_k(table(spark, sf_dir, "orders"), 2, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("E3_arg_best", "SELECT l_orderkey, arg_min(l_linenumber, l_discount * 1000 + l_linenumber) AS best FROM lineitem GROUP BY 1")
def e3(spark, sf_dir):
    return W.arg_best(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount", "l_linenumber")


@query("E4_min_center", "SELECT l_orderkey, l_linenumber, l_quantity - min(l_quantity) OVER (PARTITION BY l_orderkey) AS l_quantity_centered FROM lineitem", "l_quantity_centered")
def e4(spark, sf_dir):
    return W.min_center(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity_centered")


@query(
    "E5_cumulative_unique",
    """WITH r AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
       f AS (SELECT user_id, k, ceil(min(i) * 4 / any_value(n))::INTEGER AS bin FROM r GROUP BY 1, 2), g AS (SELECT DISTINCT user_id, unnest([1, 2, 3, 4]) AS bin FROM events)
       SELECT g.user_id, g.bin, count(f.k) AS n_unique FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.bin <= g.bin GROUP BY 1, 2""",
)
def e5(spark, sf_dir):
    return W.cumulative_unique(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 4)


@query("E6_split_half", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= count(*) OVER (PARTITION BY user_id) // 2 THEN 1 ELSE 2 END AS half FROM events")
def e6(spark, sf_dir):
    return W.split_half(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "half")


@query("E7_latest_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def e7(spark, sf_dir):
    return W.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("E8_drop_duplicates_first", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def e8(spark, sf_dir):
    return W.drop_duplicates_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "E9_lag1_autocorr",
    """WITH d AS (SELECT user_id, value, value - avg(value) OVER (PARTITION BY user_id) AS d, ts, event_id FROM events), p AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM d)
       SELECT user_id, count(*) AS n, avg(value) AS mean, avg(d * d) AS var, greatest(-1, least(1, coalesce(sum(d * q) / nullif(sum(d * d), 0), 0))) AS rho1 FROM p GROUP BY 1""",
    "mean var rho1",
)
def e9(spark, sf_dir):
    return W.lag1_autocorr(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


_LAGS = """WITH d AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  v AS (SELECT user_id, sum(d * d) AS v, count(*) AS n FROM d GROUP BY 1),
  rho AS (SELECT a.user_id, n, (b.i - a.i)::INTEGER AS lag, sum(a.d * b.d) / any_value(v) AS rho FROM d a JOIN d b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 1 AND 5 JOIN v ON v.user_id = a.user_id WHERE v > 0 GROUP BY 1, 2, 3)"""


@query("E10_autocorrelation", f"{_LAGS} SELECT user_id, n, lag, rho FROM rho", "rho")
def e10(spark, sf_dir):
    return W.autocorrelation(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5)


@query("E11_worst_groups", "SELECT l_suppkey, avg(l_discount) AS value FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 3", "value")
def e11(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"))
    return W.worst_groups(m, 3, "m", "l_suppkey").select("l_suppkey", "value")


@query(
    "E12_order_check",
    """WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag = 'A') AS b, avg(l_quantity) FILTER (l_returnflag = 'N') AS c,
       stddev_pop(l_quantity) FILTER (l_returnflag = 'R') AS sa, stddev_pop(l_quantity) FILTER (l_returnflag = 'A') AS sb, stddev_pop(l_quantity) FILTER (l_returnflag = 'N') AS sc FROM lineitem GROUP BY 1)
       SELECT l_suppkey, a - b AS gap1, b - c AS gap2, coalesce(least(a - b, b - c) > 0, false) AS ordered, least(a - b, b - c) - 0.7 * greatest(sa, sb, sc) AS score FROM m""",
    "gap1 gap2 score",
)
def e12(spark, sf_dir):
    return W.order_check(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", ["R", "A", "N"])


@query(
    "E13_feasible_block",
    """WITH g AS (SELECT DISTINCT p_size AS x, (p_partkey % 40)::INTEGER AS y FROM part WHERE p_retailprice > 940)
       SELECT count(*) AS n_blocks, count(*) > 0 AS feasible FROM g a JOIN g b ON b.x = a.x + 1 AND b.y = a.y JOIN g c ON c.x = a.x AND c.y = a.y + 1 JOIN g d ON d.x = a.x + 1 AND d.y = a.y + 1""",
)
def e13(spark, sf_dir):
    grid = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), (F.col("p_partkey") % 40).cast("int").alias("y"), (F.col("p_retailprice") > 940).alias("ok"))
    return W.feasible_block(grid, "x", "y", "ok")
