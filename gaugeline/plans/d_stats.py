"""Group statistics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.scalars import list_cost
from gaugeline.operators import stats as D
from gaugeline.operators.ranking import spearman
from gaugeline.registry import query, table


@query("D1_group_stats", "SELECT c_nationkey, avg(c_acctbal) AS c_acctbal_mean, stddev_samp(c_acctbal) AS c_acctbal_std, count(c_acctbal) AS c_acctbal_n FROM customer GROUP BY 1", "c_acctbal_mean c_acctbal_std")
def d1(spark, sf_dir):
    return D.group_stats(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_acctbal"])


@query(
    "D2_group_stats_levels",
    "SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey)::INTEGER AS level, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, count(c_acctbal) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment))",
    "mean std",
)
def d2(spark, sf_dir):
    return D.group_stats_levels(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal")


@query(
    "D3_describe_by",
    """SELECT p_brand, count(p_retailprice) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std, min(p_retailprice) AS "min", quantile_cont(p_retailprice, 0.25) AS q25, quantile_cont(p_retailprice, 0.5) AS q50,
       quantile_cont(p_retailprice, 0.75) AS q75, max(p_retailprice) AS "max" FROM part GROUP BY 1""",
    "mean std min q25 q50 q75 max",
)
def d3(spark, sf_dir):
    return D.describe_by(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query(
    "D4_segment_summary",
    """SELECT 'small' AS segment, count(*) AS n, avg(p_retailprice) AS p_retailprice_mean FROM part WHERE p_size < 20 UNION ALL
       SELECT 'dear', count(*), avg(p_retailprice) FROM part WHERE p_retailprice > 910 UNION ALL SELECT 'brand', count(*), avg(p_retailprice) FROM part WHERE p_brand LIKE 'Brand#1%'""",
    "p_retailprice_mean",
)
def d4(spark, sf_dir):
    segments = {"small": F.col("p_size") < 20, "dear": F.col("p_retailprice") > 910, "brand": F.col("p_brand").like("Brand#1%")}
    return D.segment_summary(table(spark, sf_dir, "part"), segments, ["p_retailprice"])


@query(
    "D5_band_width_stats",
    "SELECT l_returnflag, avg(l_quantity) AS mean_width, avg(l_quantity / greatest(1, l_suppkey - l_linenumber + 1)) AS mean_relative_width, count(*) AS n FROM lineitem GROUP BY 1",
    "mean_width mean_relative_width",
)
def d5(spark, sf_dir):
    return D.band_width_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_suppkey", "l_quantity")


@query("D6_finite_stats", "SELECT event_type, median(value) AS median, avg(value) AS mean, max(value) AS max FROM events WHERE event_id % 5 <> 0 GROUP BY 1", "median mean max")
def d6(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return D.finite_stats(e, ["event_type"], "value")


_RANKED = "SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) WHERE r = "


@query("D7_nearest_rank_quantile", _RANKED + "greatest(1, round_even(n * 0.9::DOUBLE, 0))::BIGINT", "value")
def d7(spark, sf_dir):
    return D.ranked_quantile(table(spark, sf_dir, "events"), ["user_id"], "value", 0.9)


@query("D8_ceil_quantile", _RANKED + "greatest(1, ceil(n * 0.95::DOUBLE))::BIGINT", "value")
def d8(spark, sf_dir):
    return D.ranked_quantile(table(spark, sf_dir, "events"), ["user_id"], "value", 0.95, "ceil")


@query("D9_linear_percentile", "SELECT user_id, quantile_cont(value, 0.9) AS value FROM events GROUP BY 1", "value")
def d9(spark, sf_dir):
    return D.linear_percentile(table(spark, sf_dir, "events"), ["user_id"], "value", 0.9)


@query(
    "D10_threshold_fractions",
    "SELECT event_type, t AS threshold, avg(CASE WHEN value > t THEN 1.0 ELSE 0.0 END) AS share FROM events, (SELECT unnest([10.0, 50.0, 90.0])::DOUBLE AS t) WHERE value IS NOT NULL GROUP BY 1, 2",
    "share",
)
def d10(spark, sf_dir):
    return D.threshold_fractions(table(spark, sf_dir, "events"), ["event_type"], "value", [10, 50, 90])


_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'O' THEN 'SKIP' ELSE 'ERROR' END"


@query(
    "D11_status_summary",
    f"SELECT count(*) AS n_rows, count(*) FILTER (s = 'OK') AS n_ok, count(*) FILTER (s = 'SKIP') AS n_skip, count(*) FILTER (s = 'ERROR') AS n_error, avg((s = 'OK')::INTEGER) AS ok_rate, count(*) / 10.0 AS rows_per_s FROM (SELECT {_STATUS} AS s FROM orders)",
    "ok_rate rows_per_s",
)
def d11(spark, sf_dir):
    return D.status_summary(table(spark, sf_dir, "orders").select(F.expr(_STATUS).alias("status")), "status", 10.0)


@query(
    "D12_top_reasons",
    "SELECT reason, n, n / (SELECT count(*) FROM orders WHERE o_orderpriority <> '') AS share FROM (SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 3)",
    "share",
)
def d12(spark, sf_dir):
    return D.top_reasons(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("D13_pivot_grid", "SELECT c_nationkey, max(x) FILTER (s = 'BUILDING') AS building, max(x) FILTER (s = 'MACHINERY') AS machinery FROM (SELECT c_nationkey, c_mktsegment AS s, count(*) AS x FROM customer GROUP BY 1, 2) GROUP BY 1")
def d13(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.lower("c_mktsegment").alias("s")).agg(F.count("*").alias("x"))
    return D.pivot_grid(counts, "c_nationkey", "s", "x", ["building", "machinery"])


@query(
    "D14_weighted_mean_std",
    "SELECT l_suppkey, any_value(m) AS mean, sqrt(sum(l_quantity * (l_discount - m) ** 2) / sum(l_quantity)) AS std FROM lineitem JOIN (SELECT l_suppkey AS k, sum(l_discount * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY 1) ON k = l_suppkey GROUP BY 1",
    "mean std",
)
def d14(spark, sf_dir):
    return D.weighted_mean_std(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")


@query("D15_to_distribution", "SELECT user_id, event_type, n, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)", "p")
def d15(spark, sf_dir):
    return D.to_distribution(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("D16_distinct_coverage", "SELECT user_id, count(DISTINCT event_type) AS n_unique, count(DISTINCT event_type) / 5.0 AS coverage FROM events GROUP BY 1", "coverage")
def d16(spark, sf_dir):
    return D.distinct_coverage(table(spark, sf_dir, "events"), ["user_id"], "event_type", 5)


@query(
    "D17_worst_case_gate",
    "SELECT l_suppkey, count(*) AS n_repeats, min(l_quantity) AS min_l_quantity, max(l_tax) AS max_l_tax, min(l_quantity) >= 1.5 AND max(l_tax) <= 0.08 AS gate_pass FROM lineitem GROUP BY 1",
    "min_l_quantity max_l_tax",
)
def d17(spark, sf_dir):
    return D.worst_case_gate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"l_quantity": 1.5}, {"l_tax": 0.08})


@query(
    "D18_all_any_flags",
    "SELECT l_orderkey, min(l_discount) = max(l_discount) AS all_equal, max(abs(l_discount)) = 0 AS all_zero, max(abs(l_discount)) = 0 AS never_nonzero FROM lineitem GROUP BY 1",
)
def d18(spark, sf_dir):
    return D.all_any_flags(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount")


@query("D19_ratio_fit", "SELECT p_brand, sum(p_retailprice) / sum(p_size * ln(1 + p_size)) AS alpha FROM part GROUP BY 1", "alpha")
def d19(spark, sf_dir):
    return D.ratio_fit(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size")


@query(
    "D20_linear_fit",
    """SELECT p_brand, any_value(b) AS slope, any_value(a) AS intercept, sqrt(avg((p_retailprice - b * p_size - a) ** 2)) AS rmse FROM part
       JOIN (SELECT p_brand AS k, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part GROUP BY 1) ON k = p_brand GROUP BY 1""",
    "slope intercept rmse",
)
def d20(spark, sf_dir):
    return D.linear_fit(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size")


@query(
    "D21_correlations",
    """SELECT l_returnflag, 'l_quantity~l_extendedprice' AS pair, count(*) AS n, corr(l_quantity, l_extendedprice) AS corr FROM lineitem GROUP BY 1
       UNION ALL SELECT l_returnflag, 'l_tax~l_discount', count(*), corr(l_tax, l_discount) FROM lineitem GROUP BY 1""",
    "corr",
)
def d21(spark, sf_dir):
    return D.correlations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [("l_quantity", "l_extendedprice"), ("l_tax", "l_discount")])


@query(
    "D22_spearman",
    """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS b FROM lineitem)
       SELECT g AS l_returnflag, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1""",
    "rho",
)
def d22(spark, sf_dir):
    return spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")


@query("D23_plateau_lists", "SELECT round(p_size / 7, 4) AS value, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS members FROM part GROUP BY 1", "value")
def d23(spark, sf_dir):
    return D.plateau_lists(table(spark, sf_dir, "part").select((F.col("p_size") / 7).alias("v"), "p_partkey"), "v", "p_partkey")


@query(
    "D24_bin_performance",
    "SELECT p_size, count(*) AS n, median(p_retailprice) AS median_speed, median(p_retailprice / p_size) AS median_ratio, avg((p_retailprice > 950)::INTEGER) AS pass_rate, quantile_cont(p_retailprice / p_size, 0.95) AS p95_ratio FROM part GROUP BY 1",
    "median_speed median_ratio pass_rate p95_ratio",
)
def d24(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"ratio": F.col("p_retailprice") / F.col("p_size"), "ok": F.col("p_retailprice") > 950})
    return D.bin_performance(rows, ["p_size"], "p_retailprice", "ratio", "ok")


@query(
    "D25_stage_attribution",
    """WITH m AS (SELECT event_type AS stage, median(value) FILTER (user_id < 75) AS a, median(value) FILTER (user_id >= 75) AS b FROM events GROUP BY 1)
       SELECT (SELECT stage FROM m ORDER BY b / a DESC, stage DESC LIMIT 1) AS slowest, CASE WHEN max(b) >= 0.6 * sum(b) THEN (SELECT stage FROM m ORDER BY b DESC, stage DESC LIMIT 1) ELSE 'MIXED' END AS bottleneck, max(b) / sum(b) AS top_share FROM m""",
    "top_share",
)
def d25(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") < 75, "a").otherwise("b").alias("cohort"), F.col("event_type").alias("stage"), "value")
    return D.stage_attribution(rows, "cohort", "stage", "value", "a", "b")


@query("D26_break_even", "SELECT min(p_size) AS break_even FROM (SELECT p_size, median(p_retailprice / 945) AS m FROM part GROUP BY 1) WHERE p_size >= 5 AND m >= 1")
def d26(spark, sf_dir):
    return D.break_even(table(spark, sf_dir, "part").withColumn("r", F.col("p_retailprice") / 945), "p_size", "r", 5)


@query(
    "D27_sweep_summary",
    "SELECT l_suppkey, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90, 0::BIGINT AS n_invalid, max(abs(l_tax - 0.04)) AS max_residual FROM lineitem GROUP BY 1",
    "p10 median p90 max_residual",
)
def d27(spark, sf_dir):
    return D.sweep_summary(table(spark, sf_dir, "lineitem").withColumn("res", F.col("l_tax") - 0.04), ["l_suppkey"], "l_quantity", "res")


@query(
    "D28_fraction_summary",
    "SELECT l_suppkey, avg((l_discount = 0)::INTEGER) AS share_zero, avg((l_discount <> 0)::INTEGER) AS share_nonzero, max(l_discount) AS max, avg(l_discount) AS mean, stddev_pop(l_discount) AS std_pop FROM lineitem GROUP BY 1",
    "share_zero share_nonzero max mean std_pop",
)
def d28(spark, sf_dir):
    return D.fraction_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount")


@query(
    "D29_scan_trace_stats",
    """WITH p AS (SELECT l_orderkey, arg_max(l_discount, l_extendedprice) AS last, max(l_discount) AS largest, count(*) AS steps FROM lineitem GROUP BY 1)
       SELECT count(*) AS n_items, min(steps) AS min_steps, median(steps) AS median_steps, avg(steps) AS mean_steps, max(steps) AS max_steps, avg((last <= 0.02)::INTEGER) AS converged_rate, max(largest) AS largest FROM p""",
    "median_steps mean_steps converged_rate largest",
)
def d29(spark, sf_dir):
    return D.scan_trace_stats(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "l_discount", 0.02)


@query("D30_mean_ci", "SELECT user_id, avg(value) AS mean, CASE WHEN count(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(value)) ELSE 0 END AS ci95, count(value) AS n FROM events GROUP BY 1", "mean ci95")
def d30(spark, sf_dir):
    return D.mean_ci(table(spark, sf_dir, "events"), ["user_id"], "value")


@query(
    "D31_density_kurtosis",
    """WITH g AS (SELECT p_brand AS b, p_size::DOUBLE AS x, avg(p_retailprice) AS r FROM part GROUP BY 1, 2),
       m AS (SELECT b, x, 4 * pi() * x * x * r * (coalesce(lead(x) OVER w - x, 0) + coalesce(x - lag(x) OVER w, 0)) / 2 AS m FROM g WINDOW w AS (PARTITION BY b ORDER BY x)),
       u AS (SELECT b AS k, sum(x * m) / sum(m) AS mu FROM m GROUP BY 1)
       SELECT b AS p_brand, (sum(m * (x - mu) ** 4) / sum(m)) / (sum(m * (x - mu) ** 2) / sum(m)) ** 2 - 3 AS kurtosis FROM m JOIN u ON k = b GROUP BY 1""",
    "kurtosis",
)
def d31(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("r"))
    return D.density_kurtosis(g, ["p_brand"], "x", "r")


@query(
    "D32_near_minimum_band",
    """WITH t AS (SELECT l_orderkey, l_linenumber AS x, l_extendedprice AS y, min(l_extendedprice) OVER (PARTITION BY l_orderkey) AS lo FROM lineitem)
       SELECT l_orderkey, arg_min(x, y) AS best, min(y) AS least, min(x) AS band_min, max(x) AS band_max, count(*) AS width, string_agg(x::VARCHAR, ',' ORDER BY x) AS band FROM t WHERE y <= lo + 5000 GROUP BY 1""",
    "least",
)
def d32(spark, sf_dir):
    return D.near_minimum_band(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", 5000.0)


@query("D33_error_by_method", "SELECT l_returnflag, count(*) AS n, avg(abs(l_tax - l_discount)) AS mae, max(abs(l_tax - l_discount)) AS max_error FROM lineitem GROUP BY 1", "mae max_error")
def d33(spark, sf_dir):
    return D.error_by_method(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_tax", "l_discount")


@query(
    "D34_list_cost",
    """SELECT l_orderkey, sum(CASE r WHEN 1 THEN (q - 2) ** 2 WHEN 2 THEN (q - 8) ** 2 WHEN 3 THEN (q - 20) ** 2 ELSE 0 END) AS cost
       FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1""",
    "cost",
)
def d34(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    return lists.select("l_orderkey", list_cost(F.col("q"), [2, 8, 20], 3).alias("cost"))


@query(
    "D35_label_agreement",
    "SELECT source, count(*) FILTER (quality = 1 - toxic) AS matches, count(*) AS total, count(*) FILTER (quality = 1 - toxic) / count(*) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "rate",
)
def d35(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("clean", 1 - F.col("toxic"))
    return D.label_agreement(rows, ["source"], "quality", "clean")


@query("D36_running_percentile")
def d36(spark, sf_dir):
    """Approximate by design."""
    return D.running_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.9)


@query("D36_quantile_sketches", "SELECT event_type, count(value) AS n, avg(value) AS mean, TRUE AS within FROM events GROUP BY 1", "mean")
def d36b(spark, sf_dir):
    """Sketches of each user's values, merged by kind of event; whether the 90 % quantile lies within the bound on ranks."""
    e = table(spark, sf_dir, "events")
    merged = D.sketch_quantiles(D.merge_sketches(D.quantile_sketches(e, ["event_type", "user_id"], "value"), ["event_type"]), {"q": 0.9})
    rank = e.join(merged, "event_type").groupBy("event_type").agg((F.count_if(F.col("value") < F.col("q")) / F.count("value")).alias("low"), (F.count_if(F.col("value") <= F.col("q")) / F.count("value")).alias("high"))
    near = (F.col("low") <= 0.9 + F.col("rank_error")) & (F.col("high") >= 0.9 - F.col("rank_error"))
    return merged.join(rank, "event_type").select("event_type", "n", "mean", near.alias("within"))
