"""Grouped-rank accuracy over the tables: lines of an order, suppliers, brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import ranking as H
from gaugeline.operators.ordered import dealt
from gaugeline.registry import query, table
from gaugeline.sources.files import written

_ROWS = "SELECT l_orderkey AS g, l_linenumber AS k, l_quantity AS pred, l_extendedprice AS truth FROM lineitem"


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("pred"), F.col("l_extendedprice").alias("truth"))


def _rho(rows: str, by: str = "g", x: str = "pred") -> str:
    return f"""SELECT {by}, count(*) AS n, CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 12) END AS rho FROM (
      SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS a, rank() OVER (PARTITION BY {by} ORDER BY truth) + (count(*) OVER (PARTITION BY {by}, truth) - 1) / 2.0 AS b FROM ({rows})) GROUP BY {by}"""


def _pairs(rows: str, by: str = "g", x: str = "pred") -> str:
    keys = by.split(", ")
    same = " AND ".join(f"p.{c} = q.{c}" for c in keys)
    return f"""SELECT {", ".join("p." + c for c in keys)}, count(*) FILTER (sign(p.{x} - q.{x}) = sign(p.truth - q.truth)) AS n_correct, count(*) AS n_pairs FROM ({rows}) p JOIN ({rows}) q ON {same} AND p.k < q.k AND p.truth <> q.truth GROUP BY ALL"""


def _hit(rows: str, by: str = "g", x: str = "pred") -> str:
    return f"SELECT {by}, first(truth = lo ORDER BY {x}, k, truth = lo) AS hit FROM (SELECT *, min(truth) OVER (PARTITION BY {by}) AS lo FROM ({rows})) GROUP BY {by}"


def _metrics(rows: str, by: str = "g", x: str = "pred") -> str:
    return f"SELECT r.*, coalesce(n_correct, 0) AS n_correct, coalesce(n_pairs, 0) AS n_pairs, hit FROM ({_rho(rows, by, x)}) r LEFT JOIN ({_pairs(rows, by, x)}) USING ({by}) LEFT JOIN ({_hit(rows, by, x)}) USING ({by})"


_REPORT = """count(*) AS n_groups, avg(rho) AS mean_rho, median(rho) AS median_rho, sum(n_correct) / sum(n_pairs) AS pair_accuracy, avg(n_correct / nullif(n_pairs, 0)) AS mean_group_accuracy, avg(hit::INTEGER) AS top1_rate, count(*) FILTER (rho < 0) AS n_negative"""
_REPORT_FLOATS = "mean_rho median_rho pair_accuracy mean_group_accuracy top1_rate"


@query("H1_group_spearman", _rho(_ROWS), "rho")
def h1(spark, sf_dir):
    return H.spearman(_rows(spark, sf_dir), ["g"], "pred", "truth")


@query("H2_pairwise_accuracy", _pairs(_ROWS))
def h2(spark, sf_dir):
    return H.pairwise_accuracy(_rows(spark, sf_dir), "g", "k", "pred", "truth")


@query("H3_top1_hit", _hit(_ROWS))
def h3(spark, sf_dir):
    return H.top1_hit(_rows(spark, sf_dir), "g", "k", "pred", "truth")


@query("H4_rank_report", f"SELECT {_REPORT} FROM ({_metrics(_ROWS)})", _REPORT_FLOATS)
def h4(spark, sf_dir):
    return H.rank_report(H.group_metrics(_rows(spark, sf_dir), "g", "k", "pred", "truth"))


@query("H5_truth_spread", "SELECT l_orderkey AS g, max(l_extendedprice) - min(l_extendedprice) AS spread FROM lineitem GROUP BY 1", "spread")
def h5(spark, sf_dir):
    return H.truth_spread(_rows(spark, sf_dir), "g", "truth")


@query("H6_kpi_gate", f"SELECT *, CASE WHEN mean_rho < 0.5 THEN 'mean_rho' WHEN top1_rate < 0.99 THEN 'top1_rate' ELSE '' END AS reason, CASE WHEN mean_rho < 0.5 OR top1_rate < 0.99 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT {_REPORT} FROM ({_metrics(_ROWS)}))", _REPORT_FLOATS)
def h6(spark, sf_dir):
    return H.kpi_gate(H.rank_report(H.group_metrics(_rows(spark, sf_dir), "g", "k", "pred", "truth")), {"mean_rho": 0.5, "top1_rate": 0.99})


@query("H7_split_groups", "SELECT p_brand, p_brand IN (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) ORDER BY md5('11|' || p_brand), p_brand LIMIT 15) AS is_train FROM (SELECT DISTINCT p_brand FROM part)")
def h7(spark, sf_dir):
    """A split by whole groups; the limit is the size of the training part."""
    return H.split_groups(table(spark, sf_dir, "part"), "p_brand", 15, 11)


@query("H8_logo_folds", "SELECT l_suppkey AS fold, count(*) AS rows_test, (SELECT count(*) FROM lineitem) - count(*) AS rows_train FROM lineitem GROUP BY 1")
def h8(spark, sf_dir):
    return H.logo_folds(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query(
    "H8_fold_moments",
    """SELECT f.p_brand AS fold, 'p_size' AS "column", avg(p.p_size) AS mean, stddev_pop(p.p_size) AS std FROM (SELECT DISTINCT p_brand FROM part) f JOIN part p ON p.p_brand <> f.p_brand GROUP BY 1
       UNION ALL SELECT f.p_brand, 'p_retailprice', avg(p.p_retailprice), stddev_pop(p.p_retailprice) FROM (SELECT DISTINCT p_brand FROM part) f JOIN part p ON p.p_brand <> f.p_brand GROUP BY 1""",
    "mean std",
)
def h8b(spark, sf_dir):
    return H.fold_moments(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"])


@query("H9_standardise", "SELECT p_partkey, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS p_size_z FROM part", "p_size_z")
def h9(spark, sf_dir):
    return H.standardise(table(spark, sf_dir, "part"), ["p_size"]).select("p_partkey", "p_size_z")


_TRAIN = """SELECT a.g, a.k AS k_a, b.k AS k_b, s AS side, s * (a.truth - b.truth) AS delta, (s * (a.truth - b.truth) > 0)::INTEGER AS label, s * (a.pred - b.pred) AS d_pred
  FROM ({rows}) a JOIN ({rows}) b ON a.g = b.g AND a.k < b.k AND a.truth <> b.truth, (SELECT unnest([1, -1]) AS s)"""


@query("H10_pair_training_table", _TRAIN.format(rows=_ROWS), "delta d_pred")
def h10(spark, sf_dir):
    return H.pair_training_table(_rows(spark, sf_dir), "g", "k", "truth", ["pred"])


@query(
    "H11_gram",
    """SELECT 'p_size' AS i, 'p_size' AS j, sum(p_size * p_size)::DOUBLE AS s FROM part UNION ALL SELECT 'p_size', 'p_retailprice', sum(p_size * p_retailprice) FROM part UNION ALL SELECT 'p_size', '1', sum(p_size) FROM part
       UNION ALL SELECT 'p_retailprice', 'p_retailprice', sum(p_retailprice * p_retailprice) FROM part UNION ALL SELECT 'p_retailprice', '1', sum(p_retailprice) FROM part UNION ALL SELECT '1', '1', count(*) FROM part""",
    "s",
)
def h11(spark, sf_dir):
    return H.gram(table(spark, sf_dir, "part"), [], "p_retailprice", ["p_size"])


@query(
    "H11_ridge_fit",
    "SELECT 'l_quantity' AS feature, regr_slope(l_extendedprice, l_quantity) AS weight FROM lineitem UNION ALL SELECT 'intercept', regr_intercept(l_extendedprice, l_quantity) FROM lineitem",
    "weight",
)
def h11b(spark, sf_dir):
    """Without a penalty the ridge fit is the regression line."""
    return H.ridge_fit(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], 0.0)


@query("H12_pairwise_logistic_fit")
def h12(spark, sf_dir):
    """Weights of an iterative fit."""
    pairs = H.pair_training_table(_rows(spark, sf_dir), "g", "k", "truth", ["pred"])
    return H.pairwise_logistic_fit(pairs, "label", ["d_pred"], 0.1)


@query(
    "H13_cross_validate",
    """WITH s AS (SELECT p_brand AS g, p_partkey AS k, p_size, p_retailprice AS y FROM part), f AS (SELECT t.g, regr_slope(s.y, s.p_size) AS b, regr_intercept(s.y, s.p_size) AS a FROM (SELECT DISTINCT g FROM s) t JOIN s ON s.g <> t.g GROUP BY 1)
       SELECT k AS p_partkey, a + b * p_size AS pred FROM s JOIN f USING (g)""",
    "pred",
)
def h13(spark, sf_dir):
    """Each brand predicted from the others; without a penalty this is the regression line."""
    return H.cross_validate(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice", ["p_size"], 0.0).select("p_partkey", "pred")


# Rounded, so that equal sizes tie however often the fit is reckoned anew.
_FOLDS = """WITH s AS (SELECT p_brand AS g, p_partkey AS k, p_size, p_retailprice AS truth FROM part), f AS (SELECT t.g, regr_slope(s.truth, s.p_size) AS b, regr_intercept(s.truth, s.p_size) AS a FROM (SELECT DISTINCT g FROM s) t JOIN s ON s.g <> t.g GROUP BY 1)
  SELECT g, k, truth, round(a + b * p_size, 8) AS pred FROM s JOIN f USING (g)"""


def _brands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("truth"), "p_size")


@query("H13_fold_metrics", _metrics(_FOLDS), "rho")
def h13b(spark, sf_dir):
    """Rank accuracy of each brand under the fit of the others."""
    return H.evaluate_ridge(_brands(spark, sf_dir), "g", "k", "truth", ["p_size"], 0.0).metrics


@query("H13_fold_report", f"SELECT {_REPORT} FROM ({_metrics(_FOLDS)})", _REPORT_FLOATS)
def h13c(spark, sf_dir):
    return H.evaluate_ridge(_brands(spark, sf_dir), "g", "k", "truth", ["p_size"], 0.0).report


@query("H12_logo_weights")
def h12b(spark, sf_dir):
    """Weights of the pairwise logistic fit with each brand left out; iterative, see test_logistic_folds_equal_direct_fits."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", (F.col("p_size") / 50).alias("size"), (F.length("p_name") / 50).alias("name"))
    return H.evaluate_pairwise(parts, "p_brand", "p_partkey", "p_retailprice", ["size", "name"], 0.1).weights


def _configs(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("k"), F.col("l_extendedprice").alias("truth"), "l_quantity", "l_discount", "l_tax")
    lines = dealt(lines, ["g", "k"], lines.count()).where("g IS NOT NULL AND k IS NOT NULL")
    # The values of a key's only line; written, as they are read twice.
    once = lines.groupBy("g", "k").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("truth", "l_quantity", "l_discount", "l_tax"))).where("n = 1")
    rows = written(once.drop("n"), "lines")
    return rows.select("g", "k", "truth", F.explode(F.array(*(F.struct(F.lit(n).alias("config"), c.alias("pred")) for n, c in (("a", F.col("l_quantity")), ("b", F.col("l_discount")), ("c", F.col("l_quantity") * (1 - F.col("l_tax"))))))).alias("s")).select("g", "k", "truth", "s.*")


_CONFIGS = {"a": "l_quantity", "b": "l_discount", "c": "l_quantity * (1 - l_tax)"}
_CONFIG = "SELECT l_suppkey AS g, l_orderkey * 10000 + l_partkey AS k, l_extendedprice AS truth, {v} AS pred FROM lineitem WHERE (l_suppkey, l_orderkey * 10000 + l_partkey) NOT IN (SELECT (l_suppkey, l_orderkey * 10000 + l_partkey) FROM lineitem GROUP BY ALL HAVING count(*) > 1)"


@query(
    "H14_sweep_leaderboard",
    f"""WITH r AS ({" UNION ALL ".join(f"SELECT '{n}' AS config, * FROM (SELECT {_REPORT} FROM ({_metrics(_CONFIG.format(v=v))}))" for n, v in _CONFIGS.items())})
    SELECT *, row_number() OVER (ORDER BY round(mean_rho, 9) DESC, round(pair_accuracy, 9) DESC, top1_rate DESC, config) = 1 AS best FROM r""",
    _REPORT_FLOATS,
)
def h14(spark, sf_dir):
    """Three configurations over the lines of each supplier; parts that an order has twice from one supplier have no key and are left out."""
    return H.sweep_leaderboard(_configs(spark, sf_dir), "config", "g", "k", "pred", "truth")


_VARIANT = "SELECT l_suppkey AS g, {v} AS pred, l_extendedprice AS truth FROM lineitem"


def _variants_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, g, rho FROM ({_rho(_VARIANT.format(v=v))})" for v in ("l_quantity", "l_discount", "l_tax"))


@query(
    "H15_nested_select",
    f"""WITH m AS ({_variants_sql()}), f AS (SELECT DISTINCT g AS fold FROM m), s AS (SELECT fold, variant, count(*) FILTER (rho < 0) AS bad, median(rho) AS med FROM f JOIN m ON g <> fold GROUP BY 1, 2)
    SELECT fold, variant AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY bad, med DESC, variant) AS r FROM s) WHERE r = 1""",
)
def h15(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("truth"), F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("pred")) for v in ("l_quantity", "l_discount", "l_tax")))).alias("s"))
    return H.nested_select(H.spearman(rows.select("g", "truth", "s.*"), ["variant", "g"], "pred", "truth"), "variant", "g")


@query(
    "H16_rescore_compare",
    f"SELECT variant, count(*) AS n_groups, avg(rho) AS mean_rho, median(rho) AS median_rho, count(*) FILTER (rho < 0) AS n_negative FROM ({_variants_sql()}) GROUP BY 1",
    "mean_rho median_rho",
)
def h16(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("truth"), "l_quantity", "l_discount", "l_tax")
    return H.rescore_compare(rows, "g", "truth", ["l_quantity", "l_discount", "l_tax"])


@query("H17_worst_groups_report", f"SELECT g, coalesce(rho, -1e9) AS value FROM ({_rho(_VARIANT.format(v='l_quantity'))}) ORDER BY 2, 1 LIMIT 3", "value")
def h17(spark, sf_dir):
    """A report of the three worst groups."""
    from gaugeline.operators.windows import worst_groups

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("truth"), F.col("l_quantity").alias("pred"))
    return worst_groups(H.spearman(rows, ["g"], "pred", "truth"), 3, "rho", "g").select("g", "value")


@query(
    "H18_calibration_gate",
    """WITH t AS (SELECT l_suppkey AS trial, avg(l_quantity) / 50 AS auc, avg(l_discount) AS other, max(l_tax) AS coll FROM lineitem GROUP BY 1), s AS (SELECT *, CASE WHEN auc < 0.505 THEN 'auc' WHEN other > 0.0505 THEN 'other' ELSE '' END AS reason, auc - 2 * other - 2 * coll AS score FROM t)
       SELECT trial, reason, CASE WHEN reason = '' THEN 'PASS' ELSE 'FAIL' END AS status, score, coalesce(trial = (SELECT trial FROM s WHERE reason = '' ORDER BY score DESC, trial LIMIT 1), false) AS best FROM s""",
    "score",
)
def h18(spark, sf_dir):
    trials = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg((F.avg("l_quantity") / 50).alias("auc"), F.avg("l_discount").alias("other"), F.max("l_tax").alias("coll"))
    out = H.calibration_gate(trials, "trial", [("auc", "min", 0.505), ("other", "max", 0.0505)], "auc", ["other", "coll"], 2.0)
    return out.select("trial", "reason", "status", "score", "best")


@query(
    "H19_train_holdout_table",
    """SELECT p_brand, avg(p_retailprice) FILTER (p_partkey % 4 > 0) AS x_train, avg(p_retailprice) FILTER (p_partkey % 4 = 0) AS x_holdout FROM part WHERE p_size > 25 GROUP BY 1""",
    "x_train x_holdout",
)
def h19(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("setting"), F.when(F.col("p_partkey") % 4 > 0, "train").otherwise("holdout").alias("part"))
    return H.train_holdout_table(rows.groupBy("p_brand", "setting", "part").agg(F.avg("p_retailprice").alias("x")), "setting", "large", "part", "p_brand", ["x"])


@query("H20_calibrate_scores")
def h20(spark, sf_dir):
    """Iterated fits, checked by tests."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("truth"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 13).cast("double").alias("y"))
    return H.calibrate_scores(rows, "g", "k", "truth", ["x", "y"], 1.0, "x")
