"""Group statistics: moments, quantiles, shares, fits, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import finite, safe_corr
from gaugeline.operators.ordered import running


def group_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of each column; a null key is a group."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"))]
    return df.groupBy(*keys).agg(*aggs)


def group_stats_levels(df: DataFrame, a: str, b: str, column: str) -> DataFrame:
    """The statistics by (a, b) and by a alone, in one pass; level 0 is the finer one."""
    return (
        df.groupingSets([[F.col(a), F.col(b)], [F.col(a)]], a, b)
        .agg(F.grouping_id().cast("int").alias("level"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count(column).alias("n"))
        .select(a, b, "level", "mean", "std", "n")
    )


def describe_by(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    return out.select(*keys, "n", "mean", "std", "min", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"), "max")


def segment_summary(df: DataFrame, segments: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """Mean of each column and count for named segments, which may overlap."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in segments.items())))
    rows = df.select(F.explode(names).alias("segment"), *columns)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_mean") for c in columns))


def band_width_stats(df: DataFrame, keys: Sequence[str], low: str, high: str, width: str) -> DataFrame:
    """Mean width and mean width relative to max(1, high - low + 1)."""
    relative = F.col(width) / F.greatest(F.lit(1), F.col(high) - F.col(low) + 1)
    return df.groupBy(*keys).agg(F.avg(width).alias("mean_width"), F.avg(relative).alias("mean_relative_width"), F.count("*").alias("n"))


def finite_stats(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median, mean and maximum of the finite values."""
    x = finite(F.col(column))
    return df.groupBy(*keys).agg(F.median(x).alias("median"), F.avg(x).alias("mean"), F.max(x).alias("max"))


def ranked_quantiles(df: DataFrame, keys: Sequence[str], column: str, quantiles: Mapping[str, float], rule: str = "nearest") -> DataFrame:
    """(group, {name}): for each named q the value of rank max(1, half-even round(q n)), or ceil(q n) for rule ``ceil``.

    Equal values are one row with a count; a group of any size, or the whole
    table without keys, is put in order by ranges.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("x_"))
    blocks = running(rows.groupBy(*keys, "x_").agg(F.count("*").alias("c_")), keys, ["x_"], {"r_": "c_"}, totals=True, sizes=rows)

    def here(q: float) -> Column:
        n = F.col("r__all")
        target = F.bround(n * F.lit(q), 0) if rule == "nearest" else F.ceil(n * F.lit(q))
        place = F.greatest(F.lit(1), target).cast("long")
        return (F.col("r_") < place) & (place <= F.col("r_") + F.col("c_"))

    return blocks.groupBy(*keys).agg(*(F.max(F.when(here(q), F.col("x_"))).alias(name) for name, q in quantiles.items()))


def ranked_quantile(df: DataFrame, keys: Sequence[str], column: str, q: float, rule: str = "nearest") -> DataFrame:
    """(group, value) of one quantile; see :func:`ranked_quantiles`."""
    return ranked_quantiles(df, keys, column, {"value": q}, rule)


def linear_percentile(df: DataFrame, keys: Sequence[str], column: str, q: float, approximate: bool = False) -> DataFrame:
    """Percentile with linear interpolation; ``approximate`` takes a mergeable sketch instead."""
    value = F.percentile_approx(column, q, 10_000) if approximate else F.percentile(column, q)
    return df.groupBy(*keys).agg(value.alias("value"))


def threshold_fractions(df: DataFrame, keys: Sequence[str], column: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of the values above each threshold."""
    rows = df.where(F.col(column).isNotNull()).select(*keys, column, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    return rows.groupBy(*keys, "threshold").agg(F.avg(F.when(F.col(column) > F.col("threshold"), 1.0).otherwise(0.0)).alias("share"))


def status_summary(df: DataFrame, status: str, seconds: float | None = None) -> DataFrame:
    """Counts of OK, SKIP and ERROR, the rate of OK, and rows a second."""
    n = F.count("*")
    counts = [F.count_if(F.col(status) == k).alias(f"n_{k.lower()}") for k in ("OK", "SKIP", "ERROR")]
    rate = F.try_divide(F.count_if(F.col(status) == "OK").cast("double"), n.cast("double")).alias("ok_rate")
    return df.agg(n.alias("n_rows"), *counts, rate, *([(n / F.lit(seconds)).alias("rows_per_s")] if seconds else []))


def top_reasons(df: DataFrame, reason: str, k: int) -> DataFrame:
    """The k commonest non-empty reasons with their share, ties by name."""
    counts = df.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    total = df.where(F.coalesce(F.col(reason), F.lit("")) != "").agg(F.count("*").alias("total"))
    return counts.orderBy(F.desc("n"), "reason").limit(k).join(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("total")).alias("share"))


def pivot_grid(df: DataFrame, row: str, column: str, value: str, values: Sequence) -> DataFrame:
    """A matrix with a column per value, rows in descending order."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(value)).orderBy(F.desc(row))


def weighted_mean_std(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """Weighted mean and population deviation, about the mean in a second step; 0 without weight."""
    means = df.groupBy(*keys).agg(F.sum(w).alias("w_"), F.sum(F.col(x) * F.col(w)).alias("wx_")).withColumn("mean", F.coalesce(F.try_divide("wx_", "w_"), F.lit(0.0)))
    rows = df.join(means, list(keys)) if keys else df.join(F.broadcast(means))
    spread = F.sum(F.col(w) * (F.col(x) - F.col("mean")) ** 2)
    out = rows.groupBy(*keys, "mean", "w_").agg(spread.alias("s_"))
    return out.select(*keys, "mean", F.coalesce(F.sqrt(F.try_divide("s_", "w_")), F.lit(0.0)).alias("std"))


def to_distribution(df: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """Counts of each key as probabilities p within a group."""
    counts = df.groupBy(*keys, key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, key, "n", (F.col("n") / total).alias("p"))


def distinct_coverage(df: DataFrame, keys: Sequence[str], key: str, expected: int, approximate: bool = False) -> DataFrame:
    """Distinct keys of a group, and their share of the expected number."""
    n = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.groupBy(*keys).agg(n.alias("n_unique")).withColumn("coverage", F.col("n_unique") / F.lit(float(expected)))


def worst_case_gate(df: DataFrame, keys: Sequence[str], least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """Per key the minimum of ``least`` columns and maximum of ``most`` columns over repeats, and whether all limits hold."""
    aggs = [F.min(c).alias(f"min_{c}") for c in least] + [F.max(c).alias(f"max_{c}") for c in most]
    passed = F.lit(True)
    for c, t in least.items():
        passed = passed & (F.col(f"min_{c}") >= t)
    for c, t in most.items():
        passed = passed & (F.col(f"max_{c}") <= t)
    return df.groupBy(*keys).agg(F.count("*").alias("n_repeats"), *aggs).withColumn("gate_pass", F.coalesce(passed, F.lit(False)))


def all_any_flags(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """all_equal, all_zero and never_nonzero of a column; false without values."""
    x = F.col(column)
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(x) == F.max(x), F.lit(False)).alias("all_equal"),
        F.coalesce(F.bool_and(x == 0), F.lit(False)).alias("all_zero"),
        (~F.coalesce(F.bool_or(x != 0), F.lit(False)) & (F.count(x) > 0)).alias("never_nonzero"),
    )


def ratio_fit(df: DataFrame, keys: Sequence[str], y: str, n: str) -> DataFrame:
    """alpha = sum y / sum n ln(1 + n)."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(y).cast("double"), F.sum(F.col(n) * F.log1p(n))).alias("alpha"))


def linear_fit(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept and root mean square residual of y on x."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    rows = df.join(fit, list(keys)) if keys else df.join(F.broadcast(fit))
    residual = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    return rows.groupBy(*keys, "slope", "intercept").agg(F.sqrt(F.avg(residual * residual)).alias("rmse"))


def linear_residuals(df: DataFrame, keys: Sequence[str], y: str, x: str, slope: float, intercept: float) -> DataFrame:
    """Root mean square and largest absolute difference to a given line."""
    delta = F.col(y) - (F.lit(slope) * F.col(x) + F.lit(intercept))
    return df.groupBy(*keys).agg(F.sqrt(F.avg(delta * delta)).alias("rmse"), F.max(F.abs(delta)).alias("max_abs"))


def penalty_scan(df: DataFrame, penalty: str, density: str, target: str, segment: Column, betas: Sequence[float]) -> DataFrame:
    """For each beta: correlation of penalty (1 + beta density) with the target, and its mean in and out of a segment."""
    rows = df.select(F.explode(F.array(*(F.lit(float(b)) for b in betas))).alias("beta"), penalty, density, target, segment.alias("in_"))
    rows = rows.withColumn("x_", F.col(penalty) * (1 + F.col("beta") * F.col(density)))
    return rows.groupBy("beta").agg(safe_corr("x_", target).alias("corr"), F.avg(F.when(F.col("in_"), F.col("x_"))).alias("mean_in"), F.avg(F.when(~F.col("in_"), F.col("x_"))).alias("mean_out"))


def correlations(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of listed columns over complete rows, null under two of them."""
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in pairs))).alias("s"))
    rows = rows.select(*keys, "s.*").where("a IS NOT NULL AND b IS NOT NULL")
    return rows.groupBy(*keys, "pair").agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, safe_corr("a", "b")).alias("corr"))


def plateau_lists(df: DataFrame, value: str, member: str, digits: int = 4) -> DataFrame:
    """Members of each value, rounded, in order."""
    return df.groupBy(F.round(value, digits).alias("value")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(member).cast("string"))), ",").alias("members"))


def bin_performance(df: DataFrame, keys: Sequence[str], speed: str, ratio: str, passed: str) -> DataFrame:
    """n, median speed-up, median ratio, pass rate and 95th percentile of the ratio per bin."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(speed).alias("median_speed"), F.median(ratio).alias("median_ratio"), F.avg(F.when(F.col(passed), 1.0).otherwise(0.0)).alias("pass_rate"), F.percentile(ratio, 0.95).alias("p95_ratio")
    )


def stage_attribution(df: DataFrame, cohort: str, stage: str, cost: str, base: str, other: str, share: float = 0.6) -> DataFrame:
    """Slowest stage by the ratio of cohort medians, and the bottleneck: a stage with ``share`` of the cost, else MIXED."""
    med = df.groupBy(stage).agg(F.median(F.when(F.col(cohort) == base, F.col(cost))).alias("base_cost"), F.median(F.when(F.col(cohort) == other, F.col(cost))).alias("other_cost"))
    med = med.withColumn("ratio", F.try_divide("other_cost", "base_cost"))
    top = med.agg(F.max(F.struct("ratio", stage))[stage].alias("slowest"), F.max(F.struct("other_cost", stage)).alias("top"), F.sum("other_cost").alias("total"))
    return top.select("slowest", F.when(F.col("top.other_cost") >= share * F.col("total"), F.col(f"top.{stage}")).otherwise("MIXED").alias("bottleneck"), (F.col("top.other_cost") / F.col("total")).alias("top_share"))


def break_even(df: DataFrame, size: str, ratio: str, gate: float) -> DataFrame:
    """Smallest size of at least ``gate`` with a median ratio of 1 or more."""
    med = df.groupBy(size).agg(F.median(ratio).alias("m"))
    return med.agg(F.min(F.when((F.col(size) >= gate) & (F.col("m") >= 1), F.col(size))).alias("break_even"))


def sweep_summary(df: DataFrame, keys: Sequence[str], metric: str, residual: str) -> DataFrame:
    """10th, 50th and 90th percentile of a metric, invalid rows, largest absolute residual."""
    x = finite(F.col(metric))
    q = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*keys).agg(q.alias("q"), F.count_if(x.isNull()).alias("n_invalid"), F.max(F.abs(residual)).alias("max_residual"))
    return out.select(*keys, F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("p90"), "n_invalid", "max_residual")


def fraction_summary(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Shares of zero and other values, maximum, mean and population deviation."""
    x = F.col(column)
    return df.groupBy(*keys).agg(
        F.avg(F.when(x == 0, 1.0).when(x.isNotNull(), 0.0)).alias("share_zero"), F.avg(F.when(x != 0, 1.0).when(x.isNotNull(), 0.0)).alias("share_nonzero"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_pop")
    )


def scan_trace_stats(df: DataFrame, item: str, step: str, value: str, tol: float) -> DataFrame:
    """Per item the first, last and largest value and the steps; then minimum, median, mean, maximum of the steps and the converged share."""
    per = df.groupBy(item).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.max(value).alias("largest"), F.count("*").alias("steps"))
    done = F.avg(F.when(F.col("last") <= tol, 1.0).otherwise(0.0))
    return per.agg(F.count("*").alias("n_items"), F.min("steps").alias("min_steps"), F.median("steps").alias("median_steps"), F.avg("steps").alias("mean_steps"), F.max("steps").alias("max_steps"), done.alias("converged_rate"), F.max("largest").alias("largest"))


def mean_ci(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Mean and 1.96 standard errors, 0 for one row."""
    half = F.when(F.count(x) > 1, 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), half.alias("ci95"), F.count(x).alias("n"))


def density_kurtosis(df: DataFrame, keys: Sequence[str], x: str, density: str) -> DataFrame:
    """Excess kurtosis of x under the weight 4 pi x**2 density, by the trapezoid rule over sorted x."""
    w = Window.partitionBy(*keys).orderBy(x)
    mass = 4 * F.pi() * F.col(x) * F.col(x) * F.col(density)
    gap = F.coalesce(F.lead(x).over(w) - F.col(x), F.lit(0.0)) + F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    rows = df.select(*keys, F.col(x).alias("x"), (mass * gap / 2).alias("m"))
    means = rows.groupBy(*keys).agg((F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("mu"))
    rows = rows.join(means, list(keys)) if keys else rows.join(F.broadcast(means))
    d = F.col("x") - F.col("mu")
    out = rows.groupBy(*keys).agg((F.sum(F.col("m") * d**4) / F.sum("m")).alias("m4"), (F.sum(F.col("m") * d**2) / F.sum("m")).alias("m2"))
    return out.select(*keys, (F.try_divide("m4", F.col("m2") * F.col("m2")) - 3).alias("kurtosis"))


def near_minimum_band(df: DataFrame, by: str, x: str, y: str, delta: float) -> DataFrame:
    """Best x, least y, and all x with y within delta of it: width and list."""
    low = F.min(y).over(Window.partitionBy(by))
    rows = df.withColumn("low_", low).where(F.col(y) <= F.col("low_") + delta)
    return rows.groupBy(by).agg(F.min(F.struct(y, x))[x].alias("best"), F.min(y).alias("least"), F.min(x).alias("band_min"), F.max(x).alias("band_max"), F.count("*").alias("width"), F.array_join(F.array_sort(F.collect_list(x)).cast("array<string>"), ",").alias("band"))


def error_by_method(df: DataFrame, keys: Sequence[str], value: str, truth: str) -> DataFrame:
    """Mean and largest absolute error."""
    err = F.abs(F.col(value) - F.col(truth))
    return df.groupBy(*keys).agg(F.count(err).alias("n"), F.avg(err).alias("mae"), F.max(err).alias("max_error"))


def label_agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Matches, rows and their ratio between two labelings."""
    return df.groupBy(*keys).agg(F.count_if(F.col(a) == F.col(b)).alias("matches"), F.count("*").alias("total")).withColumn("rate", F.col("matches") / F.col("total"))


def running_percentile(df: DataFrame, keys: Sequence[str], x: str, q: float) -> DataFrame:
    """Mean and a mergeable approximate percentile, for long runs."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.percentile_approx(x, q, 10_000).alias("percentile"))


def quantile_sketches(df: DataFrame, keys: Sequence[str], x: str, k: int = 400) -> DataFrame:
    """(group, n, total, sketch, rank_error): a run's mean and quantiles in a few kilobytes, to be stored and merged later.

    ``sketch`` is a KLL sketch of parameter ``k`` over the values that are not
    null or NaN. ``rank_error`` bounds, with a probability of 99 %, how far the
    rank of a quantile told by it, or by any merging of such sketches, is from
    the one asked for, as a share of n; a run of no more than k values is exact.
    """
    v = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))
    return out.withColumn("rank_error", F.lit(kll_rank_error(k)))


def kll_rank_error(k: int) -> float:
    """The published normalised rank error of one rank from a KLL sketch, 2.296 / k ** 0.9021."""
    return 2.296 / k**0.9021


def merge_sketches(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sketches of runs added up by group, or all in one row; the bound on ranks is that of the widest."""
    return runs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"), F.max("rank_error").alias("rank_error"))


def sketch_quantiles(runs: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """The sketches' mean, {name} for each named quantile, and the rank error; null for a run without values."""
    kept = [c for c in runs.columns if c not in ("sketch", "total", "n", "rank_error")]
    told = {name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(name) for name, q in quantiles.items()}
    return runs.select(*kept, "n", F.try_divide("total", "n").alias("mean"), *told.values(), "rank_error")
