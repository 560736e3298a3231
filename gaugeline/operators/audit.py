"""Ranking audit: weighted AUC, null distributions, gates, hardness, separation."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import finite, hardness_bin, pair_credit, safe_corr
from gaugeline.operators.joins import tolerance_counts
from gaugeline.operators.nulls import label_null
from gaugeline.operators.ordered import dealt, mean_rank, null_safe_join, ranked, running
from gaugeline.operators.stats import ranked_quantiles, weighted_mean_std
from gaugeline.sources.files import written


def weighted_auc(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = "weight", ranges: int | None = None) -> DataFrame:
    """(group, n_pos, n_neg, auc): sum over tie blocks of pos (negatives below + half of those in the block), over W+ W-.

    Rows are summed by score first, and a large group, or the whole table
    without one, is put in order by ranges, so no task holds all its scores.
    A group without a positive or a negative has a null AUC. Rows with a null or
    non-finite score are left out.
    """
    s = finite(F.col(score))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(s.isNotNull() & F.col(label).isNotNull()).select(*by, s.alias("s"), (F.col(label) == 1).alias("y"), w.alias("w"))
    zero = F.lit(0.0)
    blocks = rows.groupBy(*by, "s").agg(
        F.sum(F.when(F.col("y"), F.col("w")).otherwise(zero)).alias("pos"),
        F.sum(F.when(~F.col("y"), F.col("w")).otherwise(zero)).alias("neg"),
        F.count_if("y").alias("np"),
        F.count_if(~F.col("y")).alias("nn"),
    )
    out = running(blocks, by, ["s"], {"below": "neg"}, ranges=ranges, sizes=rows).groupBy(*by).agg(
        F.sum("np").alias("n_pos"), F.sum("nn").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"), F.sum("pos").alias("wp"), F.sum("neg").alias("wn")
    )
    return out.select(*by, "n_pos", "n_neg", F.try_divide("u", F.col("wp") * F.col("wn")).alias("auc"))


def weighted_auc_global(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = "weight", ranges: int | None = None) -> DataFrame:
    """The AUC of a whole table; see :func:`weighted_auc`."""
    return weighted_auc(df, [], score, label, weight, ranges).select("auc")


#: The product loses digits with every factor, so few are taken; with more, or as many steps, the characteristic function is inverted.
_FACTORS, _STEPS = 20, 20_000_000
#: Nodes and factors of the characteristic function that are held at once: 32 MB an array.
_NODES, _HELD = 64, 1 << 16


def _null_masses(m: int, n: int) -> np.ndarray:
    """Probability of each U for m positives and n negatives in random order without ties.

    The product over i <= m of (1 - x^(n + i)) / (1 - x^i), each factor scaled to sum to 1.
    """
    m, n = min(m, n), max(m, n)
    p = np.zeros(m * n + 1)
    p[0] = 1.0
    for i in range(1, m + 1):
        top = i * n + 1
        q = p[:top].copy()
        if top > n + i:
            q[n + i :] -= p[: top - n - i]
        lanes = np.zeros((-(-top // i), i))
        lanes.reshape(-1)[:top] = q
        p[:top] = np.cumsum(lanes, axis=0).reshape(-1)[:top] * (i / (n + i))
    return p


def _null_below(m: int, n: int):
    """u -> probability of U <= u, by inverting the characteristic function on a lattice far wider than the distribution.

    As exact as doubles are: nodes are added until all of a block are under 1e-17.
    """
    m, n = min(m, n), max(m, n)
    sd = math.sqrt(m * n * (m + n + 1) / 12)
    width = int(min(m * n + 2, math.ceil(40 * sd)))
    first = max(0, (m * n - width) // 2 - 1)
    t, r = [], []
    for k in range(1, width // 2 + 1, _NODES):
        at = np.arange(k, min(k + _NODES, width // 2 + 1)) * (2 * math.pi / width)
        size, sign = np.zeros(len(at)), np.ones(len(at))
        for lo in range(1, m + 1, _HELD):
            j = np.arange(lo, min(lo + _HELD, m + 1))
            low, high = np.sin(np.outer(at, j) / 2), np.sin(np.outer(at, n + j) / 2)
            with np.errstate(divide="ignore"):
                size += np.log(np.abs(high * j)).sum(axis=1) - np.log(np.abs(low * (n + j))).sum(axis=1)
            sign *= np.prod(np.sign(high) * np.sign(low), axis=1)
        found = np.exp(size) * sign
        t.append(at)
        r.append(found)
        if np.abs(found).max() < 1e-17:
            break
    t, r = np.concatenate(t), np.concatenate(r)
    weight = np.where(np.isclose(t, math.pi), 1.0, 2.0) * r / np.sin(t / 2) / (2 * width)
    center = m * n / 2
    start = np.sin(t * (first - 0.5 - center))
    return lambda u: (u - first + 1) / width + float((weight * (np.sin(t * (u + 0.5 - center)) - start)).sum())


def _pairs_below(n: int, u: int) -> int:
    """Orders of two positives and n negatives whose U is u or less."""
    half = u // 2 + 1
    beyond = max(0, u - n)
    return half * (half + u % 2) - beyond * (beyond + 1) // 2


def exact_null_quantile(m: int, n: int, q: float) -> float:
    """Least AUC whose probability up to it is q or more, for m positives and n negatives in random order without ties."""
    q = q - 1e-11
    if min(m, n) <= 2:
        m, n = min(m, n), max(m, n)
        below, total = (lambda u: u + 1, n + 1) if m == 1 else (partial(_pairs_below, n), (n + 2) * (n + 1) // 2)
        least = math.ceil(Fraction(q) * total)
        return bisect_left(range(m * n), least, key=below) / (m * n)
    if min(m, n) <= _FACTORS and min(m, n) ** 2 * max(m, n) <= _STEPS:
        return min(int(np.searchsorted(np.cumsum(_null_masses(m, n)), q)), m * n) / (m * n)
    below = _null_below(m, n)
    low, high = 0, m * n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if below(mid) >= q else (mid + 1, high)
    return low / (m * n)


def null_auc_quantile(sizes: DataFrame, q: float) -> DataFrame:
    """(n_pos, n_neg, null_q, null_method) for each distinct pair of sizes, exact at every size.

    null_method is exact, or none without a positive or a negative.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for m, n in zip(pdf["n_pos"], pdf["n_neg"], strict=True):
                rows.append((m, n, None, "none") if m < 1 or n < 1 else (m, n, exact_null_quantile(int(m), int(n), q), "exact"))
            yield pd.DataFrame(rows, columns=["n_pos", "n_neg", "null_q", "null_method"])

    return sizes.select("n_pos", "n_neg").distinct().mapInPandas(run, "n_pos long, n_neg long, null_q double, null_method string")


def null_auc_single(n: Column, q: float) -> Column:
    """Null quantile with one positive (or one negative) against n: all n + 1 ranks are equally likely."""
    return F.when(n >= 1, (F.greatest(F.ceil(F.lit(q) * (n + 1)), F.lit(1)) - 1) / n.cast("double"))


#: Rows of a group up to which its labelings are reckoned in one row, so that no labeling is a row of its own.
HELD = 10_000


def null_by_enumeration(df: DataFrame, by: Sequence[str], key: str, q: float, reps: int, seed: int, score: str = "score", label: str = "label", limit: int = 10) -> DataFrame:
    """(group, null_method, n_labelings, null_q): the AUC quantile over labelings with as many positives.

    All labelings for groups of up to ``limit`` rows, and ``reps`` permutations
    (see :func:`null_by_permutation`) for larger ones; null_method says which.
    Groups without a positive or a negative have the method none. Groups of up
    to HELD rows are shuffled once, dealt to tasks of a bounded number of rows,
    and only then meet their labelings.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.sum(label).alias("m"), F.count("*").alias("n"))
    told = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    m, n = F.col("m"), F.col("n")
    method = F.when((m <= 0) | (m >= n), "none").when(n <= limit, "enumeration").otherwise("permutation").alias("null_method")
    keyed = F.lit(True)
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    held = max(HELD, limit)
    large = sizes.where(keyed & (n > held))
    rows = df.where(keyed)
    nothing = [F.lit(None).cast("long").alias("n_labelings"), F.lit(None).cast("double").alias("null_q")]
    out = sizes.where(~keyed).select(*by, method, *nothing)
    if (told["most"] or 0) > held:
        drawn = null_by_permutation(rows.join(large.where((m > 0) & (m < n)), by, "left_semi"), by, key, reps, q, seed, score, label)
        drawn = drawn.select(*by, F.lit(reps).cast("long").alias("n_labelings"), "null_q")
        out = out.unionByName(large.select(*by, method).join(drawn, by, "left"))
        rows = rows.join(large, by, "left_anti")
    return out.unionByName(_held_null(rows, by, method, told["all"], key, q, reps, seed, score, label))


def _held_null(df: DataFrame, by: Sequence[str], method: Column, total: int | None, key: str, q: float, reps: int, seed: int, score: str, label: str) -> DataFrame:
    """The same for groups that fit a row.

    With r twice the items below an item plus those at its score (its own
    included), and p positives, twice the credit of a labeling is the sum of r
    over positives less p**2. An item without a finite score takes its place in
    a labeling but has no credit.
    """
    rows = df.select(*by, F.col(key).cast("string").alias("k"), F.col(label).alias("y"), finite(F.col(score)).alias("s"))
    rows = dealt(rows, by, total).withColumn("f", F.col("s").isNotNull())
    r = F.when(F.col("f"), (2 * mean_rank([*by, "f"], "s") - 1).cast("long")).otherwise(0)
    item = F.struct("k", r.alias("r"), F.col("f").cast("long").alias("f"))
    groups = rows.select(*by, "y", item.alias("e")).groupBy(*by).agg(F.sum("y").alias("m"), F.count("*").alias("n"), F.sum("e.f").alias("f"), F.collect_list("e").alias("x"))

    def auc(items: Column) -> Column:
        credit = F.aggregate(items, F.lit(0).cast("long"), lambda a, e: a + e["r"])
        whole = F.col("f") == F.col("n")
        p = F.when(whole, F.size(items).cast("long")).otherwise(F.aggregate(items, F.lit(0).cast("long"), lambda a, e: a + e["f"]))
        return F.struct(credit.alias("c"), p.alias("p"))

    def chosen(mask: Column) -> Column:
        return auc(F.filter("x", lambda e, i: F.getbit(mask, i) == 1))

    def turned(rep: Column) -> Column:
        turn = F.transform("x", lambda e: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), e["k"])).alias("t"), e["r"].alias("r"), e["f"].alias("f")))
        return auc(F.slice(F.sort_array(turn), F.lit(1), F.col("m").cast("int")))

    masks = F.filter(F.expr("sequence(0L, shiftleft(1L, cast(n AS int)) - 1)"), lambda mask: F.bit_count(mask) == F.col("m"))
    labelings = F.when(F.col("null_method") == "enumeration", F.transform(masks, chosen)).when(F.col("null_method") == "permutation", F.transform(F.sequence(F.lit(1), F.lit(reps)), turned))
    rows = groups.select(*by, "m", "n", "f", "x", method).withColumn("a", labelings)
    value = F.transform("a", lambda e: F.try_divide((e["c"] - e["p"] * e["p"]) / F.lit(2.0), (e["p"] * (F.col("f") - e["p"])).cast("double")))
    rows = rows.select(*by, "null_method", "f", F.sort_array(value).alias("a"))
    exact = F.get("a", F.greatest(F.lit(1), F.ceil(F.size("a") * F.lit(q) - 1e-9)).cast("int") - 1)
    rows = rows.withColumn("v", F.filter("a", lambda e: e.isNotNull()))
    place = (F.size("v") - 1) * F.lit(q)
    low, high = F.floor(place), F.ceil(place)
    under, over = F.get("v", low.cast("int")), F.get("v", high.cast("int"))
    between = F.when(under == over, under).otherwise((high - place) * under + (place - low) * over)
    listed = (F.col("null_method") == "enumeration") & (F.col("f") > 0) & (F.size("a") > 0)
    drawn = (F.col("null_method") == "permutation") & (F.size("v") > 0)
    n_labelings = F.when(listed, F.size("a").cast("long")).when(drawn, F.lit(reps).cast("long"))
    return rows.select(*by, "null_method", n_labelings.alias("n_labelings"), F.when(listed, exact).when(drawn, between).alias("null_q"))


def null_by_permutation(df: DataFrame, by: Sequence[str], key: str, reps: int, q: float, seed: int, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(group, null_mean, null_q) over label permutations; the order of a draw is that of md5(seed|rep|key).

    Every draw orders all rows, so that SQL can draw the same; see
    :func:`gaugeline.operators.nulls.label_null` for large tables.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col(key).alias("k"), F.col(score).alias("score"), w.alias("weight"), F.sum(label).over(Window.partitionBy(*by)).alias("m"))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    turn = F.row_number().over(Window.partitionBy(*by, "rep").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("k").cast("string")))))
    drawn = rows.withColumn("label", F.when(turn <= F.col("m"), 1).otherwise(0))
    return _null_summary(weighted_auc(drawn, [*by, "rep"]), by, q)


def null_by_random_score(df: DataFrame, by: Sequence[str], key: str, reps: int, q: float, seed: int, label: str = "label", weight: str | None = None) -> DataFrame:
    """(group, null_mean, null_q) with scores drawn from md5(seed|rep|key)."""
    rows = df.select(*by, F.col(key).alias("k"), F.col(label).alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("k").cast("string")))
    drawn = rows.withColumn("score", F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12 - 1))
    return _null_summary(weighted_auc(drawn, [*by, "rep"]), by, q)


def _null_summary(aucs: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    return aucs.where("auc IS NOT NULL").groupBy(*by).agg(F.avg("auc").alias("null_mean"), F.percentile("auc", q).alias("null_q"))


def audit_verdict(aucs: DataFrame, nulls: DataFrame, margin: float) -> DataFrame:
    """gate = min(1, null quantile + margin), slack = auc - gate, PASS or FAIL; null without an AUC or a null quantile."""
    found = aucs.join(nulls, ["n_pos", "n_neg"], "left").withColumn("gate", F.when(F.col("null_q").isNotNull(), F.least(F.lit(1.0), F.col("null_q") + margin)))
    found = found.withColumn("slack", F.col("auc") - F.col("gate"))
    return found.withColumn("verdict", F.when(F.col("slack") >= 0, "PASS").when(F.col("slack") < 0, "FAIL"))


def item_audit(df: DataFrame, by: Sequence[str], q: float = 0.95, margin: float = 0.05, score: str = "score", label: str = "label", weight: str | None = "weight") -> DataFrame:
    """Per item n_pos, n_neg, auc, null_q, null_method, gate, slack and verdict."""
    aucs = weighted_auc(df, by, score, label, weight)
    return audit_verdict(aucs, null_auc_quantile(aucs, q), margin).select(*by, "n_pos", "n_neg", "auc", "null_q", "null_method", "gate", "slack", "verdict")


def item_audit_labels(df: DataFrame, by: Sequence[str], reps: int, q: float = 0.95, margin: float = 0.05, seed: int = 0, score: str = "score", label: str = "label", weight: str | None = "weight") -> DataFrame:
    """The columns of :func:`item_audit` and null_mean, with a null that keeps ties and weights; see :func:`gaugeline.operators.nulls.label_null`."""
    aucs = weighted_auc(df, by, score, label, weight).select(*by, "auc")
    nulls = label_null(df, by, reps, q, seed, score, label, weight)
    found = null_safe_join(nulls, aucs, by).select(*by, "n_pos", "n_neg", "auc", "null_q", "null_mean", "null_method")
    found = found.withColumn("gate", F.when(F.col("null_q").isNotNull(), F.least(F.lit(1.0), F.col("null_q") + margin)))
    found = found.withColumn("slack", F.col("auc") - F.col("gate"))
    return found.withColumn("verdict", F.when(F.col("slack") >= 0, "PASS").when(F.col("slack") < 0, "FAIL"))


def hardness_curve(pairs: DataFrame, similarity: str = "similarity", medium: float = 0.5, hard: float = 0.7) -> DataFrame:
    """(bin, n_total, n_scored, auc, median_similarity) of pairs (pos_score, neg_score, weight)."""
    scored = F.col("pos_score").isNotNull() & F.col("neg_score").isNotNull()
    w = F.when(scored, F.col("weight"))
    rows = pairs.withColumn("bin", hardness_bin(F.col(similarity), medium, hard))
    credit = pair_credit(F.col("pos_score"), F.col("neg_score"))
    return rows.groupBy("bin").agg(F.count("*").alias("n_total"), F.count_if(scored).alias("n_scored"), F.try_divide(F.sum(w * credit), F.sum(w)).alias("auc"), F.median(similarity).alias("median_similarity"))


def interpret_hardness(curve: DataFrame, min_hard: int = 50, success: float = 0.6, easy_median: float = 0.5) -> DataFrame:
    """One row (verdict, reason): INCONCLUSIVE, ILLUSION or SUCCESS, by the first rule that holds."""
    def of(b: str, c: str) -> Column:
        return F.max(F.when(F.col("bin") == b, F.col(c))).alias(f"{b}_{c}")

    row = curve.agg(of("hard", "n_scored"), of("hard", "auc"), of("easy", "auc"), F.max(F.when(F.col("bin") != "unknown", F.col("median_similarity"))).alias("top_median"))
    rules = [
        (F.coalesce(F.col("top_median"), F.lit(0.0)) < easy_median, "INCONCLUSIVE", "negatives_too_easy"),
        (F.coalesce(F.col("hard_n_scored"), F.lit(0)) < min_hard, "INCONCLUSIVE", "too_few_hard_pairs"),
        (F.col("hard_auc").isNull(), "INCONCLUSIVE", "no_hard_auc"),
        (F.col("hard_auc") < success, "ILLUSION", "hard_pairs_not_separated"),
    ]
    return row.select(F.coalesce(*(F.when(c, v) for c, v, _ in rules), F.lit("SUCCESS")).alias("verdict"), F.coalesce(*(F.when(c, r) for c, _, r in rules), F.lit("hard_pairs_separated")).alias("reason"))


def slack_stats(df: DataFrame, keys: Sequence[str] = (), slack: str = "slack", verdict: str = "verdict") -> DataFrame:
    """Rows, pass rate, mean and quartiles of the slack by nearest rank, over rows with a verdict."""
    rows = df.where(F.col(verdict).isNotNull()).select(*keys, F.col(slack).alias("x"), F.col(verdict).alias("v"))
    base = rows.groupBy(*keys).agg(F.count("*").alias("n_ok"), F.avg(F.when(F.col("v") == "PASS", 1.0).otherwise(0.0)).alias("pass_rate"), F.avg("x").alias("mean_slack"))
    found = ranked_quantiles(rows, keys, "x", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(found, list(keys), "left") if keys else base.join(F.broadcast(found), how="left")


def audit_warnings(weighted: Column, missing: Column, scored: Column) -> Column:
    """Sorted warnings: a weighted AUC beside an unweighted null, and scores that are missing in part."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(weighted, "weighted_auc_vs_unweighted_null"), F.when((missing > 0) & (scored > 0), "scores_partially_missing")))))


def class_separation(df: DataFrame, by: Sequence[str], x: str, cls: str, a, b, weight: str = "weight", trivial: float = 0.99) -> DataFrame:
    """Weighted means of two classes, their difference, effect size, AUC either way round, and whether it is trivial."""
    rows = df.where(F.col(cls).isin(a, b)).select(*by, F.col(x).alias("x"), (F.col(cls) == F.lit(a)).cast("int").alias("label"), F.col(weight).cast("double").alias("w"))
    stats = weighted_mean_std(rows, [*by, "label"], "x", "w")
    one, two = (stats.where(F.col("label") == k).select(*by, F.col("mean").alias(f"mean_{n}"), F.col("std").alias(f"std_{n}")) for k, n in ((1, "a"), (0, "b")))
    aucs = weighted_auc(rows, by, "x", "label", "w").select(*by, "auc")
    both = one.join(two, list(by)).join(aucs, list(by)) if by else one.join(two).join(aucs)
    pooled = F.sqrt((F.col("std_a") ** 2 + F.col("std_b") ** 2) / 2)
    best = F.greatest("auc", 1 - F.col("auc"))
    return both.select(*by, "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("delta"), F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled).alias("effect"), "auc", best.alias("best_auc"), (best >= trivial).alias("trivial"))


def feature_screen(long_df: DataFrame, item: str, feature: str, x: str, cls: str, a, b, weight: str, baseline: DataFrame, limit: float = 0.999) -> DataFrame:
    """Separation of two classes by every feature of ``long_df(item, feature, x, class, weight)``, against ``baseline(item, value)``.

    Adds per feature: rho, the absolute rank correlation with the baseline over
    the items of both classes (null if either is constant); proxy, whether it is
    ``limit`` or more; auc_gap, best_auc less that of the baseline;
    selected_default for the largest absolute difference of means, and selected
    for the largest best_auc among features that are no proxies, ties by
    feature. All features are ranked in one sort of (feature, value), whose
    ranges split a feature of any size. Items without a baseline are left out.
    """
    base = baseline.select(F.col(item).alias("i_"), F.col("value").cast("double").alias("v_"))
    rows = long_df.where(F.col(cls).isin(a, b) & finite(F.col(x)).isNotNull()).select(F.col(item).alias("i_"), F.col(feature).alias("f_"), F.col(x).cast("double").alias("x_"), F.col(cls).alias("k_"), F.col(weight).alias("w_"))
    items = written(rows.groupBy("i_").agg(F.max("k_").alias("k_"), F.max("w_").alias("w_")).join(base, "i_"), "items")
    ranks = ranked(items, [], "v_", "rv_").select("i_", "rv_")
    both = ranked(rows, ["f_"], "x_", "rx_").join(ranks, "i_")
    varied = (F.min("rx_") < F.max("rx_")) & (F.min("rv_") < F.max("rv_"))
    rho = both.groupBy("f_").agg(F.when(varied, F.round(F.abs(safe_corr("rx_", "rv_")), 12)).alias("rho"))
    found = class_separation(rows.join(items.select("i_"), "i_", "left_semi"), ["f_"], "x_", "k_", a, b, "w_").join(rho, "f_")
    own = class_separation(items, [], "v_", "k_", a, b, "w_").select(F.col("best_auc").alias("base_"))
    found = written(found.join(F.broadcast(own)).withColumn("auc_gap", F.col("best_auc") - F.col("base_")).drop("base_").withColumn("proxy", F.coalesce(F.col("rho") >= limit, F.lit(False))), "screen")
    top = found.agg(F.max(F.round(F.abs("delta"), 12)).alias("d_"), F.max(F.when(~F.col("proxy"), F.round("best_auc", 12))).alias("a_"))
    marked = found.join(F.broadcast(top))
    first = marked.agg(F.min(F.when(F.round(F.abs("delta"), 12) == F.col("d_"), F.col("f_"))).alias("fd_"), F.min(F.when(~F.col("proxy") & (F.round("best_auc", 12) == F.col("a_")), F.col("f_"))).alias("fa_"))
    out = found.join(F.broadcast(first)).withColumns({"selected_default": F.coalesce(F.col("f_") == F.col("fd_"), F.lit(False)), "selected": F.coalesce(F.col("f_") == F.col("fa_"), F.lit(False))})
    return out.drop("fd_", "fa_").withColumnRenamed("f_", feature)


def one_vs_other(df: DataFrame, x: str, cls: str, classes: Sequence, weight: str = "weight") -> DataFrame:
    """(class, best_auc): each listed class against all other rows, in one pass."""
    rows = df.select(F.explode(F.array(*(F.lit(c) for c in classes))).alias("class"), F.col(x).alias("x"), F.col(cls).alias("c"), F.col(weight).alias("w"))
    aucs = weighted_auc(rows.withColumn("label", (F.col("c") == F.col("class")).cast("int")), ["class"], "x", "label", "w")
    return aucs.select("class", "n_pos", "n_neg", F.greatest("auc", 1 - F.col("auc")).alias("best_auc"))


def collision_summary(df: DataFrame, key: str, value: str, cls: str, tol: float) -> DataFrame:
    """One row: colliding pairs in all, within and across classes, their rates, and the largest gap across classes.

    Pairs are counted and not listed, see :func:`gaugeline.operators.joins.tolerance_counts`.
    A row of a null class is in pairs, but in none within or across classes.
    """
    rows = df.where(F.col(value).isNotNull())
    hits = tolerance_counts(rows, value, tol, cls)
    total = rows.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("n_total"))
    return hits.join(F.broadcast(total)).withColumns({"rate": F.try_divide("n_pairs", "n_total"), "across_rate": F.try_divide("n_across", "n_total")})


def vector_collision_rate(df: DataFrame, key: str, vec: str, tol: float) -> DataFrame:
    """One row: pairs equal in every coordinate (within tol + 1e-5 |b|, where b has the greater key).

    Equal vectors are one class with a count, and their pairs are not listed.
    Classes meet in cells of the coordinates with most different cells, up to
    three, so coordinates that hardly differ cost nothing; each candidate is
    compared in full. Only where two classes are equal in one direction and not
    in the other are their keys compared. Vectors with a null, NaN or infinite
    coordinate are in the total and equal no other.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where("size(v) > 0")
    total = rows.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("n_total"))
    sound = rows.where(F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"))
    classes = written(sound.groupBy("v").agg(F.count("*").alias("c")).withColumn("id", F.monotonically_increasing_id()), "vectors")

    def cell(x: Column) -> Column:
        # On this scale, steps of the tolerance are about 1e-5 or less everywhere.
        return F.floor(F.asinh(x * F.lit(1e-5 / max(tol, 1e-300)) if tol else x) / F.lit(2e-5))

    spread = classes.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.approx_count_distinct(cell(F.col("x"))).alias("n"))
    n = classes.count()
    best = spread.orderBy(F.desc("n"), "at").limit(3).collect()
    # One coordinate is enough if it leaves few classes to a cell, and so on.
    enough = next((g for g in range(1, len(best)) if math.prod(b.n for b in best[:g]) >= n / 4), len(best))
    chosen = [b["at"] for b in best[:enough]]
    cells = [F.coalesce(cell(F.get("v", F.lit(k))), F.lit(0)) for k in chosen]
    names = [f"c{g}" for g in range(len(chosen))]
    a = classes.select(F.col("id").alias("ia"), F.col("v").alias("va"), F.col("c").alias("na"), F.size("v").alias("d"), *(c.alias(n) for c, n in zip(cells, names, strict=True)))
    b = classes.select(F.col("id").alias("ib"), F.col("v").alias("vb"), F.col("c").alias("nb"), F.size("v").alias("d"), *(c.alias(n) for c, n in zip(cells, names, strict=True)))
    for name in names:
        b = b.withColumn(name, F.explode(F.array(*(F.col(name) + step for step in (-1, 0, 1)))))

    def equal(x: str, y: str) -> Column:
        return F.expr(f"forall(zip_with({x}, {y}, (x, y) -> abs(x - y) <= {tol}D + 1e-5D * abs(y)), z -> z)")

    near = a.join(b, ["d", *names]).where("ia < ib").select("ia", "ib", "va", "vb", "na", "nb", equal("va", "vb").alias("ab"), equal("vb", "va").alias("ba")).where("ab OR ba")
    near = written(near, "near")
    within = classes.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("n"))
    both = near.where("ab AND ba").agg(F.sum(F.col("na") * F.col("nb")).cast("bigint").alias("n"))
    one = near.where("NOT (ab AND ba)").join(sound.select(F.col("k").alias("ka"), F.col("v").alias("va")), "va").join(sound.select(F.col("k").alias("kb"), F.col("v").alias("vb")), "vb")
    one = one.agg(F.count_if(F.when(F.col("ab"), F.col("ka") < F.col("kb")).otherwise(F.col("kb") < F.col("ka"))).alias("n"))
    hits = within.unionByName(both).unionByName(one).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_equal"))
    return hits.join(F.broadcast(total)).withColumn("rate", F.try_divide("n_equal", "n_total"))


def score_coverage(items: DataFrame, negatives: DataFrame, scores: DataFrame, item: str, negative: str) -> DataFrame:
    """One row: items with and without negatives scored, negatives in all, scored and missing."""
    known = scores.select(F.col("key").alias(negative), F.lit(True).alias("s")).distinct()
    per = items.select(item).join(negatives, item, "left").join(known, negative, "left").groupBy(item).agg(F.count(negative).alias("n"), F.count("s").alias("k"))
    return per.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_negatives"), F.sum("k").alias("n_scored"), (F.sum("n") - F.sum("k")).alias("n_missing"), F.count_if(F.col("k") < F.col("n")).alias("items_with_missing"))


def score_request_pack(missing: DataFrame, item: str, negative: str, key: str, k: int = 10) -> DataFrame:
    """The k missing negatives that affect most items, with a representative key."""
    return missing.groupBy(negative).agg(F.count_distinct(item).alias("n_items"), F.min(key).alias("example")).orderBy(F.desc("n_items"), negative).limit(k)


def control_gate(df: DataFrame, keys: Sequence[str], auc: str, nulls: Sequence[str], margin: float) -> DataFrame:
    """Worst null of each key, gate = worst null + margin (not held under 1), slack and verdict."""
    worst = F.max(F.greatest(*(F.coalesce(F.col(n), F.lit(0.0)) for n in nulls)))
    found = df.groupBy(*keys).agg(F.min(auc).alias("auc"), worst.alias("worst_null"))
    found = found.withColumn("gate", F.col("worst_null") + margin).withColumn("slack", F.col("auc") - F.col("gate"))
    return found.withColumn("verdict", F.when(F.col("slack") >= 0, "PASS").otherwise("FAIL"))


def outcome_verdict(status: Column, n_negatives: Column, n_scored: Column, auc: Column, slack: Column) -> Column:
    """Ordered outcome of a row: the first condition that holds."""
    return (
        F.when(status != "OK", F.concat(F.lit("SKIP:"), F.coalesce(status, F.lit("unknown"))))
        .when(n_negatives == 0, "SKIP:no_negatives")
        .when(n_scored == 0, "SKIP:no_scores")
        .when(auc.isNull(), "SKIP:no_auc")
        .when(slack >= 0, "PASS")
        .otherwise("FAIL")
    )


def iteration_audit(df: DataFrame, item: str, step: str, value: str, tol: float, min_items: int = 10, min_rate: float = 0.95) -> DataFrame:
    """One row: NONCONVERGED, TRIVIAL (values never change), INCONCLUSIVE (few items) or SUCCESS."""
    per = df.groupBy(item).agg(F.max_by(value, step).alias("last"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    row = per.agg(F.count("*").alias("n_items"), F.avg(F.when(F.col("last") <= tol, 1.0).otherwise(0.0)).alias("converged_rate"), F.coalesce(F.bool_and(F.col("hi") == F.col("lo")), F.lit(True)).alias("trivial"))
    verdict = F.when(F.coalesce(F.col("converged_rate"), F.lit(0.0)) < min_rate, "NONCONVERGED").when(F.col("trivial"), "TRIVIAL").when(F.col("n_items") < min_items, "INCONCLUSIVE").otherwise("SUCCESS")
    return row.withColumn("verdict", verdict)
