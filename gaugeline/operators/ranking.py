"""Grouped-rank accuracy, fits with groups left out, model choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.scalars import safe_corr
from gaugeline.operators import ordered
from gaugeline.operators.joins import within_group_pairs
from gaugeline.operators.ordered import SMALL, dealt, mean_rank, running
from gaugeline.operators.windows import average_rank
from gaugeline.sources.files import written


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(group, n, rho): rank correlation with mean ranks for ties; null if constant or under two rows.

    Rounded to 12 digits, so that its sign does not depend on the order of sums.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(*by, F.col(x).alias("x_"), F.col(y).alias("y_"))
    size = rows.groupBy(*by).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (size["most"] or 0) <= SMALL:
        rows = dealt(rows, by, size["all"])
        rows = rows.select(*by, mean_rank(by, "x_").alias("rx"), "y_").select(*by, "rx", mean_rank(by, "y_").alias("ry"))
    else:
        rows = average_rank(average_rank(rows, by, "x_", "rx"), by, "y_", "ry")
    varied = (F.count("*") >= 2) & (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(varied, F.round(safe_corr("rx", "ry"), 12)).alias("rho"))


#: Rows of a group up to which its pairs are listed.
FEW = 32


def pairwise_accuracy(df: DataFrame, group: str, key: str, pred: str, truth: str) -> DataFrame:
    """(group, n_correct, n_pairs) over pairs of different truth and key; a tie of predictions is wrong.

    Where no group has more than FEW rows its pairs are listed, else they are
    counted: in the task that holds the group (:func:`_held_metrics`), or beyond
    SMALL rows by shuffles, see :func:`_ordered_pairs`. Null keys and truths make no pairs, a
    null or NaN prediction none that is right; NaN is the greatest truth.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(truth).isNotNull())
    size = rows.groupBy(group).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (size["most"] or 0) > ordered.SMALL:
        return _counted_accuracy(rows, group, key, pred, truth)
    if (size["most"] or 0) > FEW:
        return _held_metrics(rows, [group], key, pred, truth, size["all"]).select(group, "n_correct", "n_pairs").where("n_pairs > 0")
    pairs = within_group_pairs(rows, group, key, [pred, truth]).where(F.col(f"{truth}_a") != F.col(f"{truth}_b"))
    right = F.signum(F.col(f"{pred}_a") - F.col(f"{pred}_b")) == F.signum(F.col(f"{truth}_a") - F.col(f"{truth}_b"))
    return pairs.groupBy(group).agg(F.count_if(right).alias("n_correct"), F.count("*").alias("n_pairs"))


def _counted_accuracy(df: DataFrame, group: str, key: str, pred: str, truth: str) -> DataFrame:
    """The same with rows times the logarithm of their number: all pairs in order, less those of rows with one key."""
    told = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(truth).alias("t"), F.when(~F.isnan(F.col(pred).cast("double")), F.col(pred)).alias("p"))
    twice = told.groupBy("g", "k").agg(F.count("*").alias("c"), F.collect_list(F.struct("t", "p")).alias("s")).where("c > 1")
    one, two = (twice.select("g", "k", F.posexplode("s").alias(f"i{n}", f"s{n}")) for n in "ab")
    same = one.join(two, ["g", "k"]).where("ia < ib AND sa.t <> sb.t")
    same = same.groupBy("g").agg(F.count_if(F.expr("sa.p <> sb.p AND (sa.p < sb.p) = (sa.t < sb.t)")).alias("r_"), F.count("*").alias("n_"))
    cells = written(told.groupBy("g", "t", "p").agg(F.count("*").alias("c")), "cells")
    ties = cells.groupBy("g", "t").agg(F.sum("c").alias("c"))
    square = F.col("c").cast("decimal(19,0)")
    pairs = ties.groupBy("g").agg(((F.sum("c").cast("decimal(19,0)") * F.sum("c").cast("decimal(19,0)") - F.sum(square * square)) / 2).cast("bigint").alias("n_pairs"))
    right = _ordered_pairs(cells.where("p IS NOT NULL"))
    out = pairs.join(right, "g", "left").join(same, "g", "left")
    less = {n: F.coalesce(n, F.lit(0)) - F.coalesce(m, F.lit(0)) for n, m in (("n_correct", "r_"), ("n_pairs", "n_"))}
    return out.select(F.col("g").alias(group), *(c.alias(n) for n, c in less.items())).where("n_pairs > 0")


def _levels(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(g, level, block, low, columns, c) of cells (g, t, columns, c): the halves of blocks in which all pairs of different t meet once.

    With truths numbered within a group, two of them differ first in one binary
    digit, so each pair belongs to one block of one level; low is 1 in the half
    of the smaller truths. Rows are cells times the logarithm of their number.
    """
    truths = cells.select("g", "t").distinct()
    placed = running(truths, ["g"], ["t"], {"i": F.lit(1)}, totals=True, sizes=truths)
    levels = F.explode(F.expr("sequence(0, cast(ceil(log2(greatest(i_all, 2))) AS int) - 1)")).alias("level")
    rows = cells.join(placed, ["g", "t"]).select("g", *columns, "c", F.col("i").cast("int").alias("i"), levels)
    return rows.groupBy("g", "level", F.expr("shiftright(i, level + 1)").alias("block"), F.expr("1 - shiftright(i, level) % 2").alias("low"), *columns).agg(F.sum("c").alias("c"))


def _ordered_pairs(cells: DataFrame) -> DataFrame:
    """(g, n_correct) of cells (g, t, p, c): pairs of rows of which one is greater in both t and p.

    In a block of :func:`_levels` a row of the upper half is right with as many
    of the lower half as lie before it in the order of p, which is a running sum
    over groups of any size.
    """
    rows = _levels(cells, ["p"])
    # At one p the upper half asks before the lower half is added.
    asked = running(rows, ["g", "level", "block"], ["p", "low"], {"n": F.when(F.col("low") == 1, F.col("c"))}, sizes=rows)
    return asked.where("low = 0").groupBy("g").agg(F.sum(F.col("c") * F.col("n")).alias("n_correct"))


def top1_hit(df: DataFrame, group: str, key: str, pred: str, truth: str) -> DataFrame:
    """(group, hit): whether the row of least prediction (least key on ties) has the least truth."""
    w = Window.partitionBy(group)
    rows = df.withColumn("best_", F.col(truth) == F.min(truth).over(w))
    return rows.groupBy(group).agg(F.min(F.struct(F.col(pred).alias("p"), F.col(key).alias("k"), F.col("best_").alias("b")))["b"].alias("hit"))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _since(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last change."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _places(part: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many rows of its part are smaller in x, and how many are equal, itself included."""
    at = np.lexsort((x, part))
    run = _changes(part[at], x[at])
    first = _since(run)
    smaller, equal = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    smaller[at] = first - _since(_changes(part[at]))
    equal[at] = np.bincount(np.cumsum(run) - 1)[np.cumsum(run) - 1]
    return smaller, equal


def _below(part: np.ndarray, p: np.ndarray, i: np.ndarray) -> np.ndarray:
    """For each row how many rows of its part are smaller in both p and i, whole numbers from 0 on.

    Two numbers differ first in one binary digit. Rows stay in the order of p
    within the blocks of equal leading digits, so at each digit a row of the
    upper half has the rows of the lower half before it, less those at its own
    p; rows times the number of digits.
    """
    place, out = np.arange(len(part)), np.zeros(len(part), np.int64)
    at = np.lexsort((p, part))
    part, p, i = part[at], p[at], i[at]
    for digit in reversed(range(int(i.max(initial=0)).bit_length())):
        new = _changes(part, i >> (digit + 1))
        start, low = _since(new), (i >> digit) & 1 == 0
        lows = np.cumsum(low) - low
        ahead = lows - lows[start]
        out[at] += np.where(low, 0, lows[_since(new | _changes(p))] - lows[start])
        half = np.add.reduceat(low, np.flatnonzero(new), dtype=np.int64)[np.cumsum(new) - 1]
        order = np.empty_like(place)
        order[start + np.where(low, ahead, half + place - start - ahead)] = place
        at, part, p, i = at[order], part[order], p[order], i[order]
    return out


def _group_counts(held: list):
    """Whole groups after each other as a batch with (x, y, right, less, hit) for (size, k, p, t, told).

    x, y: mean places of p and t among rows with both. less: rows of the group
    and of another key that are smaller in t, and right: in p too. hit: on the
    row of least p (then key) whether its t is the least.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = pa.Table.from_batches(held).combine_chunks()
    column = {c: rows.column(c).chunk(0) for c in rows.column_names}
    size, told = column["size"].to_numpy(), column["told"].to_numpy(zero_copy_only=False)
    starts, at = [], 0
    while at < len(size):
        starts.append(at)
        at += int(size[at])
    group = np.repeat(np.arange(len(starts)), size[starts])
    has_k, has_p, has_t = (column[c].is_valid().to_numpy(zero_copy_only=False) for c in "kpt")
    # Numbers in the order of Spark: nulls first, NaN last.
    k, p, t = (np.where(has, pc.rank(column[c], null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64), 0) for c, has in (("k", has_k), ("p", has_p), ("t", has_t)))
    both, paired = has_p & has_t, has_k & has_t
    x, y = np.full(len(size), np.nan), np.full(len(size), np.nan)
    for out, code in ((x, p), (y, t)):
        smaller, equal = _places(group[both], code[both])
        out[both] = smaller + (equal + 1) / 2
    right, less = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    less[paired] = _places(group[paired], t[paired])[0]
    right[told] = _below(group[told], p[told], less[told])
    by_key = np.lexsort((k, group))
    run = np.cumsum(_changes(group[by_key], k[by_key])) - 1
    if len(size) and run[-1] + 1 < len(size):
        same = np.empty_like(run)
        same[by_key] = run
        twice = paired & (np.bincount(run)[same] > 1)
        alike = np.zeros(len(size), np.int64)
        alike[twice] = _places(same[twice], t[twice])[0]
        less -= alike
        twice &= told
        right[twice] -= _below(same[twice], p[twice], alike[twice])
    least = np.minimum.reduceat(np.where(has_t, t, np.iinfo(np.int64).max), starts)
    best = np.where(has_t, 1 + (t == least[group]), 0)
    first = np.lexsort((best, k, p, group))[starts]
    hit = np.zeros(len(size), bool)
    hit[first] = best[first] == 2
    none = np.ones(len(size), bool)
    none[first] = best[first] == 0
    told_by = [rows.column(c).chunk(0) for c in rows.column_names[:-5]]
    found = [pa.array(x, mask=~both), pa.array(y, mask=~both), pa.array(right), pa.array(less), pa.array(hit, mask=none)]
    return pa.RecordBatch.from_arrays([*told_by, *found], [*rows.column_names[:-5], "x", "y", "right", "less", "hit"])


def _counted_groups(batches):
    """Batches of rows in the order of their groups through :func:`_group_counts`; each row tells the size of its group."""
    held, left = [], 0  # left: rows that the last group of ``held`` still lacks
    for batch in batches:
        size, at = batch.column(batch.schema.get_field_index("size")).to_numpy(), left
        while at < len(size):
            cut, at = at, at + int(size[at])
        if left < len(size):
            # The last group of the batch may go on; all before it are whole.
            if done := [b for b in [*held, batch.slice(0, cut)] if b.num_rows]:
                yield _group_counts(done)
            held = [batch.slice(cut)]
        elif batch.num_rows:
            held.append(batch)
        left = at - len(size)
    if held:
        yield _group_counts(held)


def _held_metrics(df: DataFrame, by: Sequence[str], key: str, pred: str, truth: str, total: int | None) -> DataFrame:
    """(group, n, rho, n_correct, n_pairs, hit) of groups of up to SMALL rows: one shuffle of the rows, in tasks of a bounded number of them."""
    rows = dealt(df.select(*by, F.col(key).alias("k"), F.col(pred).alias("p"), F.col(truth).alias("t")), by, total)
    told = F.col("k").isNotNull() & F.col("p").isNotNull() & F.col("t").isNotNull() & ~F.isnan(F.col("p").cast("double"))
    rows = rows.select(*by, F.count("*").over(Window.partitionBy(*by)).alias("size"), "k", "p", "t", told.alias("told")).sortWithinPartitions(*by)
    schema = T.StructType([*(df.schema[c] for c in by), *T.StructType.fromDDL("x double, y double, right long, less long, hit boolean").fields])
    varied = (F.count("x") >= 2) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    rho = F.when(varied, F.round(safe_corr("x", "y"), 12))
    return rows.mapInArrow(_counted_groups, schema).groupBy(*by).agg(F.count("x").alias("n"), rho.alias("rho"), F.sum("right").alias("n_correct"), F.sum("less").alias("n_pairs"), F.max("hit").alias("hit"))


def group_metrics(df: DataFrame, group: str, key: str, pred: str, truth: str) -> DataFrame:
    """(group, n, rho, n_correct, n_pairs, hit)."""
    size = df.groupBy(group).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if FEW < (size["most"] or 0) <= SMALL:
        told = F.col(group).isNotNull()
        out = _held_metrics(df, [group], key, pred, truth, size["all"]).where("n > 0")
        return out.select(group, "n", "rho", *(F.when(told, F.col(c)).otherwise(0).alias(c) for c in ("n_correct", "n_pairs")), F.when(told, F.col("hit")).alias("hit"))
    rho = spearman(df, [group], pred, truth)
    pairs = pairwise_accuracy(df, group, key, pred, truth)
    return rho.join(pairs, group, "left").join(top1_hit(df, group, key, pred, truth), group, "left").fillna(0, ["n_correct", "n_pairs"])


def rank_report(metrics: DataFrame, by: Sequence[str] = (), group: str | None = None, null_is_negative: bool = False) -> DataFrame:
    """Mean and median correlation, pair accuracy, top-1 rate and number of groups of negative correlation; ``group`` lists them."""
    negative = F.coalesce(F.col("rho") < 0, F.lit(null_is_negative))
    extra = [F.array_join(F.array_sort(F.collect_list(F.when(negative, F.col(group).cast("string")))), ",").alias("negative")] if group else []
    return metrics.groupBy(*by).agg(
        F.count("*").alias("n_groups"),
        F.avg("rho").alias("mean_rho"),
        F.median("rho").alias("median_rho"),
        F.try_divide(F.sum("n_correct").cast("double"), F.sum("n_pairs").cast("double")).alias("pair_accuracy"),
        F.avg(F.try_divide(F.col("n_correct").cast("double"), F.col("n_pairs").cast("double"))).alias("mean_group_accuracy"),
        F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("top1_rate"),
        F.count_if(negative).alias("n_negative"),
        *extra,
    )


def truth_spread(df: DataFrame, group: str, truth: str) -> DataFrame:
    return df.groupBy(group).agg((F.max(truth) - F.min(truth)).alias("spread"))


def kpi_gate(report: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """Add verdict and reason: the first measure under its limit, or none."""
    reason = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(float("-inf"))) < v, F.lit(c)) for c, v in least.items()), F.lit(""))
    return report.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason") == "", "PASS").otherwise("FAIL"))


def split_groups(df: DataFrame, group: str, n_train: int, seed: int) -> DataFrame:
    """(group, is_train): the first n_train groups in a digest order train."""
    turn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    groups = df.select(group).distinct()
    train = groups.orderBy(turn, group).limit(n_train).withColumn("is_train", F.lit(True))
    return groups.join(train, group, "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))


def logo_folds(df: DataFrame, group: str) -> DataFrame:
    """(fold, rows_test, rows_train) by subtraction from the totals; rows are not expanded."""
    per = df.groupBy(F.col(group).alias("fold")).agg(F.count("*").alias("rows_test"))
    total = per.agg(F.sum("rows_test").alias("t"))
    return per.join(F.broadcast(total)).select("fold", "rows_test", (F.col("t") - F.col("rows_test")).alias("rows_train"))


def fold_moments(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(fold, column, mean, std) of all groups but the fold's, by subtraction of sums; a deviation of 0 becomes 1.

    Values are taken about the overall mean first, so that subtraction keeps its digits.
    """
    rows = df.select(F.col(group).alias("fold"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("fold", "s.*").where("x IS NOT NULL")
    center = rows.groupBy("column").agg(F.avg("x").alias("c"))
    per = rows.join(F.broadcast(center), "column").groupBy("fold", "column", "c").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("c")).alias("s"), F.sum((F.col("x") - F.col("c")) ** 2).alias("q"))
    total = per.groupBy("column").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    out = per.join(F.broadcast(total), "column").select("fold", "column", "c", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q")).where("n > 0")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
    return out.select("fold", "column", (F.col("c") + F.col("s") / F.col("n")).alias("mean"), F.when(std > 1e-12, std).otherwise(1.0).alias("std"))


def standardise(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Columns less their training mean over their population deviation (0 counts as 1)."""
    stats = (df if train is None else train).agg(*(F.avg(c).alias(f"{c}_m_") for c in columns), *(F.stddev_pop(c).alias(f"{c}_s_") for c in columns))
    rows = df.join(F.broadcast(stats))
    z = {f"{c}_z": (F.col(c) - F.col(f"{c}_m_")) / F.when(F.col(f"{c}_s_") > 0, F.col(f"{c}_s_")).otherwise(1.0) for c in columns}
    return rows.withColumns(z).drop(*(f"{c}{e}" for c in columns for e in ("_m_", "_s_")))


def pair_training_table(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str]) -> DataFrame:
    """Signed feature differences of pairs with different truth, in both directions, with label and delta."""
    pairs = within_group_pairs(df, group, key, [truth, *features]).where(F.col(f"{truth}_a") != F.col(f"{truth}_b"))
    rows = pairs.select(group, f"{key}_a", f"{key}_b", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), F.col(f"{truth}_a"), F.col(f"{truth}_b"), *(F.col(f"{c}_{s}") for c in features for s in "ab"))
    delta = F.col("side") * (F.col(f"{truth}_a") - F.col(f"{truth}_b"))
    return rows.select(group, f"{key}_a", f"{key}_b", "side", delta.alias("delta"), (delta > 0).cast("int").alias("label"), *((F.col("side") * (F.col(f"{c}_a") - F.col(f"{c}_b"))).alias(f"d_{c}") for c in features))


def gram(df: DataFrame, by: Sequence[str], y: str, features: Sequence[str]) -> DataFrame:
    """(group, i, j, s): sums of products of the features, the target ``y`` and the constant ``1``; one shuffle of p**2 sums a task."""
    names = [*features, y, "1"]
    value = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = df.groupBy(*by).agg(*(F.sum(value[a] * value[b]).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    return sums.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(pairs)))).alias("entry_")).select(*by, "entry_.*")


def _solve(entries: Mapping[tuple[str, str], float], features: Sequence[str], y: str, lam: float, intercept: bool) -> dict[str, float]:
    def at(a: str, b: str) -> float:
        return entries.get((a, b), entries.get((b, a), 0.0)) or 0.0

    n = at("1", "1")
    mean = {c: (at(c, "1") / n if intercept and n else 0.0) for c in [*features, y]}
    a = np.array([[at(p, q) - n * mean[p] * mean[q] for q in features] for p in features])
    b = np.array([at(p, y) - n * mean[p] * mean[y] for p in features])
    scale = np.sqrt(np.maximum(np.diag(a) / max(n, 1), 0)) if intercept else np.ones(len(features))
    scale[scale <= 1e-12] = 1.0
    w = np.linalg.lstsq(a / np.outer(scale, scale) + lam * np.eye(len(features)), b / scale, rcond=None)[0] / scale
    out = dict(zip(features, map(float, w), strict=True))
    out["intercept"] = float(mean[y] - sum(out[c] * mean[c] for c in features)) if intercept else 0.0
    return out


def ridge_fit(df: DataFrame, y: str, features: Sequence[str], lam: float, intercept: bool = True) -> DataFrame:
    """(feature, weight): ridge weights on standardised features with a free intercept, solved from the p by p sums."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _solve({(r.i, r.j): r.s for r in pdf.itertuples()}, features, y, lam, intercept)
        return pd.DataFrame({"feature": list(w), "weight": list(w.values())})

    return gram(df, [], y, features).groupBy().applyInPandas(run, "feature string, weight double")


def logo_ridge(df: DataFrame, group: str, y: str, features: Sequence[str], lam: float, intercept: bool = True) -> DataFrame:
    """(fold, feature, weight): a ridge fit for each group from all other groups.

    Sums are taken once per group; a fold's are the totals less its own. Each
    fold is solved in a task of its own.
    """
    return _solved(gram(df, [group], y, features), group, dict(df.dtypes)[group], y, features, lam, intercept)


def _solved(per: DataFrame, group: str, fold_type: str, y: str, features: Sequence[str], lam: float, intercept: bool) -> DataFrame:
    """(fold, feature, weight) from the sums of each group, as :func:`gram` gives them."""
    import pandas as pd

    total = per.groupBy("i", "j").agg(F.sum("s").alias("t"))
    folds = per.join(F.broadcast(total), ["i", "j"]).select(F.col(group).alias("fold"), "i", "j", (F.col("t") - F.col("s")).alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _solve({(r.i, r.j): r.s for r in pdf.itertuples()}, features, y, lam, intercept)
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "feature": list(w), "weight": list(w.values())})

    return folds.groupBy("fold").applyInPandas(run, f"fold {fold_type}, feature string, weight double")


def predict(df: DataFrame, weights: DataFrame, features: Sequence[str], name: str = "pred") -> DataFrame:
    """Add the linear prediction from ``weights(feature, weight)``, which are one row for each feature."""
    wide = weights.groupBy().pivot("feature", [*features, "intercept"]).agg(F.first("weight"))
    wide = wide.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(f"w_{c}") for c in [*features, "intercept"]))
    out = F.col("w_intercept")
    for c in features:
        out = out + F.col(f"w_{c}") * F.col(c)
    return df.join(F.broadcast(wide)).withColumn(name, out).drop(*wide.columns)


def cross_validate(df: DataFrame, group: str, key: str, y: str, features: Sequence[str], lam: float) -> DataFrame:
    """Rows with pred, each from the fit that left its group out."""
    weights = logo_ridge(df, group, y, features, lam)
    wide = weights.groupBy("fold").pivot("feature", [*features, "intercept"]).agg(F.first("weight"))
    wide = wide.select(F.col("fold").alias(group), *(F.col(c).alias(f"w_{c}") for c in [*features, "intercept"]))
    pred = F.col("w_intercept")
    for c in features:
        pred = pred + F.col(f"w_{c}") * F.col(c)
    return df.join(wide, group).withColumn("pred", pred).drop(*(f"w_{c}" for c in [*features, "intercept"]))


#: Numbers of the weights of all folds that a round holds at the driver.
MAX_WEIGHTS = 1_000_000


def _logistic_folds(df: DataFrame, fold: Column, names: Sequence, label: str, features: Sequence[str], lam: float, max_iter: int, tol: float, count: str | None = None) -> np.ndarray:
    """Weights by Newton steps, a row for each of ``names``; a row of data counts for every fold but its own, ``count`` times.

    A round is one pass over the rows: each task adds up the gradient, the
    Hessian and the loss of all folds side by side, and one row for a fold and
    task is shuffled. A step that does not lower the loss is halved.
    """
    import pandas as pd

    p, place = len(features), {name: k for k, name in enumerate(names)}
    rows = df.select(fold.alias("f_"), F.col(label).cast("double").alias("y_"), (F.col(count).cast("double") if count else F.lit(1.0)).alias("c_"), *(F.col(c).cast("double") for c in features))
    schema = "f_ int, n double, loss double, g array<double>, h array<double>"
    weights, moves = np.zeros((len(names), p)), np.zeros((len(names), p))
    best = np.full(len(names), np.inf)
    for _ in range(max_iter):
        trial = weights + moves

        def run(batches, trial=trial):
            total = [np.zeros(len(trial)), np.zeros(len(trial)), np.zeros((len(trial), p)), np.zeros((len(trial), p, p))]
            for pdf in batches:
                x, y = pdf[list(features)].to_numpy(float), pdf["y_"].to_numpy(float)
                c = pdf["c_"].to_numpy(float)
                own = pdf["f_"].map(place).fillna(-1).to_numpy(int)
                for k, w in enumerate(trial):
                    use = own != k
                    z = x[use] @ w
                    q = 0.5 * (1 + np.tanh(z / 2))
                    total[0][k] += c[use].sum()
                    total[1][k] += (np.logaddexp(0, z) - y[use] * z) @ c[use]
                    total[2][k] += ((q - y[use]) * c[use]) @ x[use]
                    total[3][k] += (x[use] * (q * (1 - q) * c[use])[:, None]).T @ x[use]
            yield pd.DataFrame({"f_": range(len(trial)), "n": total[0], "loss": total[1], "g": list(total[2]), "h": list(total[3].reshape(len(trial), -1))})

        parts = rows.mapInPandas(run, schema)
        sums = parts.groupBy("f_").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *(F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(size))).alias(c) for c, size in (("g", p), ("h", p * p))))
        change = 0.0
        for r in sums.collect():
            k, n = r.f_, max(r.n, 1.0)
            loss = r.loss / n + lam / 2 * trial[k] @ trial[k]
            if loss > best[k] + 1e-12 * abs(best[k]):
                moves[k] /= 2
            else:
                weights[k], best[k] = trial[k], loss
                grad = np.array(r.g) / n + lam * trial[k]
                moves[k] = -np.linalg.lstsq(np.array(r.h).reshape(p, p) / n + lam * np.eye(p), grad, rcond=None)[0]
            change = max(change, float(np.abs(moves[k]).max(initial=0)))
        if change <= tol:
            break
    return weights


def pairwise_logistic_fit(df: DataFrame, label: str, features: Sequence[str], lam: float, max_iter: int = 50, tol: float = 1e-9) -> DataFrame:
    """(feature, weight): the least mean logistic loss + lam / 2 |w|**2 of feature differences, without intercept."""
    w = _logistic_folds(df, F.lit(None).cast("string"), [""], label, features, lam, max_iter, tol)[0]
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(features, w, strict=True)], "feature string, weight double")


def logo_logistic(df: DataFrame, group: str, label: str, features: Sequence[str], lam: float, max_iter: int = 50, tol: float = 1e-9, count: str | None = None) -> DataFrame:
    """(fold, feature, weight): the fit of :func:`pairwise_logistic_fit` for each group from all other groups, side by side.

    Work grows with rows times folds, as each fold has weights of its own; rows
    are not multiplied. The driver holds folds times features numbers, at most
    MAX_WEIGHTS; more are refused. Rows of a null group count for every fold.
    """
    names = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().limit(MAX_WEIGHTS // max(1, len(features)) + 1).collect()]
    if len(names) * len(features) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights in all folds")
    names.sort()
    w = _logistic_folds(df, F.col(group), names, label, features, lam, max_iter, tol, count)
    rows = [(name, c, float(v)) for name, fit in zip(names, w, strict=True) for c, v in zip(features, fit, strict=True)]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("fold", df.schema[group].dataType), T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType())]))


class Evaluation(NamedTuple):
    """Of one evaluation with groups left out: rows with pred, metrics of each fold, the report over folds, and (fold, feature, weight)."""

    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    weights: DataFrame


def _evaluated(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str], weights: DataFrame, intercept: bool) -> Evaluation:
    names = [*features, *(["intercept"] if intercept else [])]
    wide = weights.groupBy("fold").pivot("feature", names).agg(F.first("weight"))
    wide = wide.select(F.col("fold").alias(group), *(F.col(c).alias(f"w_{c}") for c in names))
    pred = F.col("w_intercept") if intercept else F.lit(0.0)
    for c in features:
        pred = pred + F.col(f"w_{c}") * F.col(c)
    rows = written(df.join(wide, group).withColumn("pred", pred).drop(*(f"w_{c}" for c in names)), "evaluated")
    metrics = written(group_metrics(rows, group, key, "pred", truth), "metrics")
    return Evaluation(rows, metrics, rank_report(metrics), weights)


def evaluate_ridge(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str], lam: float) -> Evaluation:
    """Ridge fits with each group left out: predictions, H1-H3 per fold, H4 overall and the weights."""
    return _evaluated(df, group, key, truth, features, written(logo_ridge(df, group, truth, features, lam), "weights"), True)


def _difference_counts(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str]) -> DataFrame:
    """(group, d_*, n_): the different feature differences, greater truth less smaller, with the pairs of different truth and key that have them.

    Pairs meet by the levels of :func:`_levels`, rows with equal features at
    once: in each block those of its upper half with those of its lower half.
    So features of few values cost far less than the pairs; features without
    equal values list each pair once. Upper rows are dealt out, as a block of
    the top level is as large as its group.
    """
    d = [f"d_{c}" for c in features]
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(truth).isNotNull())
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(truth).alias("t"), *(F.col(c).alias(n) for c, n in zip(features, d, strict=True)))
    cells = written(rows.groupBy("g", "t", *d).agg(F.count("*").alias("c")), "cells")
    half = _levels(cells, d)
    low = half.where("low = 1").select("g", "level", "block", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("deal"), F.col("c").alias("cl"), *(F.col(n).alias(f"{n}_l") for n in d))
    high = half.where("low = 0").withColumn("deal", F.pmod(F.xxhash64(*d), F.lit(8)).cast("int"))
    found = high.join(low, ["g", "level", "block", "deal"]).select("g", (F.col("c") * F.col("cl")).alias("n_"), *((F.col(n) - F.col(f"{n}_l")).alias(n) for n in d))
    twice = rows.groupBy("g", "k").agg(F.count("*").alias("c"), F.collect_list(F.struct("t", *d)).alias("s")).where("c > 1")
    one, two = (twice.select("g", "k", F.explode("s").alias(f"s{n}")) for n in "ab")
    same = one.join(two, ["g", "k"]).where("sa.t > sb.t").select("g", F.lit(-1).cast("bigint").alias("n_"), *((F.col(f"sa.{n}") - F.col(f"sb.{n}")).alias(n) for n in d))
    return found.unionByName(same).groupBy("g", *d).agg(F.sum("n_").alias("n_")).where("n_ > 0").withColumnRenamed("g", group)


def evaluate_pairwise(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str], lam: float) -> Evaluation:
    """Pairwise logistic fits with each group left out; a row's prediction is its score under the fit of the others."""
    pairs = written(_difference_counts(df, group, key, truth, features).withColumn("label", F.lit(1)), "pairs")
    fits = logo_logistic(pairs, group, "label", [f"d_{c}" for c in features], lam, count="n_")
    return _evaluated(df, group, key, truth, features, fits.withColumn("feature", F.substring("feature", 3, 10_000)), False)


def sweep_leaderboard(preds: DataFrame, config: str, group: str, key: str, pred: str, truth: str) -> DataFrame:
    """The report of each configuration, with ``best`` for the first of the lexicographically largest (mean_rho, pair_accuracy, top1_rate)."""
    size = preds.groupBy(config, group).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if FEW < (size["most"] or 0) <= SMALL:
        metrics = _held_metrics(preds, [group, config], key, pred, truth, size["all"]).where("n > 0")
    else:
        tagged = preds.withColumn("g_", F.struct(config, group))
        metrics = group_metrics(tagged, "g_", key, pred, truth).withColumn(config, F.col("g_")[config])
    report = rank_report(metrics, [config])
    turn = Window.orderBy(F.desc_nulls_last("mean_rho"), F.desc_nulls_last("pair_accuracy"), F.desc_nulls_last("top1_rate"), config)
    return report.withColumn("best", F.row_number().over(turn) == 1)


def nested_select(metrics: DataFrame, config: str, group: str) -> DataFrame:
    """(fold, chosen): per left-out group the configuration with fewest negative groups, then largest median, then first name.

    Counts without a group are totals less its own. The median without a value
    is that of the sorted list with the value's rank taken out, which needs
    only the middle three values. So rows are configurations times groups; they
    are written, as they are read four times.
    """
    w = Window.partitionBy(config)
    metrics = written(metrics.select(config, group, "rho"), "metrics")
    rows = metrics.select(config, F.col(group).alias("fold"), "rho", F.when(F.col("rho").isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last("rho"), group))).alias("r"))
    totals = rows.groupBy(config).agg(F.count_if(F.col("rho") < 0).alias("bad_"), F.count("rho").alias("n_"))
    middle = rows.join(totals, config).where(F.abs(F.col("r") - F.col("n_") / 2) <= 2)
    values = middle.groupBy(config).agg(F.map_from_entries(F.collect_list(F.struct("r", "rho"))).alias("at_"))
    rows = rows.join(totals, config).join(values, config, "left")
    left = F.col("n_") - F.when(F.col("r").isNull(), 0).otherwise(1)
    taken = F.coalesce(F.col("r"), F.col("n_") + 1)

    def value(place):
        return F.try_element_at("at_", (place + F.when(taken <= place, 1).otherwise(0)).cast("int"))

    low, high = F.floor((left + 1) / 2).cast("int"), (F.floor(left / 2) + 1).cast("int")
    med = F.when(left > 0, (value(low) + value(high)) / 2)
    bad = F.col("bad_") - F.when(F.col("rho") < 0, 1).otherwise(0)
    scored = rows.select("fold", config, bad.alias("bad"), (-F.coalesce(med, F.lit(-1e9))).alias("m"))
    return scored.groupBy("fold").agg(F.min(F.struct("bad", "m", config))[config].alias("chosen"))


def rescore_compare(df: DataFrame, group: str, truth: str, variants: Sequence[str]) -> DataFrame:
    """Rank report of alternative score columns, one row each."""
    rows = df.select(group, truth, F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).cast("double").alias("p")) for v in variants))).alias("s")).select(group, truth, "s.*")
    rho = spearman(rows, ["variant", group], "p", truth)
    return rho.groupBy("variant").agg(F.count("*").alias("n_groups"), F.avg("rho").alias("mean_rho"), F.median("rho").alias("median_rho"), F.count_if(F.col("rho") < 0).alias("n_negative"))


def calibration_gate(trials: DataFrame, key: str, checks: Sequence[tuple[str, str, float]], auc: str, others: Sequence[str], lam: float) -> DataFrame:
    """Per trial the first failing check (column, ``min`` or ``max``, limit) and score = auc - lam * sum of others; ``best`` marks the top passing one.

    Compared to 12 digits, and the score told to as many, so that a mean on its
    limit, equal trials, or a score that lies halfway between two rounded ones do
    not depend on the order of sums; of equal trials the first key is best.
    """
    told = {c: F.round(F.col(c).cast("double"), 12) for c, _, _ in checks}
    fails = [(F.coalesce(told[c] < v if kind == "min" else told[c] > v, F.lit(True)), c) for c, kind, v in checks]
    reason = F.coalesce(*(F.when(f, F.lit(c)) for f, c in fails), F.lit(""))
    score = F.col(auc)
    for o in others:
        score = score - F.lit(lam) * F.col(o)
    rows = trials.withColumns({"reason": reason, "score": F.round(score.cast("double"), 12)}).withColumn("status", F.when(F.col("reason") == "", "PASS").otherwise("FAIL"))
    top = rows.where("status = 'PASS'").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))["k"].alias("top"))
    return rows.join(F.broadcast(top)).withColumn("best", F.coalesce(F.col(key) == F.col("top"), F.lit(False))).drop("top")


def train_holdout_table(rows: DataFrame, setting: str, chosen: str, part: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key the columns of the chosen setting on training and on held-out rows, side by side."""
    one = rows.where(F.col(setting) == chosen)
    train, test = (one.where(F.col(part) == p).select(key, *(F.col(c).alias(f"{c}_{p}") for c in columns)) for p in ("train", "holdout"))
    return train.join(test, key, "full_outer")


def _pair_gram(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str]) -> DataFrame:
    """(group, i, j, s): the sums of products of :func:`pair_training_table` without its pairs.

    Over all pairs of n rows, both ways, (u_a - u_b)(v_a - v_b) adds up to
    2 (n sum(u v) - sum(u) sum(v)); pairs of one truth or one key are taken off
    by the same sums over their classes. Values are about their group's mean,
    so that subtraction keeps its digits.
    """
    names = {**{f"d_{c}": c for c in features}, "delta": truth}
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(truth).isNotNull())
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(truth).alias("t"), *(F.col(c).cast("double").alias(n) for n, c in names.items()))
    center = rows.groupBy("g").agg(*(F.avg(n).alias(f"{n}_m") for n in names))
    rows = rows.join(center, "g").select("g", "k", "t", *((F.col(n) - F.col(f"{n}_m")).alias(n) for n in names))
    pairs = [(a, b) for k, a in enumerate(names) for b in list(names)[k:]]
    parts = []
    for a, b in pairs:
        told = F.col(a).isNotNull() & F.col(b).isNotNull()
        parts.append(F.struct(*(F.sum(F.when(told, x)).alias(n) for n, x in (("n", F.lit(1.0)), ("u", F.col(a)), ("v", F.col(b)), ("w", F.col(a) * F.col(b))))))
    cells = written(rows.groupBy("g", "k", "t").agg(*(p.alias(f"s{k}") for k, p in enumerate(parts))), "cells")
    out = None
    for by, sign in ((["g"], 2.0), (["g", "t"], -2.0), (["g", "k"], -2.0), (["g", "k", "t"], 2.0)):
        sums = cells.groupBy(*by).agg(*(F.sum(f"s{k}.{n}").alias(f"{n}{k}") for k in range(len(pairs)) for n in "nuvw"))
        one = sums.groupBy("g").agg(*((F.lit(sign) * F.coalesce(F.sum(F.col(f"n{k}") * F.col(f"w{k}") - F.col(f"u{k}") * F.col(f"v{k}")), F.lit(0.0))).alias(f"s{k}") for k in range(len(pairs))))
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("g").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(pairs))))
    return out.select(F.col("g").alias(group), F.explode(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(pairs)))).alias("entry_")).select(group, "entry_.*")


def calibrate_scores(df: DataFrame, group: str, key: str, truth: str, features: Sequence[str], lam: float, raw: str) -> DataFrame:
    """Rank reports of a raw score and of one refitted by pairwise ridge with each group left out."""
    weights = _solved(_pair_gram(df, group, key, truth, features), group, dict(df.dtypes)[group], "delta", [f"d_{c}" for c in features], lam, False)
    wide = weights.groupBy("fold").pivot("feature", [f"d_{c}" for c in features]).agg(F.first("weight")).withColumnRenamed("fold", group)
    refit = sum((F.col(f"d_{c}") * F.col(c) for c in features), F.lit(0.0))
    rows = df.join(wide, group).withColumn("refit", refit)
    parts = [rank_report(group_metrics(rows, group, key, c, truth)).withColumn("score", F.lit(n)) for n, c in (("raw", raw), ("calibrated", "refit"))]
    return parts[0].unionByName(parts[1])
