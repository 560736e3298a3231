"""Label permutation nulls of the weighted AUC, with the real scores, ties and weights.

With W the weight of a group, W+ that of its positives and R the weight below an
item plus half of that at its score (its own included), the AUC of any labelling
is (sum of w R over positives - W+**2 / 2) / (W+ (W - W+)), since two positives
share one credit between them. R does not depend on the labels. So a labelling
is told by how many positives each cell (score, weight) has, and nothing is
sorted for a draw: the positives of a group are dealt out to blocks of cells,
and by each block to its cells, by hypergeometric draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.scalars import finite
from gaugeline.operators.ordered import null_safe_join, running
from gaugeline.sources.files import written

#: Cells of a block, blocks of a block of blocks, and so on.
FAN = 1024
#: Items up to which hypergeometric draws are exact; from here on the normal law with their mean and variance is rounded.
EXACT = 10**9
#: Blocks that a task draws for and returns at once.
SLICE = 256


def placed_cells(df: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None) -> DataFrame:
    """(group, w, c, r, k, n, m, total): cells of equal score and weight with their number of items and R.

    ``k`` is the cell's place in its group by (score, weight); n, m and total are
    the group's items, positives and weight. Groups of any size are split.
    """
    by = list(by)
    s = finite(F.col(score))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(s.isNotNull() & F.col(label).isNotNull() & w.isNotNull()).select(*by, s.alias("s"), w.alias("w"), (F.col(label) == 1).cast("long").alias("y"))
    cells = rows.groupBy(*by, "s", "w").agg(F.count("*").alias("c"), F.sum("y").alias("y"))
    if not weight:
        out = running(cells, by, ["s"], {"b": "c", "k": F.lit(1), "m": "y"}, totals=True, sizes=rows)
        return out.select(*by, "w", "c", (F.col("b") + F.col("c") / 2).alias("r"), "k", F.col("b_all").alias("n"), F.col("m_all").alias("m"), F.col("b_all").cast("double").alias("total"))
    cells = running(cells, by, ["s", "w"], {"k": F.lit(1), "n": "c", "m": "y"}, totals=True, sizes=rows)
    ties = running(cells.groupBy(*by, "s").agg(F.sum(F.col("w") * F.col("c")).alias("t")), by, ["s"], {"b": "t"}, totals=True, sizes=rows)
    both = null_safe_join(cells, ties, [*by, "s"])
    return both.select(*by, "w", "c", (F.col("b") + F.col("t") / 2).alias("r"), "k", F.col("n_all").alias("n"), F.col("m_all").alias("m"), F.col("b_all").alias("total"))


def deal(rng: np.random.Generator, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A row for each of ``m``: how many of m items, drawn without replacement, fall on each of ``sizes``."""
    total = int(sizes.sum())
    if total < EXACT:
        return np.array([rng.multivariate_hypergeometric(sizes, k, method="marginals") for k in m.tolist()], np.int64).reshape(len(m), len(sizes))
    out, left, rest = np.zeros((len(m), len(sizes)), np.int64), m.astype(np.int64).copy(), total
    for j, here in enumerate(sizes.tolist()):
        p = here / rest
        spread = np.sqrt(left * p * (1 - p) * (rest - left) / max(rest - 1, 1))
        drawn = np.rint(left * p + spread * rng.standard_normal(len(m))).astype(np.int64)
        out[:, j] = np.clip(drawn, np.maximum(0, left - (rest - here)), np.minimum(here, left))
        left, rest = left - out[:, j], rest - here
    return out


def _generator(seed: int, group: str, level: int, place: int) -> np.random.Generator:
    return np.random.default_rng([seed % 2**64, *(int(x) % 2**64 for x in group.split(":")), level, place])


def _drawn(cells: DataFrame, by: Sequence[str], reps: int, seed: int) -> DataFrame:
    """(group, rep, total, s, p): sum of w R and of w over the positives of each draw.

    Blocks of FAN cells, and of FAN blocks, take their share of the positives
    from the block they belong to, by a generator of the seed, group, level and
    place, so the draws do not depend on partitions.
    """
    by = list(by)
    base = cells.select(*by, F.concat_ws(":", F.xxhash64(*by), F.xxhash64(F.lit(1), *by)).alias("g_"), F.col("k").alias("at"), "c", "w", "r", "m", "total")
    height, most = 1, int(base.agg(F.max("at")).first()[0] or 0)
    while FAN**height <= most:
        height += 1
    levels = [base.groupBy("g_", F.floor(F.col("at") / FAN).alias("at")).agg(F.sum("c").alias("c"))]
    for _ in range(height - 1):
        levels.append(levels[-1].groupBy("g_", F.floor(F.col("at") / FAN).alias("at")).agg(F.sum("c").alias("c")))
    tops = base.groupBy("g_").agg(F.first("m").alias("m"))
    shares = tops.select("g_", F.lit(0).cast("long").alias("at"), F.array_repeat(F.col("m"), reps).alias("drawn"))
    schema = "g_ string, at long, drawn array<long>"

    def split(level: int):
        def run(batches):
            for pdf in batches:
                for g, at, drawn, places, c in zip(pdf["g_"], pdf["at"], pdf["drawn"], pdf["places"], pdf["c"], strict=True):
                    dealt = deal(_generator(seed, g, level, at), np.asarray(c, np.int64), np.asarray(drawn))
                    yield pd.DataFrame({"g_": g, "at": places, "drawn": list(dealt.T)})

        return run

    for level in range(height - 1, 0, -1):
        kids = levels[level - 1].groupBy("g_", F.floor(F.col("at") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "c"))).alias("kids"))
        held = shares.join(kids.withColumnRenamed("up", "at"), ["g_", "at"]).select("g_", "at", "drawn", F.col("kids.at").alias("places"), F.col("kids.c").alias("c"))
        shares = written(held.mapInPandas(split(level), schema), "shares")
    leaves = base.groupBy("g_", *by, "total", F.floor(F.col("at") / FAN).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "c", "w", "r"))).alias("cells")).join(shares, ["g_", "at"])
    leaves = leaves.select(*by, "total", "g_", "at", "drawn", *(F.col(f"cells.{x}").alias(x) for x in "cwr"))
    numbers = T.ArrayType(T.DoubleType())
    out = T.StructType([*(T.StructField(k, cells.schema[k].dataType) for k in by), T.StructField("total", T.DoubleType()), T.StructField("s", numbers), T.StructField("p", numbers)])

    def sums(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                found = []
                for g, at, drawn, c, w, r in zip(*(some.column(some.schema.get_field_index(n)).to_pandas() for n in ("g_", "at", "drawn", "c", "w", "r")), strict=True):
                    dealt = deal(_generator(seed, g, 0, at), np.asarray(c, np.int64), np.asarray(drawn))
                    found.append((dealt @ (w * r), dealt @ w))
                kept = [some.column(some.schema.get_field_index(n)) for n in (*by, "total")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in (0, 1))], names=[*by, "total", "s", "p"])

    parts = leaves.mapInArrow(sums, out).select(*by, "total", F.posexplode(F.arrays_zip("s", "p")).alias("rep", "x"))
    return parts.groupBy(*by, "total", "rep").agg(F.sum("x.s").alias("s"), F.sum("x.p").alias("p"))


def _auc(s: Column, p: Column, total: Column) -> Column:
    return F.try_divide(s - p * p / 2, p * (total - p))


def _ranked(aucs: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """Mean and least AUC whose share of the labellings (auc, c) up to it is q or more."""
    values = aucs.where("auc IS NOT NULL").groupBy(*by, F.round("auc", 12).alias("auc")).agg(F.sum("c").alias("c"))
    rows = running(values, by, ["auc"], {"b": "c"}, totals=True)
    place = F.greatest(F.lit(1), F.ceil(F.col("b_all") * q - 1e-9))
    here = (F.col("b") < place) & (place <= F.col("b") + F.col("c"))
    return rows.groupBy(*by).agg(F.max("b_all").alias("n_draws"), (F.sum(F.col("auc") * F.col("c")) / F.sum("c")).alias("null_mean"), F.max(F.when(here, F.col("auc"))).alias("null_q"))


def label_null(df: DataFrame, by: Sequence[str], reps: int, q: float, seed: int, score: str = "score", label: str = "label", weight: str | None = "weight", limit: int = 10) -> DataFrame:
    """(group, n_pos, n_neg, null_method, n_draws, null_mean, null_q) of the AUC under permuted labels.

    Items keep their scores and weights. With one positive or one negative every
    item takes its place in turn (``single``); groups of up to ``limit`` items
    have all labellings (``enumeration``); of both the quantile is the least AUC
    whose share up to it is q or more. Other groups have ``reps`` draws
    (``draws``), and the AUC of nearest rank. A group without a positive or a
    negative has the method none. Rows with a null label, weight or non-finite
    score are left out; a null key is a group. AUCs are rounded to 12 digits,
    so equal ones meet whatever the order of their sums.
    """
    by = list(by)
    cells = written(placed_cells(df, by, score, label, weight), "cells")
    n, m = F.col("n"), F.col("m")
    kind = F.when((m <= 0) | (m >= n), "none").when((m == 1) | (m == n - 1), "single").when(n <= limit, "enumeration").otherwise("draws")
    cells = cells.withColumn("null_method", kind)
    groups = cells.groupBy(*by).agg(F.max("m").alias("n_pos"), F.max(n - m).alias("n_neg"), F.max("null_method").alias("null_method"))
    of = {name: cells.where(F.col("null_method") == name) for name in ("single", "enumeration", "draws")}
    one = F.try_divide(F.col("r") - F.col("w") / 2, F.col("total") - F.col("w"))
    single = of["single"].select(*by, F.when(m == 1, one).otherwise(1 - one).alias("auc"), "c")
    items = F.flatten(F.collect_list(F.expr("array_repeat(named_struct('s', w * r, 'w', w), cast(c AS int))")))
    small = of["enumeration"].groupBy(*by, "n", "m", "total").agg(items.alias("x"))
    small = small.withColumn("mask", F.explode(F.expr("sequence(0, shiftleft(1, cast(n AS int)) - 1)"))).where(F.bit_count("mask") == m)
    taken = {f: F.expr(f"aggregate(sequence(0, cast(n AS int) - 1), 0D, (a, i) -> a + (shiftright(mask, i) & 1) * x[i].{f})") for f in "sw"}
    small = small.select(*by, _auc(taken["s"], taken["w"], F.col("total")).alias("auc"), F.lit(1).cast("long").alias("c"))
    exact = _ranked(single.unionByName(small), by, q)
    drawn = _drawn(of["draws"], by, reps, seed).select(*by, _auc(F.col("s"), F.col("p"), F.col("total")).alias("auc")).where("auc IS NOT NULL")
    place = F.greatest(F.lit(1), F.bround(F.size("a") * F.lit(q), 0).cast("int"))
    drawn = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(F.round("auc", 12))).alias("a"), F.avg("auc").alias("null_mean"))
    drawn = drawn.select(*by, F.size("a").cast("long").alias("n_draws"), "null_mean", F.element_at("a", place).alias("null_q"))
    found = exact.unionByName(drawn)
    return null_safe_join(groups, found, by, "left").select(*by, "n_pos", "n_neg", "null_method", "n_draws", "null_mean", "null_q")
