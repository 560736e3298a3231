"""Ranks, selections and ordered sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugeline.operators.ordered import ranked, running


def average_rank(df: DataFrame, by: Sequence[str], x: str, name: str = "r") -> DataFrame:
    """The rows with their 1-based rank within a group, however large; ties share their mean rank."""
    return ranked(df, by, x, name)


def top_k(df: DataFrame, k: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """The first k rows in an order that ends in an id, overall or per group."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r_") <= k).drop("r_")


def arg_best(df: DataFrame, by: Sequence[str], x: str, key: str, largest: bool = False) -> DataFrame:
    """Key of the least (or largest) value; the first key on ties."""
    value = -F.col(x) if largest else F.col(x)
    best = F.min(F.when(F.col(x).isNotNull(), F.struct(value.alias("x"), F.col(key).alias("k"))))
    return df.groupBy(*by).agg(best["k"].alias("best"))


def min_center(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column less its least value in the group."""
    w = Window.partitionBy(*by)
    return df.withColumns({f"{c}_centered": F.col(c) - F.min(c).over(w) for c in columns})


def placed(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str | None = None) -> DataFrame:
    """The rows of sequences with ``i_``, their place from 0 on, ``n_``, the length, and with ``x`` its mean as ``mean_``.

    A sequence of any length is put in order by ranges. Rows that have their
    place already are returned as they are.
    """
    if "i_" in df.columns:
        return df
    sums = {"i_": F.lit(1)} | ({"s_": F.col(x).cast("double"), "c_": F.when(F.col(x).isNotNull(), 1)} if x else {})
    rows = running(df, by, order, sums, totals=True, sizes=df)
    mean = {"mean_": F.try_divide("s__all", "c__all")} if x else {}
    return rows.withColumns({"n_": F.col("i__all"), **mean}).select(*df.columns, "i_", "n_", *mean)


def cumulative_unique(df: DataFrame, by: str, order: Sequence[str], key: str, bins: int) -> DataFrame:
    """(group, bin, n_unique): distinct keys seen up to each of ``bins`` equal parts of a sequence."""
    rows = placed(df, [by], order).select(by, F.col(key).alias("k"), "i_", F.col("n_").alias("n"))
    first = rows.groupBy(by, "k", "n").agg((F.min("i_") + 1).alias("i"))
    counts = first.groupBy(by, F.ceil(F.col("i") * bins / F.col("n")).cast("int").alias("bin")).agg(F.count("*").alias("fresh"))
    grid = df.select(by).distinct().select(by, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    full = grid.join(counts, [by, "bin"], "left")
    return full.select(by, "bin", F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy(by).orderBy("bin")).alias("n_unique"))


def split_half(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add half: 1 for the first n // 2 rows of a sequence, 2 for the rest."""
    return placed(df, by, order).withColumn("half", F.when(F.col("i_") < F.floor(F.col("n_") / 2), 1).otherwise(2)).select(*df.columns, "half")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 1) -> DataFrame:
    """The newest k records of a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).drop("r_")


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first record of a key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def lag1_autocorr(df: DataFrame, by: str, order: Sequence[str], x: str) -> DataFrame:
    """Mean, population variance and lag-1 autocorrelation, held between -1 and 1; 0 without variance."""
    sums = _lag_sums(df, by, order, x, 1)
    per = df.groupBy(by).agg(F.avg(x).alias("mean"), F.var_pop(x).alias("var"))
    one = F.sum(F.when(F.col("lag") == 1, F.col("s")))
    rho = sums.groupBy(F.col(by).alias("by_")).agg(F.sum("n").alias("n"), F.try_divide(one, F.sum(F.when(F.col("lag") == 0, F.col("s")))).alias("r"))
    out = per.join(rho, F.col(by).eqNullSafe(F.col("by_")))
    return out.select(by, "n", "mean", "var", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)))).alias("rho1"))


#: Rows of a block, unless there are more lags; lags up to which shifted products are cheaper than transforms.
BLOCK, SHIFTS = 1 << 16, 48


def _block_sums(keys: pa.Array, off: np.ndarray, d: np.ndarray, block: int, max_lag: int, schema: pa.Schema) -> pa.RecordBatch:
    """(key, lag, s, n) of whole blocks: sums of products ``lag`` apart, whose first row is the block's own."""
    start = np.flatnonzero(off == 0)
    size = np.diff(np.append(start, len(off)))
    own = np.where(off < block, d, 0.0)
    sums = np.zeros((len(start), max_lag + 1))
    sums[:, 0] = np.add.reduceat(own * own, start)
    large = size > SHIFTS if max_lag > SHIFTS else np.zeros(len(size), bool)
    for k in range(1, min(max_lag, int(size[~large].max(initial=0)) - 1) + 1):
        near = np.zeros(len(off))
        near[:-k] = np.where(off[k:] - off[:-k] == k, own[:-k] * d[k:], 0.0)
        sums[:, k] = np.add.reduceat(near, start)
    for b in np.flatnonzero(large):
        lo, n = start[b], int(size[b])
        width = 1 << int(n + max_lag).bit_length()
        x, y = np.fft.rfft(own[lo : lo + n], width), np.fft.rfft(d[lo : lo + n], width)
        sums[b, 1:] = np.fft.irfft(np.conj(x) * y, width)[1 : max_lag + 1]
    told = np.minimum(size - 1, max_lag) + 1
    row = np.repeat(np.arange(len(start)), told)
    lag = np.arange(len(row)) - np.repeat(np.cumsum(told) - told, told)
    n = np.where(lag == 0, np.add.reduceat((off < block).astype(np.int64), start)[row], 0)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(start[row])), pa.array(lag, pa.int32()), pa.array(sums[row, lag]), pa.array(n)], schema=schema)


def _lag_sums(df: DataFrame, by: str, order: Sequence[str], x: str, max_lag: int) -> DataFrame:
    """(group, lag, s, n) for lags from 0 on, parts to be added up: products of mean-centred values, and rows at lag 0.

    A sequence is cut into blocks, each with a halo of the next ``max_lag`` rows;
    within a block products are summed by shifts, or by Fourier transform for
    many lags. A null value counts as the mean.
    """
    block = max(BLOCK, max_lag)
    rows = placed(df, [by], order, x).select(by, "i_", F.coalesce(F.col(x).cast("double") - F.col("mean_"), F.lit(0.0)).alias("d"))
    b, o = F.floor(F.col("i_") / block), F.col("i_") % block
    at = F.struct(b.alias("block"), o.alias("off"))
    halo = F.struct((b - 1).alias("block"), (o + block).alias("off"))
    rows = rows.select(by, "d", F.explode(F.when((b > 0) & (o < max_lag), F.array(at, halo)).otherwise(F.array(at))).alias("a")).select(by, "d", "a.block", "a.off")
    rows = rows.repartition(by, "block").sortWithinPartitions(by, "block", "off").select(by, "off", "d")
    kind = df.schema[by].dataType
    out = T.StructType([T.StructField(by, kind), T.StructField("lag", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            off = batch.column("off").to_numpy()
            last = np.flatnonzero(off == 0)
            if len(last) == 0 or (len(held) == 1 and last[-1] == 0):
                continue
            cut = int(last[-1])
            held[-1] = batch.slice(0, cut)
            yield from done(held)
            held = [batch.slice(cut)]
        yield from done(held)

    def done(held):
        whole = pa.Table.from_batches(held) if held else None
        if whole is not None and whole.num_rows:
            keys = whole.column(0).combine_chunks()
            yield _block_sums(keys, whole.column("off").to_numpy(), whole.column("d").to_numpy(), block, max_lag, schema)

    return rows.mapInArrow(run, out)


def autocorrelation(df: DataFrame, by: str, order: Sequence[str], x: str, max_lag: int) -> DataFrame:
    """(group, n, lag, rho) for lags 1 to max_lag within the sequence, mean-centred; none without variance.

    See :func:`_lag_sums`; a sequence of any length is worked on in blocks.
    """
    sums = _lag_sums(df, by, order, x, max_lag).groupBy(by, "lag").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = sums.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("lag") == 0, F.col("s"))).alias("v"), F.collect_list(F.struct("lag", "s")).alias("lags"))
    rows = whole.where("v > 0").select(by, "n", "v", F.explode("lags").alias("l")).where("l.lag > 0")
    return rows.select(by, "n", "l.lag", (F.col("l.s") / F.col("v")).alias("rho"))


def worst_groups(df: DataFrame, n: int, metric: str, key: str, fill: float = -1e9) -> DataFrame:
    """The n groups of lowest metric, ties by key; null and NaN count as ``fill``."""
    value = F.coalesce(F.when(~F.isnan(metric), F.col(metric)), F.lit(fill))
    return df.withColumn("value", value).orderBy("value", key).limit(n)


def order_check(df: DataFrame, setting: str, role: str, x: str, roles: Sequence[str], penalty: float = 0.7) -> DataFrame:
    """Per setting the role means in order: gaps, whether all are positive, score = least gap - penalty * largest deviation."""
    wide = df.groupBy(setting).pivot(role, list(roles)).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    gaps = [F.col(f"{a}_mean") - F.col(f"{b}_mean") for a, b in zip(roles, roles[1:], strict=False)]
    least = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    out = wide.select(setting, *(g.alias(f"gap{k + 1}") for k, g in enumerate(gaps)), F.coalesce(least > 0, F.lit(False)).alias("ordered"), (least - penalty * F.greatest(*(F.col(f"{r}_std") for r in roles))).alias("score"))
    return out.orderBy(F.desc_nulls_last("score"), setting)


def feasible_block(df: DataFrame, x: str, y: str, passed: str) -> DataFrame:
    """One row: whether some 2 by 2 block of neighbouring grid points passes, and the number of such blocks."""
    ok = df.where(F.col(passed)).select(F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    corners = ok.select(F.explode(F.array(*(F.struct((F.col("x") - i).alias("x"), (F.col("y") - j).alias("y")) for i in (0, 1) for j in (0, 1)))).alias("c")).select("c.*")
    blocks = corners.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 4")
    return blocks.agg(F.count("*").alias("n_blocks")).withColumn("feasible", F.col("n_blocks") > 0)
