"""Order over a whole table or within groups without bringing either into one task.

Rows are dealt into ranges of (group, order) and written with the number of
their range; sums or ends of the ranges carry what lies before. Ranges follow
each other, so at most two groups of a range go on in another one, and what is
carried has at most two rows for each range, however many groups there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.sources.files import written


def ranged(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``part_``, the number of the range of ``order`` that they lie in; a written table.

    Rows that are equal in ``order`` lie in one range, so sum those up before.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "ranged")


def before(parts: DataFrame, totals: dict[str, str]) -> DataFrame:
    """(part_, {name}): of each range the sum of ``totals`` (name -> column) over the ranges before it."""
    sums = parts.groupBy("part_").agg(*(F.sum(c).alias(n) for n, c in totals.items()))
    w = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    return sums.select("part_", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in totals))


def numbered(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``r_``, their place from 1 on in the order of the whole table, and ``n_``, the number of rows."""
    rows = ranged(df, order, ranges)
    starts = before(rows.withColumn("one_", F.lit(1)), {"start_": "one_"})
    total = rows.agg(F.count("*").alias("n_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return rows.withColumn("i_", within).join(F.broadcast(starts), "part_").join(F.broadcast(total)).withColumn("r_", F.col("start_") + F.col("i_")).drop("part_", "i_", "start_")


#: Rows of a group up to which it is put in order by one task.
SMALL = 1_000_000


def all_small(rows: DataFrame, by: Sequence[str]) -> bool:
    """Whether no group of ``rows``, or the whole without keys, has more than SMALL rows; one pass over the keys, combined before the shuffle."""
    return (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= SMALL


#: Rows that a task of :func:`dealt` has, on average.
TASK = 250_000


def dealt(df: DataFrame, by: Sequence[str], rows: int | None) -> DataFrame:
    """The rows dealt out by ``by`` to tasks of about TASK rows, so that a task's memory does not grow with the table."""
    return df.repartition(max(1, -(-(rows or 0) // TASK)), *by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Both sides joined on ``keys``, of which nulls are equal; the keys of the left and the other columns of both."""
    named = right.select(*(F.col(k).alias(f"{k}_j_") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_j_"))
    return left.join(F.broadcast(named) if broadcast else named, same, how).drop(*(f"{k}_j_" for k in keys))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column] = {}, maxima: Mapping[str, str | Column] = {}, totals: bool = False, ranges: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The rows with, for each name, the sum or maximum of a column over the rows before in the order of their group.

    With ``totals`` also {name}_all, over the whole group. A sum before the first
    row is 0, a maximum null. A group of any size is split over the ranges: two
    windows of a range's rows, and the parts of those groups that lie in several
    ranges, at most two rows for a range, which are broadcast. A null key is a
    group. Rows that are equal in ``by`` and ``order`` are in one task and stand
    in any order. If no group of ``sizes``, the rows that ``df`` was made from,
    has more than SMALL rows, windows over whole groups give the same with one
    shuffle.
    """
    by, names = list(by), [*sums, *maxima]
    how = {n: F.sum for n in sums} | {n: F.max for n in maxima}
    given = {f"{n}_x_": F.col(c) if isinstance(c, str) else c for n, c in {**sums, **maxima}.items()}
    if sizes is not None and ranges is None and all_small(sizes, by):
        whole = Window.partitionBy(*by)
        w = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        before = {n: F.coalesce(F.sum(f"{n}_x_").over(w), F.lit(0)) if n in sums else F.max(f"{n}_x_").over(w) for n in names}
        after = {f"{n}_all": how[n](f"{n}_x_").over(whole) for n in names} if totals else {}
        return df.withColumns(given).withColumns(before | after).drop(*given)
    rows = ranged(df.withColumns(given), [*by, *order], ranges)
    pieces = rows.groupBy(*by, "part_").agg(*(how[n](f"{n}_x_").alias(n) for n in names))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*by, "part_", F.count("*").over(group).alias("n_"), *(how[n](n).over(ahead).alias(f"{n}_b_") for n in names), *(how[n](n).over(group).alias(f"{n}_t_") for n in names))
    carried = carried.where("n_ > 1").drop("n_")
    part = Window.partitionBy("part_", *by)
    within = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{n}_w_": how[n](f"{n}_x_").over(within) for n in names} | ({f"{n}_a_": how[n](f"{n}_x_").over(part) for n in names} if totals else {}))
    rows = null_safe_join(rows, carried, ["part_", *by], "left", broadcast=True)

    def both(n: str) -> Column:
        if n in maxima:
            return F.greatest(f"{n}_b_", f"{n}_w_")
        return F.coalesce(f"{n}_b_", F.lit(0)) + F.coalesce(f"{n}_w_", F.lit(0))

    out = {n: both(n) for n in names} | ({f"{n}_all": F.coalesce(f"{n}_t_", f"{n}_a_") for n in names} if totals else {})
    return rows.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def mean_rank(by: Sequence[str], x: str) -> Column:
    """Place from 1 on within a group by ``x``, ties with their mean place, as a window over the whole group."""
    w = Window.partitionBy(*by).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(0, 0)) - 1) / F.lit(2.0)


def ranked(df: DataFrame, by: Sequence[str], x: str, name: str = "r") -> DataFrame:
    """The rows with their place from 1 on within the group by ``x``; ties share their mean place, nulls come first.

    With groups of up to SMALL rows this is a window. Else equal values are one
    row with a count before they are put in order, and the places are joined
    back by group and value.
    """
    by = list(by)
    if all_small(df, by):
        return df.withColumn(name, mean_rank(by, x))
    blocks = df.groupBy(*by, x).agg(F.count("*").alias("c_"))
    placed = running(blocks, by, [x], {"p_": "c_"})
    placed = placed.select(*by, x, (F.col("p_") + (F.col("c_") + 1) / F.lit(2.0)).alias(name))
    return null_safe_join(df, placed, [*by, x])
