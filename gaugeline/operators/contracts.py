"""Contracts of input tables, canonical forms and digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The DataFrame itself, or an error that names the missing columns. Nothing is read."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def normalise_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename those of the columns that are present."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def _empty(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))) == ""


def _violations(df: DataFrame, rule: str, where: Column, key: str) -> DataFrame:
    return df.where(where).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "key", "n")


def check_truth_contract(df: DataFrame, key: str, label: str, source: str, version: str, domain: Sequence[str]) -> DataFrame:
    """(rule, key, n) for each breach: empty_id, duplicate_id, bad_label, empty_source, mixed_version.

    A version other than the smallest one is mixed. An empty result means that the table is sound.
    """
    found = [
        _violations(df, "empty_id", _empty(key), key),
        _violations(df, "bad_label", ~F.coalesce(F.col(label).isin(*domain), F.lit(False)), key),
        _violations(df, "empty_source", _empty(source), key),
        df.where(~_empty(key)).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), "key", "n"),
    ]
    versions = df.groupBy(F.col(version).cast("string").alias("key")).agg(F.count("*").alias("n"))
    first = versions.agg(F.min("key").alias("first"))
    found.append(versions.join(F.broadcast(first)).where("key <> first OR key IS NULL").select(F.lit("mixed_version").alias("rule"), "key", "n"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def check_grouped_truth(df: DataFrame, key: str, group: str, item: str, value: str) -> DataFrame:
    """(rule, key, n): empty_id, empty_group, empty_item, duplicate_id, bad_number, small_group (under two rows)."""
    out = _violations(df, "empty_id", _empty(key), key)
    out = out.unionByName(_violations(df, "empty_group", _empty(group), key)).unionByName(_violations(df, "empty_item", _empty(item), key))
    out = out.unionByName(_violations(df, "bad_number", F.trim(F.col(value).cast("string")).try_cast("double").isNull(), key))
    many = df.where(~_empty(key)).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    small = df.where(~_empty(group)).groupBy(F.col(group).cast("string").alias("key")).agg(F.count("*").alias("n"))
    out = out.unionByName(many.where("n > 1").select(F.lit("duplicate_id").alias("rule"), "key", "n"))
    return out.unionByName(small.where("n < 2").select(F.lit("small_group").alias("rule"), "key", "n"))


def canonicalise_truth(df: DataFrame, group: str, value: str, key: str, source: str, version: str) -> DataFrame:
    """Add truth_source and truth_version, and sort by group, value and key."""
    return df.withColumns({"truth_source": F.lit(source), "truth_version": F.lit(version)}).orderBy(group, value, key)


def content_checksum(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Checksum of each group's rows, whatever their order, and their number.

    The SHA-256 of each row is added up as four numbers of 64 bits, so a group
    of any size is four sums in the map tasks; the checksum is that of the sums.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    rows = df.select(*by, row.alias("row_"))
    lanes = [F.sum(F.conv(F.substring("row_", k, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for k in (1, 17, 33, 49)]
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("|", *lanes, F.count("*").cast("string")), 256).alias("checksum"), F.count("*").alias("n_rows"))


def concat_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def flag_ranges(df: DataFrame, specs: Mapping[str, tuple]) -> DataFrame:
    """Add a flag for each name: ``(column, "between", low, high)``, ``(column, "in", values)`` or ``(column, "near", center, tol)``, ends included."""
    kinds = {
        "between": lambda x, low, high: x.between(low, high),
        "in": lambda x, values: x.isin(*values),
        "near": lambda x, center, tol: F.abs(x - center) <= tol,
    }
    return df.withColumns({name: kinds[kind](F.col(column), *args) for name, (column, kind, *args) in specs.items()})
