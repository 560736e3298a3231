"""Registered queries of the library: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register a query, and the SQL that gives the same rows on the same tables.

    ``floats`` names columns that both sides round, since sums of doubles
    depend on the order of the rows.
    """
    columns = floats.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns}) if columns else df

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(({c})::DOUBLE, {digits}) + 0::DOUBLE AS {c}" for c in columns)
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if columns else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
