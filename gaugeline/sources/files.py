"""Readers and writers: CSV, JSON, JSON lines, file manifests."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; a local session without it gets a temporary one.

    What is written there goes at the end of the running :func:`step_scope`, or
    else of the driver, also if the session was stopped before.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    (scopes[-1] if scopes else _LEFT).append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step of an iteration below the shared folder and read it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Handed out folders by scope, innermost last; those outside any scope go when the driver ends.
_SCOPES: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())
_LEFT: list = []


@contextmanager
def step_scope():
    """Delete the written steps of all operators called inside at its end.

    Operators return lazy results that still read such steps, so write the
    result inside the scope.
    """
    made: list = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for step in made:
            _delete(*step)


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _delete_left() -> None:
    """The JVM outlives a stopped session, and its file systems need no session."""
    for step in _LEFT:
        try:
            _delete(*step)
        except Exception:  # noqa: BLE001, PERF203  the JVM may be gone
            return


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_SCORE = "struct<score: double, weight: double>"


def read_items_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV with a header; every field is text without outer blanks."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns))


def read_scores_json(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(item_id, is_original, score, weight) of nested score files; another version fails.

    The original has a score of 1 and decoys one of 0 where none is given; the weight is then 1.
    """
    schema = f"schema_version string, original {_SCORE}, decoys map<string, {_SCORE}>"
    return scores_long(spark.read.schema(schema).option("multiLine", True).json(path), version)


def scores_long(raw: DataFrame, version: str) -> DataFrame:
    """Long rows of nested scores ``(schema_version, original, decoys)``."""
    sound = F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.lit("unknown score version")).cast("boolean"))
    raw = raw.where(sound)
    one = F.lit(1.0)
    own = raw.select(F.lit(None).cast("string").alias("item_id"), F.lit(True).alias("is_original"), F.coalesce("original.score", one).alias("score"), F.coalesce("original.weight", one).alias("weight"))
    rest = raw.select(F.explode("decoys").alias("item_id", "x"))
    return own.unionByName(rest.select("item_id", F.lit(False).alias("is_original"), F.coalesce("x.score", F.lit(0.0)).alias("score"), F.coalesce("x.weight", one).alias("weight")))


def read_task_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tasks from JSON lines."""
    return spark.read.schema(schema).json(path)


def read_submissions(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file of a folder."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one with the schema if the path does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per table, as Parquet, CSV with a header, or JSON lines.

    An overwriting table is written beside the old one, under a hidden name, and
    takes its place when it is whole; a write that fails leaves the old table.
    """
    writer = df.write.mode(mode)
    writer = (writer.option("header", True) if fmt == "csv" else writer).format(fmt)
    if mode == "overwrite":
        _replaced(df.sparkSession, path, writer.save)
    else:
        writer.save(path)


def _replaced(spark: SparkSession, path: str, save: Callable[[str], None]) -> None:
    """Save into a hidden folder beside ``path`` and put that in its place by renaming."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent, _, name = path.rstrip("/").rpartition("/")
    staged, old = (f"{parent}/.{name}.{part}-{uuid.uuid4().hex}" for part in ("new", "old"))
    try:
        save(staged)
    except BaseException:
        _delete(jvm, conf, staged)
        raise
    to, new, was = (jvm.org.apache.hadoop.fs.Path(x) for x in (path.rstrip("/"), staged, old))
    system = to.getFileSystem(conf)
    kept = system.exists(to)
    if kept and not system.rename(to, was) or not system.rename(new, to):
        raise OSError(f"{path} could not be replaced by {staged}")
    if kept:
        system.delete(was, True)


def write_item_documents(df: DataFrame, path: str, key: str, drop: Sequence[str] = (), full: bool = True) -> None:
    """A nested JSON document per item without the bulky columns; nothing if not ``full``."""
    if full:
        kept = [c for c in df.columns if c not in drop and c != key]
        write_result(df.select(key, F.struct(*kept).alias("document")), path, "json")


def _stream_digests(batches):
    """SHA-256 of files, read a few megabytes at a time."""
    import hashlib
    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow.fs import FileSystem

    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            scheme, _, rest = path.partition(":")
            system, at = FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")
            found = hashlib.sha256()
            with system.open_input_stream(at) as stream:
                while part := stream.read(8 << 20):
                    found.update(part)
            digests.append(found.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], names=["path", "length", "sha256"])


def file_manifest(spark: SparkSession, folder: str, skip: Sequence[str] = (), large: int = 256 << 20) -> DataFrame:
    """(path below the folder, size, sha256) of every file, once each and sorted.

    Spark hands over a file of up to ``large`` bytes as one value. Larger ones,
    of any size, are dealt out file by file and read in chunks by the workers,
    which need to reach the folder by its own address; their contents are never
    a value. Spark reads no empty files, so those come from its listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    small = files.where(F.col("length") <= large).select("path", "length", F.sha2("content", 256).alias("sha256"))
    big = files.where(F.col("length") > large).select("path", "length").distinct()
    big = big.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_stream_digests, "path string, length long, sha256 string")
    below = F.element_at(F.split(F.col("path"), root + "/", 2), -1)
    listed = [(re.sub(r"^(\w+):/+", r"\1:/", unquote(x)),) for x in files.inputFiles()]
    full = small.unionByName(big).withColumn("path", F.regexp_replace("path", r"^(\w+):/+", "$1:/"))
    empty = spark.createDataFrame(listed, "path string").join(files.select(F.regexp_replace("path", r"^(\w+):/+", "$1:/").alias("path")), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("length"), F.sha2(F.lit(""), 256).alias("sha256"))
    found = full.unionByName(empty).select(below.alias("path"), F.col("length").alias("size"), "sha256").distinct()
    return found.where(~F.col("path").isin(*skip)).orderBy("path") if skip else found.orderBy("path")
