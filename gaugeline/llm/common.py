"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gaugeline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Scratch roots to delete when the running scope ends, innermost last; those outside any scope go when the driver ends, also after its session.
_SCOPES: ContextVar[tuple[list, ...]] = ContextVar("scopes", default=())
_LEFT: list[Scratch] = []


@contextmanager
def scratch_scope():
    """Delete the scratch tables of all operators called inside at its end.

    Operators return lazy results that still read such tables, so write the
    result inside the scope.
    """
    made: list[Scratch] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for scratch in made:
            scratch.drop()


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings (with _ for a dot) that hold for a while."""
    keys = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Written tables of one run in the shared folder; each cuts the lineage.

    A lost executor costs only the tasks of the running job, because every
    earlier step is read back from files. Row groups are small, so a task's
    writer holds little; shuffle files of a table go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        # The JVM outlives a stopped session, and its file systems need no session.
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        scopes = _SCOPES.get()
        (scopes[-1] if scopes else _LEFT).append(self)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        with _settings(self.spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables that no later step reads; without labels, all."""
        for label in labels or ("",):
            path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}" if label else self.root)
            path.getFileSystem(self.conf).delete(path, True)


@atexit.register
def _delete_left() -> None:
    for scratch in _LEFT:
        try:
            scratch.drop()
        except Exception:  # noqa: BLE001, PERF203  the JVM may be gone
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Detach an aggregate from its hash layout.

    A join on top then shuffles both sides itself, which is what adaptive
    execution needs to split a hot key on the other side.
    """
    return df.repartition(partitions(df.sparkSession))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
