"""Exact duplicates through an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, partitions, spread

#: The directory has at most 2**MAX_DEPTH rows of two numbers each, which is what is broadcast.
MAX_DEPTH = 20


def directory(entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(cell, depth, bucket): the extendible-hash directory of ``entries(key)``.

    A cell is the value of the first ``max_depth`` bits of a key. The directory
    starts with one bucket and doubles as long as a bucket holds more than
    ``capacity`` distinct keys; a bucket's depth is how often it was split. All
    depths are weighed at once, since halving a bucket never raises its load.
    A bucket that is overfull at the last depth stays so and its owner chains.
    At most 2**max_depth rows, whatever the input.
    """
    cells = entries.select("key").distinct().groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    loads = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("load"))
    fits = F.min(F.when((F.col("load") <= capacity) | (F.col("depth") == max_depth), F.col("depth")))
    found = levels.join(spread(loads), ["depth", "prefix"]).groupBy("cell").agg(fits.alias("depth"))
    return found.withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)"))


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = 4096, max_depth: int | None = None, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Write the index of ``docs(doc_id, text)``; returns (entries, index), both on shared files.

    ``entries`` has a row per document: doc_id, row (a number of its own),
    text_sha256, and its slot, which is bucket, key (64-bit hash) and chain.
    ``index`` has a row per slot, that is, per distinct text: keep_id, keep_row
    and group_size.

    The directory's depth follows the number of documents, with two splits to
    spare, up to 2**20 cells. Rows go to the owner of (bucket, key), which
    compares their bytes and chains the different texts of a key; copies meet in
    the map tasks first, so a hot text is one row per map task there. A document
    finds its place in the chain of its key by comparing bytes; where an owner
    met one text only, the place is 0 and no chain is looked up. The owners of
    the slots then reckon which document stays. The digest takes no part in
    this. Fewer ``key_bits`` make collisions, for tests.
    """
    key = F.xxhash64("text") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits), 64 - key_bits)
    base = docs.withColumn("key", key)
    keys = scratch.keep(base.select("key"), "keys")
    depth = max_depth or min(MAX_DEPTH, max(1, ceil(log2(max(1.0, keys.count() / capacity))) + 2))
    cells = scratch.keep(directory(keys, capacity, depth), "directory")
    scratch.drop("keys")
    owned = base.withColumn("cell", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(cells.select("cell", "bucket")), "cell").drop("cell")
    chains = owned.groupBy("bucket", "key").agg(F.collect_set("text").alias("texts")).where(F.size("texts") > 1)
    chains = scratch.keep(chains.select("bucket", "key", F.array_sort("texts").alias("texts")), "chains")
    place = F.coalesce(F.array_position("texts", F.col("text")) - 1, F.lit(0)).cast("int")
    entries = owned.join(chains, ["bucket", "key"], "left")
    entries = entries.select("doc_id", F.monotonically_increasing_id().alias("row"), "bucket", "key", place.alias("chain"), F.sha2("text", 256).alias("text_sha256"))
    entries = scratch.keep(entries, "entries")
    top = F.max(F.struct("doc_id", (-F.col("row")).alias("row"))).alias("top")
    slots = entries.groupBy("bucket", "key", "chain").agg(top, F.count("*").alias("group_size"))
    index = slots.select("bucket", "key", "chain", F.col("top.doc_id").alias("keep_id"), (-F.col("top.row")).alias("keep_row"), "group_size")
    return entries, scratch.keep(index.repartitionByRange(partitions(docs.sparkSession), "bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of documents with identical bytes the one with the largest id stays. A null
    text counts as empty, and all empty texts are equal. Null ids sort under
    all others: keep_id is null only if every id of the group is. Of repeated
    rows with the same id and text one stays. Extra columns are ignored. An
    empty table gives no rows. See :func:`build_index` for the other parameters.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    entries, index = build_index(base, Scratch(docs.sparkSession, "exact"), **index)
    found = entries.join(spread(index), ["bucket", "key", "chain"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
