"""Sources, sinks and contracts over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.scalars import parse_number
from gaugeline.operators import contracts
from gaugeline.registry import query, table
from gaugeline.sources import files


def _folder(spark) -> str:
    return files.shared_folder(spark, "plans")


@query("A1_read_items_csv", "SELECT c_custkey::VARCHAR AS id, trim(c_name) AS smiles FROM customer")
def read_items_csv(spark, sf_dir):
    path = _folder(spark)
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("smiles"))
    files.write_result(items, path, "csv")
    return files.read_items_csv(spark, path)


@query("A2_require_columns", "SELECT o_orderkey, o_custkey FROM orders")
def require_columns(spark, sf_dir):
    return contracts.require_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]).select("o_orderkey", "o_custkey")


@query(
    "A3_read_scores_json",
    """SELECT event_id::VARCHAR AS item_id, false AS is_original, coalesce(value, 0.0) AS score, 1.0::DOUBLE AS weight FROM events
       UNION ALL SELECT NULL, true, 1.0::DOUBLE, 1.0::DOUBLE FROM (SELECT DISTINCT user_id FROM events)""",
    floats="score",
)
def read_scores_json(spark, sf_dir):
    """One score file per user, written and read back."""
    path = _folder(spark)
    score = F.struct(F.col("value").alias("score"))
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), score))).alias("decoys"))
    nested.select(F.lit("scores.v1").alias("schema_version"), "decoys").write.json(path)
    schema = "schema_version string, original struct<score: double, weight: double>, decoys map<string, struct<score: double, weight: double>>"
    return files.scores_long(spark.read.schema(schema).json(path), "scores.v1")


@query("A4_read_task_log", "SELECT event_id AS task_id, event_type AS mode, user_id AS chain FROM events")
def read_task_log(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("mode"), F.col("user_id").alias("chain")).write.json(path)
    return files.read_task_log(spark, path, "task_id long, mode string, chain long")


_TRUTH = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE (o_orderkey // 2 * 2)::VARCHAR END AS id, o_orderstatus AS label,
  CASE WHEN o_orderkey % 89 = 0 THEN ' ' ELSE o_orderpriority END AS source, CASE WHEN o_orderkey % 83 = 0 THEN 'v2' ELSE 'v1' END AS version FROM orders"""


def _truth(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 97 == 0, "").otherwise((F.floor(k / 2) * 2).cast("string")).alias("id"),
        F.col("o_orderstatus").alias("label"),
        F.when(k % 89 == 0, " ").otherwise(F.col("o_orderpriority")).alias("source"),
        F.when(k % 83 == 0, "v2").otherwise("v1").alias("version"),
        F.col("o_custkey").alias("item"),
        F.col("o_totalprice").alias("value"),
    )


@query(
    "A5_check_truth_contract",
    f"""WITH t AS ({_TRUTH})
    SELECT 'empty_id' AS rule, id AS key, count(*) AS n FROM t WHERE trim(id) = '' GROUP BY id
    UNION ALL SELECT 'bad_label', id, count(*) FROM t WHERE label NOT IN ('O', 'F') GROUP BY id
    UNION ALL SELECT 'empty_source', id, count(*) FROM t WHERE trim(source) = '' GROUP BY id
    UNION ALL SELECT 'duplicate_id', id, count(*) FROM t WHERE trim(id) <> '' GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'mixed_version', version, count(*) FROM t WHERE version <> (SELECT min(version) FROM t) GROUP BY version""",
)
def check_truth_contract(spark, sf_dir):
    return contracts.check_truth_contract(_truth(spark, sf_dir), "id", "label", "source", "version", ["O", "F"])


@query(
    "A6_check_grouped_truth",
    f"""WITH t AS ({_TRUTH.replace(" AS version FROM", " AS version, o_custkey::VARCHAR AS grp FROM")})
    SELECT 'empty_id' AS rule, id AS key, count(*) AS n FROM t WHERE trim(id) = '' GROUP BY id
    UNION ALL SELECT 'empty_item', id, count(*) FROM t WHERE trim(source) = '' GROUP BY id
    UNION ALL SELECT 'bad_number', id, count(*) FROM t WHERE try_cast(trim(source) AS DOUBLE) IS NULL GROUP BY id
    UNION ALL SELECT 'duplicate_id', id, count(*) FROM t WHERE trim(id) <> '' GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'small_group', grp, count(*) FROM t GROUP BY grp HAVING count(*) < 2""",
)
def check_grouped_truth(spark, sf_dir):
    return contracts.check_grouped_truth(_truth(spark, sf_dir), "id", "item", "source", "source")


@query("A7_canonicalise_truth", "SELECT l_orderkey, l_linenumber, l_extendedprice, 'shop' AS truth_source, 'v1' AS truth_version FROM lineitem")
def canonicalise_truth(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return contracts.canonicalise_truth(rows, "l_orderkey", "l_extendedprice", "l_linenumber", "shop", "v1")


@query("A8_parse_number", "SELECT event_id, coalesce(try_cast(trim(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' || value::VARCHAR ELSE event_id::VARCHAR END) AS DOUBLE), -1.0) AS x FROM events", floats="x")
def a8(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", parse_number(text, default=-1.0).alias("x"))


@query("A9_write_result", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_result(spark, sf_dir):
    path = _folder(spark)
    files.write_result(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.parquet(path)


@query("A10_write_item_documents", "SELECT c_custkey AS id, c_name AS name FROM customer")
def write_item_documents(spark, sf_dir):
    path = _folder(spark)
    files.write_item_documents(table(spark, sf_dir, "customer"), path, "c_custkey", ["c_comment", "c_address"])
    read = spark.read.schema("c_custkey long, document struct<c_name: string>").json(path)
    return read.select(F.col("c_custkey").alias("id"), F.col("document.c_name").alias("name"))


@query("A11_file_manifest")
def file_manifest(spark, sf_dir):
    """Manifest of the documents written as JSON."""
    path = _folder(spark)
    files.write_result(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "json")
    return files.file_manifest(spark, path, skip=["_SUCCESS"]).select("size", "sha256")


@query(
    "A12_content_checksum",
    f"""SELECT o_custkey, sha256(concat_ws('|', {", ".join(f"sum(('0x' || substr(h, {k}, 16))::UBIGINT::HUGEINT)::VARCHAR" for k in (1, 17, 33, 49))}, count(*)::VARCHAR)) AS checksum, count(*) AS n_rows
       FROM (SELECT o_custkey, sha256(o_orderkey::VARCHAR || '|' || o_orderstatus) AS h FROM orders) GROUP BY o_custkey""",
)
def content_checksum(spark, sf_dir):
    return contracts.content_checksum(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"])


@query("A13_read_optional", "SELECT r_regionkey, r_name FROM region")
def read_optional(spark, sf_dir):
    schema = "r_regionkey long, r_name string"
    there = files.read_optional(spark, f"{sf_dir}/region.parquet", spark.read.parquet(f"{sf_dir}/region.parquet").schema)
    absent = files.read_optional(spark, f"{sf_dir}/no_such_table.parquet", schema)
    return there.select("r_regionkey", "r_name").unionByName(absent)


@query(
    "A14_concat_tables",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, NULL::DOUBLE AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part",
    floats="size",
)
def concat_tables(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("size"))
    return contracts.concat_tables([a, b])
