"""Projections, predicates and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import contracts, stats
from gaugeline.registry import query, table


def _b(name: str, source: str, sql: str, floats: str = ""):
    """Register a query that selects from one table."""

    def add(columns):
        @query(name, sql, floats)
        def run(spark, sf_dir):
            return table(spark, sf_dir, source).select(*columns())

        return columns

    return add


@query("B1_normalise_columns", "SELECT p_partkey AS id, p_size AS size, p_retailprice AS price FROM part", "price")
def normalise_columns(spark, sf_dir):
    return contracts.normalise_columns(table(spark, sf_dir, "part"), {"p_partkey": "id", "p_size": "size", "p_retailprice": "price", "absent": "x"}).select("id", "size", "price")


@_b(
    "B2_classify_rules",
    "part",
    "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'large' WHEN p_retailprice > 960 AND p_brand LIKE 'Brand#1%' THEN 'dear' WHEN p_size < 10 THEN 'small' ELSE 'other' END AS class FROM part",
)
def classify():
    rules = [(F.col("p_size") >= 40, "large"), ((F.col("p_retailprice") > 960) & F.col("p_brand").like("Brand#1%"), "dear"), (F.col("p_size") < 10, "small")]
    return "p_partkey", S.classify_rules(rules, "other").alias("class")


@_b(
    "B3_hardness_bin",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN 'unknown' WHEN l_quantity / 50 < 0.5 THEN 'easy' WHEN l_quantity / 50 < 0.7 THEN 'medium' ELSE 'hard' END AS bin FROM lineitem",
)
def hardness():
    return "l_orderkey", "l_linenumber", S.hardness_bin(F.when(F.col("l_quantity") < 50, F.col("l_quantity") / 50)).alias("bin")


@_b("B4_size_bin", "documents", "SELECT doc_id, CASE WHEN n_chars <= 80 THEN '<=80' WHEN n_chars <= 200 THEN '81-200' WHEN n_chars <= 500 THEN '201-500' ELSE '>500' END AS bin FROM documents")
def size_bin():
    return "doc_id", S.size_bin(F.col("n_chars")).alias("bin")


@query("B5_flag_ranges", "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS mid, p_brand IN ('Brand#11', 'Brand#23') AS listed, abs(p_retailprice - 1000) <= 50 AS near FROM part")
def flags(spark, sf_dir):
    specs = {"mid": ("p_size", "between", 10, 20), "listed": ("p_brand", "in", ["Brand#11", "Brand#23"]), "near": ("p_retailprice", "near", 1000, 50)}
    return contracts.flag_ranges(table(spark, sf_dir, "part"), specs).select("p_partkey", *specs)


@query("B6_filter_regime", "SELECT event_id, value FROM events WHERE value BETWEEN 20 AND 60", "value")
def filter_regime(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("value").between(20, 60)).select("event_id", "value").orderBy("value", "event_id")


@_b("B7_safe_ratio", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN l_extendedprice / nullif(l_discount, 0) END AS ratio FROM lineitem", "ratio")
def ratio():
    return "l_orderkey", "l_linenumber", S.safe_ratio(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity") > 5).alias("ratio")


@_b("B8_hash_bucket_label", "orders", "SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 5 THEN 'PASS' ELSE 'FAIL' END AS label FROM orders")
def bucket():
    return "o_orderkey", S.hash_bucket_label(F.col("o_orderkey").cast("string")).alias("label")


@_b("B9_hash_score", "orders", "SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS score FROM orders", "score")
def score():
    return "o_orderkey", S.hash_score(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("score")


@_b("B10_row_seed", "orders", None)
def seed():
    return "o_orderkey", S.row_seed(42, F.col("o_orderkey").cast("string")).alias("seed")


@_b("B11_task_seed", "lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey + 10000 * l_linenumber + 1000000 * l_suppkey + 101 * l_partkey AS seed FROM lineitem")
def task_seed():
    return "l_orderkey", "l_linenumber", S.task_seed(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")).alias("seed")


@_b("B12_clamp01", "events", "SELECT event_id, greatest(least((value - 20) / 50, 1), 0) AS x FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, NULL FROM events WHERE value IS NULL", "x")
def clamp():
    return "event_id", S.clamp01((F.col("value") - 20) / 50).alias("x")


@_b("B13_finite", "events", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM events", "x")
def finite():
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return "event_id", S.finite(raw).alias("x")


_GRAPH = "'edges=' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || ',' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR || ';types=' || l_linenumber::VARCHAR || ',0'"


def _graph_text():
    k = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]
    return F.concat(F.lit("edges="), k[0], F.lit("-"), k[1], F.lit(","), k[1], F.lit("-"), k[2], F.lit(";types="), k[2], F.lit(",0"))


@query(
    "B14_parse_graph_id",
    """SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey)::INTEGER AS u, greatest(l_partkey, l_suppkey)::INTEGER AS v, l_linenumber::INTEGER AS type FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, least(l_suppkey, l_linenumber)::INTEGER, greatest(l_suppkey, l_linenumber)::INTEGER, l_linenumber::INTEGER FROM lineitem""",
)
def parse_graph(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(S.parse_edges(_graph_text())).alias("e"), F.get(S.parse_types(_graph_text()), F.lit(0)).alias("type"))
    return rows.select("l_orderkey", "l_linenumber", "e.u", "e.v", "type")


@_b(
    "B15_edge_set_hash",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, sha256(array_to_string(list_sort([least(l_partkey, l_suppkey)::VARCHAR || '-' || greatest(l_partkey, l_suppkey)::VARCHAR,
       least(l_suppkey, l_linenumber)::VARCHAR || '-' || greatest(l_suppkey, l_linenumber)::VARCHAR]), ';')) AS h FROM lineitem""",
)
def edge_hash():
    return "l_orderkey", "l_linenumber", S.edge_set_hash(S.parse_edges(_graph_text())).alias("h")


@_b("B16_log_ratio", "lineitem", "SELECT l_orderkey, l_linenumber, ln((l_tax + 1e-6) / (l_discount + 1e-6)) AS r FROM lineitem", "r")
def log_ratio():
    return "l_orderkey", "l_linenumber", S.log_ratio(F.col("l_tax"), F.col("l_discount"), 1e-6).alias("r")


@query("B17_linear_residuals", "SELECT p_brand, sqrt(avg(d * d)) AS rmse, max(abs(d)) AS max_abs FROM (SELECT p_brand, p_retailprice - (3.0 * p_size + 900) AS d FROM part) GROUP BY p_brand", "rmse max_abs")
def residuals(spark, sf_dir):
    return stats.linear_residuals(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size", 3.0, 900.0)


@query(
    "B18_penalty_scan",
    """SELECT beta, corr(l_quantity * (1 + beta * l_discount), l_extendedprice) AS corr, avg(CASE WHEN l_tax > 0.04 THEN l_quantity * (1 + beta * l_discount) END) AS mean_in,
       avg(CASE WHEN NOT l_tax > 0.04 THEN l_quantity * (1 + beta * l_discount) END) AS mean_out FROM lineitem, (SELECT unnest([0.0, 0.5, 2.0])::DOUBLE AS beta) GROUP BY beta""",
    "corr mean_in mean_out",
)
def penalty(spark, sf_dir):
    return stats.penalty_scan(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", F.col("l_tax") > 0.04, [0.0, 0.5, 2.0])


@_b("B19_normalised_size", "documents", "SELECT doc_id, CASE WHEN n_chars > 1 THEN doc_id / (n_chars * log2(1 + n_chars)) END AS s FROM documents", "s")
def size():
    return "doc_id", S.normalised_size(F.col("doc_id"), F.col("n_chars")).alias("s")
