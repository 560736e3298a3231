"""Joins over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.scalars import set_similarity
from gaugeline.operators import joins as J
from gaugeline.operators.stats import group_stats, to_distribution
from gaugeline.registry import query, table


@query(
    "C1_enrich_left",
    """SELECT s_suppkey, s_nationkey AS nation, n_name, r_name, coalesce(bonus, s_acctbal) AS bonus FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_custkey, c_acctbal AS bonus FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = s_suppkey""",
    "bonus",
)
def enrich(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    bonus = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("bonus"))
    return J.enrich_left(base, [(nation, ["nation"], "_n"), (region, ["region"], "_r"), (bonus, ["s_suppkey"], "_b")], {"bonus": "s_acctbal"}).drop("s_acctbal", "region")


@query("C2_join_reference", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def reference(spark, sf_dir):
    ref = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.join_reference(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ref, ["o_custkey"]).drop("o_custkey")


@query(
    "C3_compare_cohorts",
    """WITH a AS (SELECT o_custkey, avg(o_totalprice) AS x FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1), b AS (SELECT o_custkey, avg(o_totalprice) AS x FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
       SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.x AS o_totalprice_mean_old, b.x AS o_totalprice_mean_new, b.x - a.x AS o_totalprice_mean_delta FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""",
    "o_totalprice_mean_old o_totalprice_mean_new o_totalprice_mean_delta",
)
def cohorts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    cut = F.lit("1995-06-01").cast("timestamp")
    old, new = (group_stats(rows.where(c), ["o_custkey"], ["o_totalprice"]) for c in (F.col("o_orderdate") < cut, F.col("o_orderdate") >= cut))
    return J.compare_cohorts(old, new, "o_custkey", ["o_totalprice_mean"])


@query("C4_with_truth", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_truth FROM documents")
def truth(spark, sf_dir):
    return J.with_truth(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("C5_pending_items", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, sf_dir):
    return J.pending_items(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("C6_missing_scores", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def missing(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p_partkey"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("score"))
    return J.missing_scores(table(spark, sf_dir, "part").select("p_partkey"), scores, "p_partkey")


@query("C7_replace_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_acctbal < 0", "c_acctbal")
def replace(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return J.replace_rows(base, base.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


_POINTS = [2.0, 8.0, 20.0, 28.0, 50.0]


@query(
    "C8_nearest_join",
    "SELECT p_partkey, p AS nearest, p_size - p AS distance FROM (SELECT p_partkey, p_size, p, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_size - p), p) AS r FROM part, (SELECT unnest([2.0, 8.0, 20.0, 28.0, 50.0])::DOUBLE AS p)) WHERE r = 1",
    "nearest distance",
)
def nearest(spark, sf_dir):
    return J.nearest_join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", _POINTS).select("p_partkey", "nearest", "distance")


@query(
    "C8_nearest_join_large",
    """WITH p AS (SELECT DISTINCT c_acctbal * 50 AS p FROM customer), l AS (SELECT o_orderkey, o_totalprice, p AS lo FROM orders ASOF LEFT JOIN p ON o_totalprice >= p), h AS (SELECT o_orderkey, p AS hi FROM orders ASOF LEFT JOIN p ON o_totalprice <= p),
       n AS (SELECT *, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR o_totalprice - lo <= hi - o_totalprice THEN lo ELSE hi END AS nearest FROM l JOIN h USING (o_orderkey)) SELECT o_orderkey, nearest, o_totalprice - nearest AS distance FROM n""",
    "nearest distance",
)
def nearest_large(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select((F.col("c_acctbal") * 50).alias("p"))
    return J.nearest_join_large(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", points, "p").select("o_orderkey", "nearest", "distance")


@query("C9_within_group_pairs", "SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_a, b.l_linenumber AS l_linenumber_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def pairs(spark, sf_dir):
    return J.within_group_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", [])


@query("C10_tolerance_join", "SELECT a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 0.5")
def tolerance(spark, sf_dir):
    return J.tolerance_join(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 0.5).select("c_custkey_a", "c_custkey_b")


@query(
    "C10_tolerance_join_relative",
    "SELECT a.c_custkey AS c_custkey_a, b.c_custkey AS c_custkey_b FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= greatest(1.0, abs(a.c_acctbal), abs(b.c_acctbal)) * 1e-4::DOUBLE",
)
def tolerance_relative(spark, sf_dir):
    return J.tolerance_join(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", 1e-4, relative=True).select("c_custkey_a", "c_custkey_b")


@query(
    "C11_positive_negative_pairs",
    """SELECT o_orderkey, l_partkey, o_totalprice AS pos_score, x AS neg_score, 1.0::DOUBLE AS weight, x IS NOT NULL AS scored FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       LEFT JOIN (SELECT p_partkey, p_retailprice * 100 AS x FROM part WHERE p_size > 10) ON p_partkey = l_partkey""",
    "pos_score neg_score",
)
def pos_neg(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("pos_score"))
    negatives = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    scores = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("key"), (F.col("p_retailprice") * 100).alias("score"), F.lit(None).cast("double").alias("weight"))
    return J.positive_negative_pairs(items, negatives, scores, "o_orderkey", "l_partkey")


@query(
    "C12_lookup_or_report",
    "SELECT string_agg(k, ',' ORDER BY k) AS missing, sum(n)::BIGINT AS n_rows FROM (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#5%' GROUP BY 1)",
)
def lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    params = parts.select("p_brand").distinct().where("p_brand NOT LIKE 'Brand#5%'").withColumn("chi", F.length("p_brand"))
    return J.missing_keys(J.lookup_or_report(parts, params, "p_brand", "chi"), "p_brand")


_WORDS = "array_remove(array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0)), '')"


@query(
    "C13_set_similarity",
    """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM benchmark)
       SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
    "similarity",
)
def similarity(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_WORDS).alias("s"))
    both = w.select(F.col("item_id").alias("a"), F.col("s").alias("sa")).join(w.select(F.col("item_id").alias("b"), F.col("s").alias("sb")), F.expr("b = a + 1"))
    return both.select("a", "b", set_similarity(F.col("sa"), F.col("sb")).alias("similarity"))


_CLASSES = """WITH s AS MATERIALIZED (SELECT doc_id AS k, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS s FROM documents),
    m AS MATERIALIZED (SELECT k, s, min(k) OVER (PARTITION BY s) AS rep FROM s WHERE s IS NOT NULL), w AS (SELECT k, unnest(s) AS t FROM m WHERE k = rep), n AS (SELECT k, count(*) AS n FROM w GROUP BY 1),
    c AS (SELECT a.k AS k_a, b.k AS k_b, count(*) AS c FROM w a JOIN w b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2), p AS (SELECT k_a, k_b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.k = k_a JOIN n y ON y.k = k_b)"""


def _word_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.expr(_WORDS).alias("s"))


@query(
    "C14_set_similarity_join",
    """WITH w AS (SELECT DISTINCT doc_id AS k, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), n AS (SELECT k, count(*) AS n FROM w GROUP BY 1),
       c AS (SELECT a.k AS k_a, b.k AS k_b, count(*) AS c FROM w a JOIN w b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2), s AS (SELECT k_a, k_b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.k = k_a JOIN n y ON y.k = k_b)
       SELECT * FROM s WHERE similarity BETWEEN 0.65 AND 0.95""",
    "similarity",
)
def similarity_join(spark, sf_dir):
    """All pairs of documents whose word sets are alike but not equal, copies too."""
    return J.set_similarity_join(_word_sets(spark, sf_dir), "k", "s", 0.65, 0.95, expand=True)


@query(
    "C14_set_members",
    f"""{_CLASSES}, l AS (SELECT k, count(*) AS n FROM (SELECT k_a AS k FROM p WHERE similarity BETWEEN 0.65 AND 0.95 UNION ALL SELECT k_b FROM p WHERE similarity BETWEEN 0.65 AND 0.95) GROUP BY 1)
    SELECT m.k, rep, coalesce(l.n, 0) AS n_links FROM m LEFT JOIN l ON l.k = rep""",
)
def set_members(spark, sf_dir):
    """Of each document the class of its word set and the number of classes alike but not equal to it."""
    reps, members = J.set_classes(_word_sets(spark, sf_dir), "k", "s")
    found = J.similar_classes(reps, 0.65, 0.95)
    links = found.select(F.explode(F.array("ka", "kb")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(links, "rep", "left").select("k", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("C15_parameter_grid", "SELECT n_nationkey, b AS beta, m AS mode FROM nation, (SELECT unnest([0.5, 1.0]) AS b), (SELECT unnest(['u', 'w']) AS m)", "beta")
def grid(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(J.parameter_grid(spark, beta=[0.5, 1.0], mode=["u", "w"])))


@query(
    "C16_union_support",
    """WITH a AS (SELECT event_type AS k, count(*) / (SELECT count(*) FROM events WHERE value <= 60) AS p FROM events WHERE value <= 60 GROUP BY 1), b AS (SELECT event_type AS k, count(*) / (SELECT count(*) FROM events WHERE value > 60) AS p FROM events WHERE value > 60 GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS event_type, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM a FULL OUTER JOIN b ON a.k = b.k""",
    "p q",
)
def support(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("g", F.lit(1))
    a, b = (to_distribution(e.where(c), ["g"], "event_type") for c in ("value <= 60", "value > 60"))
    return J.union_support(a, b, [], "event_type")


@query(
    "C17_interleaved_pairs",
    """WITH x AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + l_quantity AS b FROM lineitem)
       SELECT l_orderkey, coalesce(n, 0) AS n_crossings FROM (SELECT DISTINCT l_orderkey FROM x) LEFT JOIN (SELECT p.l_orderkey AS k, count(*) AS n FROM x p JOIN x q ON p.l_orderkey = q.l_orderkey AND p.a < q.a AND q.a < p.b AND p.b < q.b GROUP BY 1) ON k = l_orderkey""",
)
def crossings(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_quantity")).alias("b"))
    return J.interleaved_pairs(x, "l_orderkey", "a", "b")
