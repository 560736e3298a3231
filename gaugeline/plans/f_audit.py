"""Ranking audit over the tables: documents with labels, line items, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import pair_credit
from gaugeline.operators import audit as A
from gaugeline.operators.joins import missing_scores
from gaugeline.operators.nulls import label_null
from gaugeline.registry import query, table


def labelled(spark, sf_dir) -> DataFrame:
    """Documents with a label: item_id, source, lang, score (characters), label (quality), weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), (1.0 + F.col("toxic")).alias("weight"))
    return docs.join(truth, "doc_id").withColumnRenamed("doc_id", "item_id")


_LABELLED = "SELECT doc_id AS item_id, source, lang, n_chars::DOUBLE AS score, quality AS label, 1.0 + toxic AS weight FROM documents JOIN labels USING (doc_id)"


def auc_sql(rows: str, by: str, weight: str = "weight") -> str:
    """SQL of the weighted AUC by comparing every positive with every negative of a group."""
    keys = ", ".join(f"p.{c} AS {c}" for c in by.split())
    same = " AND ".join(f"p.{c} = n.{c}" for c in by.split())
    group = ", ".join(by.split())
    pw, nw = (("p." + weight, "n." + weight) if weight else ("1.0", "1.0"))
    return f"""SELECT g.*, a.auc FROM (SELECT {group}, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg FROM ({rows}) GROUP BY {group}) g LEFT JOIN
      (SELECT {keys}, sum({pw} * {nw} * CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / sum({pw} * {nw}) AS auc
       FROM ({rows}) p JOIN ({rows}) n ON {same} AND p.label = 1 AND n.label <> 1 GROUP BY {", ".join("p." + c for c in by.split())}) a USING ({group})"""


@query("F1_weighted_auc", auc_sql(_LABELLED, "source"), "auc")
def f1(spark, sf_dir):
    return A.weighted_auc(labelled(spark, sf_dir), ["source"])


@query(
    "F1_weighted_auc_global",
    """WITH x AS (SELECT l_extendedprice AS s, (l_returnflag = 'R')::INTEGER AS y, l_quantity AS w FROM lineitem), b AS (SELECT s, sum(w) FILTER (y = 1) AS p, coalesce(sum(w) FILTER (y = 0), 0) AS n FROM x GROUP BY s),
       c AS (SELECT coalesce(p, 0) AS p, n, sum(n) OVER (ORDER BY s) - n AS below FROM b) SELECT sum(p * (below + 0.5 * n)) / (sum(p) * sum(n)) AS auc FROM c""",
    "auc",
)
def f1b(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("weight"))
    return A.weighted_auc_global(rows)


@query("F2_item_audit")
def f2(spark, sf_dir):
    """AUC, exact null, gate and verdict per source."""
    return A.item_audit(labelled(spark, sf_dir), ["source"])


@query("F2_item_audit_auc", auc_sql(_LABELLED, "source"), "auc")
def f2b(spark, sf_dir):
    """The columns of the audit that do not rest on the null of F6."""
    return A.item_audit(labelled(spark, sf_dir), ["source"]).select("source", "n_pos", "n_neg", "auc")


@query("F3_pair_credit", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_tax - l_discount) <= 1e-9::DOUBLE THEN 0.5 WHEN l_tax > l_discount THEN 1.0 ELSE 0.0 END AS credit FROM lineitem", "credit")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pair_credit(F.col("l_tax"), F.col("l_discount"), 1e-9).alias("credit"))


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("similarity"), F.col("l_extendedprice").alias("pos_score"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey") * 30.0).alias("neg_score"), (1 + F.col("l_tax")).alias("weight")
    )


_CURVE = """SELECT bin, count(*) AS n_total, count(*) FILTER (neg IS NOT NULL) AS n_scored, sum(w * c) FILTER (neg IS NOT NULL) / sum(w) FILTER (neg IS NOT NULL) AS auc, median(sim) AS median_similarity FROM (
  SELECT *, CASE WHEN sim < 0.5 THEN 'easy' WHEN sim < 0.7 THEN 'medium' ELSE 'hard' END AS bin, CASE WHEN abs(pos - neg) <= 1e-12::DOUBLE THEN 0.5 WHEN pos > neg THEN 1.0 ELSE 0.0 END AS c FROM (
    SELECT l_quantity / 50 AS sim, l_extendedprice AS pos, CASE WHEN l_linenumber <> 7 THEN l_partkey * 30.0 END AS neg, 1 + l_tax AS w FROM lineitem)) GROUP BY 1"""


@query("F4_hardness_curve", _CURVE, "auc median_similarity")
def f4(spark, sf_dir):
    return A.hardness_curve(_pairs(spark, sf_dir))


@query(
    "F5_interpret_hardness",
    f"""WITH c AS ({_CURVE}), h AS (SELECT max(median_similarity) AS m, max(n_scored) FILTER (bin = 'hard') AS n, max(auc) FILTER (bin = 'hard') AS a FROM c)
    SELECT CASE WHEN m < 0.5 OR coalesce(n, 0) < 50 OR a IS NULL THEN 'INCONCLUSIVE' WHEN a < 0.6 THEN 'ILLUSION' ELSE 'SUCCESS' END AS verdict,
    CASE WHEN m < 0.5 THEN 'negatives_too_easy' WHEN coalesce(n, 0) < 50 THEN 'too_few_hard_pairs' WHEN a IS NULL THEN 'no_hard_auc' WHEN a < 0.6 THEN 'hard_pairs_not_separated' ELSE 'hard_pairs_separated' END AS reason FROM h""",
)
def f5(spark, sf_dir):
    return A.interpret_hardness(A.hardness_curve(_pairs(spark, sf_dir)))


@query("F6_null_auc_quantile")
def f6(spark, sf_dir):
    """Null quantile for the class sizes of every source."""
    return A.null_auc_quantile(A.weighted_auc(labelled(spark, sf_dir), ["source"]), 0.95)


@query("F7_null_auc_single", "SELECT o_custkey, n, (greatest(ceil(0.95::DOUBLE * (n + 1)), 1) - 1) / n AS null_q FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)", "null_q")
def f7(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", "n", A.null_auc_single(F.col("n"), 0.95).alias("null_q"))


_CUSTOMERS = "SELECT o_custkey AS g, o_totalprice AS score, (o_orderstatus = 'F')::INTEGER AS label, o_orderkey AS item_id FROM orders"


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderkey").alias("item_id"))


_DRAW = "md5('7|' || rep::VARCHAR || '|' || item_id::VARCHAR)"


def _enumerated() -> str:
    drawn = f"""WITH x AS (SELECT *, sum(label) OVER (PARTITION BY g) AS m, unnest(range(1, 21)) AS rep FROM w), d AS (SELECT g, rep, score, (row_number() OVER (PARTITION BY g, rep ORDER BY {_DRAW}) <= m)::INTEGER AS label FROM x),
    a AS ({auc_sql("SELECT * FROM d", "g rep", "")}) SELECT g, quantile_cont(auc, 0.9::DOUBLE) AS null_q FROM a WHERE auc IS NOT NULL GROUP BY 1"""
    return f"""WITH c AS ({_CUSTOMERS}), s AS (SELECT g, CASE WHEN sum(label) <= 0 OR sum(label) >= count(*) THEN 'none' WHEN count(*) <= 10 THEN 'enumeration' ELSE 'permutation' END AS null_method FROM c GROUP BY 1),
    v AS (SELECT c.* FROM c JOIN s USING (g) WHERE null_method = 'enumeration'), w AS (SELECT c.* FROM c JOIN s USING (g) WHERE null_method = 'permutation'),
    r AS (SELECT g, score, row_number() OVER (PARTITION BY g ORDER BY score) - 1 AS i, sum(label) OVER (PARTITION BY g) AS m, count(*) OVER (PARTITION BY g) AS n FROM v),
    k AS (SELECT * FROM (SELECT g, i, score, m, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM r) WHERE bit_count(mask) = m),
    a AS (SELECT p.g, p.mask, avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auc FROM k p JOIN k q ON p.g = q.g AND p.mask = q.mask AND ((p.mask >> p.i) & 1) = 1 AND ((q.mask >> q.i) & 1) = 0 GROUP BY 1, 2),
    o AS (SELECT g, auc, row_number() OVER (PARTITION BY g ORDER BY auc) AS r, count(*) OVER (PARTITION BY g) AS n FROM a), e AS (SELECT g, n AS n_labelings, auc AS null_q FROM o WHERE r = greatest(1, ceil(n * 0.9::DOUBLE - 1e-9::DOUBLE))),
    f AS (SELECT * FROM e UNION ALL SELECT g, 20, null_q FROM ({drawn})) SELECT g, null_method, n_labelings, null_q FROM s LEFT JOIN f USING (g)"""


@query("F8_null_by_enumeration", _enumerated(), "null_q")
def f8(spark, sf_dir):
    return A.null_by_enumeration(_customers(spark, sf_dir), ["g"], "item_id", 0.9, 20, 7)


@query(
    "F9_null_by_permutation",
    f"""WITH x AS (SELECT *, sum(label) OVER (PARTITION BY lang) AS m, unnest(range(1, 21)) AS rep FROM ({_LABELLED})), d AS (SELECT lang, rep, score, (row_number() OVER (PARTITION BY lang, rep ORDER BY {_DRAW}) <= m)::INTEGER AS label FROM x),
    a AS ({auc_sql("SELECT * FROM d", "lang rep", "")}) SELECT lang, avg(auc) AS null_mean, quantile_cont(auc, 0.95) AS null_q FROM a WHERE auc IS NOT NULL GROUP BY 1""",
    "null_mean null_q",
)
def f9(spark, sf_dir):
    return A.null_by_permutation(labelled(spark, sf_dir), ["lang"], "item_id", 20, 0.95, 7)


@query("F9_null_by_labels")
def f9b(spark, sf_dir):
    """Weighted permutation null of every customer's orders and of every source's documents, by dealing positives out."""
    orders = _customers(spark, sf_dir).select(F.concat(F.lit("customer "), F.col("g").cast("string")).alias("g"), "score", "label", F.lit(1.0).alias("weight"))
    docs = labelled(spark, sf_dir).select(F.col("source").alias("g"), "score", "label", "weight")
    return label_null(orders.unionByName(docs), ["g"], 200, 0.95, 7)


@query("F2_item_audit_labels")
def f2c(spark, sf_dir):
    """AUC, null with ties and weights, gate and verdict per source."""
    return A.item_audit_labels(labelled(spark, sf_dir), ["source"], 200)


@query(
    "F10_null_by_random_score",
    f"""WITH x AS (SELECT lang, label, item_id, unnest(range(1, 21)) AS rep FROM ({_LABELLED})), d AS (SELECT lang, rep, label, ('0x' || substr({_DRAW}, 1, 12))::BIGINT / 281474976710655.0::DOUBLE AS score FROM x),
    a AS ({auc_sql("SELECT * FROM d", "lang rep", "")}) SELECT lang, avg(auc) AS null_mean, quantile_cont(auc, 0.95) AS null_q FROM a WHERE auc IS NOT NULL GROUP BY 1""",
    "null_mean null_q",
)
def f10(spark, sf_dir):
    return A.null_by_random_score(labelled(spark, sf_dir), ["lang"], "item_id", 20, 0.95, 7)


_SLACK = "SELECT o_orderpriority AS g, o_totalprice / 100000 - 1 AS slack, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice >= 100000 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM orders"


def _rank_of(q: float) -> str:
    return f"max(slack) FILTER (r = greatest(1, round_even(n * {q}::DOUBLE, 0))::BIGINT)"


@query(
    "F11_slack_stats",
    f"""SELECT g, count(*) AS n_ok, avg((verdict = 'PASS')::INTEGER) AS pass_rate, avg(slack) AS mean_slack, {_rank_of(0.25)} AS p25, {_rank_of(0.5)} AS median, {_rank_of(0.75)} AS p75
    FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY slack) AS r, count(*) OVER (PARTITION BY g) AS n FROM ({_SLACK}) WHERE verdict IS NOT NULL) GROUP BY g""",
    "pass_rate mean_slack p25 median p75",
)
def f11(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_totalprice") >= 100000, "PASS").otherwise("FAIL")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 100000 - 1).alias("slack"), verdict.alias("verdict"))
    return A.slack_stats(rows, ["g"])


@query(
    "F12_audit_warnings",
    """SELECT o_custkey, CASE WHEN n > 8 AND m > 0 AND k > 0 THEN 'scores_partially_missing,weighted_auc_vs_unweighted_null' WHEN n > 8 THEN 'weighted_auc_vs_unweighted_null' WHEN m > 0 AND k > 0 THEN 'scores_partially_missing' ELSE '' END AS warnings
       FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS m, count(*) FILTER (o_orderstatus <> 'P') AS k FROM orders GROUP BY 1)""",
)
def f12(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("m"), F.count_if(F.col("o_orderstatus") != "P").alias("k"))
    return n.select("o_custkey", F.array_join(A.audit_warnings(F.col("n") > 8, F.col("m"), F.col("k")), ",").alias("warnings"))


def _separation_sql(rows: str) -> str:
    """rows: g, x, c (1 for class a, 0 for b), weight."""
    return f"""WITH rows_ AS ({rows}), m AS (SELECT g, c, sum(x * weight) / sum(weight) AS m FROM rows_ GROUP BY 1, 2), s AS (SELECT r.g, r.c, any_value(m.m) AS m, sqrt(sum(weight * (x - m.m) ** 2) / sum(weight)) AS s FROM rows_ r JOIN m ON m.g = r.g AND m.c = r.c GROUP BY 1, 2),
    u AS ({auc_sql("SELECT g, x AS score, c AS label, weight FROM rows_", "g")})
    SELECT a.g, a.m AS mean_a, b.m AS mean_b, a.m - b.m AS delta, (a.m - b.m) / nullif(sqrt((a.s ** 2 + b.s ** 2) / 2), 0) AS effect, u.auc, greatest(u.auc, 1 - u.auc) AS best_auc, greatest(u.auc, 1 - u.auc) >= 0.99 AS trivial
    FROM s a JOIN s b ON a.g = b.g AND a.c = 1 AND b.c = 0 JOIN u ON u.g = a.g"""


_SEP = "mean_a mean_b delta effect auc best_auc"


@query("F13_class_separation", _separation_sql("SELECT lang AS g, score AS x, label AS c, weight FROM (" + _LABELLED + ")"), _SEP)
def f13(spark, sf_dir):
    return A.class_separation(labelled(spark, sf_dir).withColumnRenamed("lang", "g"), ["g"], "score", "label", 1, 0)


_FEATURES = "SELECT vec_id AS i, d AS g, embedding[d + 1]::DOUBLE AS x, (label = 0)::INTEGER AS c, 1.0 AS weight FROM embeddings, (SELECT unnest(range(0, (SELECT len(embedding) FROM embeddings LIMIT 1))) AS d) WHERE label IN (0, 1)"


@query(
    "F14_feature_screen",
    f"""WITH x AS MATERIALIZED ({_FEATURES}), v AS (SELECT i, x AS v FROM x WHERE g = 0), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS b FROM x JOIN v USING (i)),
    r AS (SELECT g, round(abs(corr(a, b)), 12) AS rho FROM k GROUP BY 1), s AS ({_separation_sql("SELECT g, x, c, weight FROM x")}),
    f AS (SELECT s.g::INTEGER AS g, delta, auc, rho, rho >= 0.999 AS proxy, best_auc - (SELECT best_auc FROM s WHERE g = 0) AS auc_gap, best_auc FROM s JOIN r USING (g))
    SELECT g, delta, auc, rho, proxy, auc_gap, g = (SELECT g FROM f ORDER BY round(abs(delta), 12) DESC, g LIMIT 1) AS selected_default, g = (SELECT g FROM f WHERE NOT proxy ORDER BY round(best_auc, 12) DESC, g LIMIT 1) AS selected FROM f""",
    "delta auc rho auc_gap",
)
def f14(spark, sf_dir):
    """Every dimension as a feature, with the first one as the baseline."""
    e = table(spark, sf_dir, "embeddings").where("label IN (0, 1)").select("vec_id", "label", "embedding")
    rows = e.select("vec_id", "label", F.lit(1.0).alias("weight"), F.posexplode("embedding").alias("g", "x"))
    baseline = e.select("vec_id", F.get("embedding", F.lit(0)).alias("value"))
    return A.feature_screen(rows, "vec_id", "g", "x", "label", 0, 1, "weight", baseline).select("g", "delta", "auc", "rho", "proxy", "auc_gap", "selected_default", "selected")


@query(
    "F15_one_vs_other",
    "WITH x AS (" + auc_sql("SELECT c AS class, n_chars::DOUBLE AS score, (lang = c)::INTEGER AS label FROM documents, (SELECT unnest(['en', 'de', 'fr']) AS c)", "class", "") + ") SELECT class, n_pos, n_neg, greatest(auc, 1 - auc) AS best_auc FROM x",
    "best_auc",
)
def f15(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), F.lit(1.0).alias("weight"))
    return A.one_vs_other(docs, "x", "lang", ["en", "de", "fr"])


@query(
    "F16_collision_summary",
    """WITH p AS (SELECT a.c_mktsegment = b.c_mktsegment AS same, abs(a.c_acctbal - b.c_acctbal) AS gap FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 1.0)
       SELECT count(*) AS n_pairs, count(*) FILTER (same) AS n_within, count(*) FILTER (NOT same) AS n_across, max(gap) FILTER (NOT same) AS max_across_gap, (SELECT count(*) * (count(*) - 1) // 2 FROM customer) AS n_total,
       count(*) / (SELECT count(*) * (count(*) - 1) / 2 FROM customer) AS rate, count(*) FILTER (NOT same) / (SELECT count(*) * (count(*) - 1) / 2 FROM customer) AS across_rate FROM p""",
    "max_across_gap rate across_rate",
)
def f16(spark, sf_dir):
    return A.collision_summary(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", "c_mktsegment", 1.0)


@query(
    "F17_vector_collision_rate",
    """WITH v AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice AS y FROM part), p AS (SELECT count(*) AS n FROM v a JOIN v b ON a.k < b.k AND abs(a.x - b.x) <= 0.5 + 1e-5::DOUBLE * abs(b.x) AND abs(a.y - b.y) <= 0.5 + 1e-5::DOUBLE * abs(b.y))
       SELECT n AS n_equal, (SELECT count(*) * (count(*) - 1) // 2 FROM v) AS n_total, n / (SELECT count(*) * (count(*) - 1) / 2 FROM v) AS rate FROM p""",
    "rate",
)
def f17(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"))
    return A.vector_collision_rate(rows, "p_partkey", "v", 0.5)


@query(
    "F18_score_coverage",
    """WITH x AS (SELECT o_orderkey, count(l_partkey) AS n, count(l_partkey) FILTER (p_size > 10) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
       SELECT count(*) AS n_items, sum(n)::BIGINT AS n_negatives, sum(k)::BIGINT AS n_scored, (sum(n) - sum(k))::BIGINT AS n_missing, count(*) FILTER (k < n) AS items_with_missing FROM x""",
)
def f18(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey")
    negatives = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    scores = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("key"))
    return A.score_coverage(items, negatives, scores, "o_orderkey", "l_partkey")


@query("F19_score_request_pack", "SELECT l_partkey, count(DISTINCT l_orderkey) AS n_items, min(l_suppkey) AS example FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size <= 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def f19(spark, sf_dir):
    """A top-k report of the negatives without a score; small parts have none."""
    scores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("score"))
    return A.score_request_pack(missing_scores(table(spark, sf_dir, "lineitem"), scores, "l_partkey"), "l_orderkey", "l_partkey", "l_suppkey")


@query(
    "F20_control_gate",
    """WITH x AS (SELECT l_suppkey, min(l_quantity / 50) AS auc, max(greatest(l_tax, l_discount)) AS worst_null FROM lineitem GROUP BY 1)
       SELECT l_suppkey, auc, worst_null, worst_null + 0.05 AS gate, auc - (worst_null + 0.05) AS slack, CASE WHEN auc - (worst_null + 0.05::DOUBLE) >= 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x""",
    "auc worst_null gate slack",
)
def f20(spark, sf_dir):
    return A.control_gate(table(spark, sf_dir, "lineitem").withColumn("auc_", F.col("l_quantity") / 50), ["l_suppkey"], "auc_", ["l_tax", "l_discount"], 0.05)


@query(
    "F21_outcome_verdict",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'SKIP:' || o_orderstatus WHEN n = 0 THEN 'SKIP:no_negatives' WHEN k = 0 THEN 'SKIP:no_scores' WHEN auc IS NULL THEN 'SKIP:no_auc' WHEN auc - 0.503 >= 0 THEN 'PASS' ELSE 'FAIL' END AS outcome
       FROM (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, count(*) FILTER (l_linenumber > 1) AS k, avg(l_quantity / 50) FILTER (l_linenumber > 2) AS auc FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
)
def f21(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").groupBy("o_orderkey", "o_orderstatus")
    rows = rows.agg(F.count("l_linenumber").alias("n"), F.count_if(F.col("l_linenumber") > 1).alias("k"), F.avg(F.when(F.col("l_linenumber") > 2, F.col("l_quantity") / 50)).alias("auc"))
    status = F.when(F.col("o_orderstatus") == "F", "OK").otherwise(F.col("o_orderstatus"))
    return rows.select("o_orderkey", A.outcome_verdict(status, F.col("n"), F.col("k"), F.col("auc"), F.col("auc") - 0.503).alias("outcome"))


@query(
    "F22_iteration_audit",
    """WITH p AS (SELECT user_id, arg_max(value, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1), r AS (SELECT count(*) AS n, avg((last <= 95)::INTEGER) AS c, bool_and(hi = lo) AS t FROM p)
       SELECT n AS n_items, c AS converged_rate, t AS trivial, CASE WHEN c < 0.9 THEN 'NONCONVERGED' WHEN t THEN 'TRIVIAL' WHEN n < 10 THEN 'INCONCLUSIVE' ELSE 'SUCCESS' END AS verdict FROM r""",
    "converged_rate",
)
def f22(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("step", F.struct("ts", "event_id"))
    return A.iteration_audit(rows, "user_id", "step", "value", 95.0, min_rate=0.9)
