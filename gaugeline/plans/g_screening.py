"""Screening and utility over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.scalars import edge_distance_of
from gaugeline.operators import screening as G
from gaugeline.registry import query, table

_CHECKS = """CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing' WHEN n_chars > 5000 THEN 'too_large' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'invalid' END"""


def _checks():
    return [(F.trim(F.coalesce("text", F.lit(""))) == "", "missing"), (F.col("n_chars") > 5000, "too_large"), (~F.col("text").rlike("[A-Za-z]"), "invalid")]


@query("G1_preflight", f"SELECT doc_id, CASE WHEN {_CHECKS} IS NULL THEN 'OK' ELSE 'SKIP' END AS status, {_CHECKS} AS reason, CASE WHEN n_chars < 200 THEN 'short' ELSE '' END AS warnings FROM documents")
def g1(spark, sf_dir):
    return G.preflight(table(spark, sf_dir, "documents"), _checks(), [(F.col("n_chars") < 200, "short")]).select("doc_id", "status", "reason", "warnings")


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_size")


def _pool(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), "p_brand", "p_size")


_TURN = "row_number() OVER (PARTITION BY item_id ORDER BY md5('5|' || item_id::VARCHAR || '|' || cand_id::VARCHAR), cand_id)"


def _match(strata: str, k: int, where: str = "TRUE") -> str:
    """SQL of (item_id, cand_id, turn): the k parts of the stratum that follow the item's place in digest order."""
    same = " AND ".join(f"i.{c} = c.{c}" for c in strata.split(", "))
    return f"""SELECT * FROM (SELECT item_id, cand_id, row_number() OVER (PARTITION BY item_id ORDER BY step) AS turn FROM (
      SELECT i.p_partkey AS item_id, c.p_partkey AS cand_id, (c.place - ('0x' || substr(md5('5|' || i.p_partkey::VARCHAR), 1, 8))::BIGINT % n + n) % n AS step
      FROM part i JOIN (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5('5|' || p_partkey::VARCHAR), p_partkey) - 1 AS place, count(*) OVER (PARTITION BY {strata}) AS n FROM part) c ON {same}
      WHERE {where.replace("p_", "i.p_")}) WHERE item_id <> cand_id AND step <= {k}) WHERE turn <= {k}"""


@query("G2_matched_negatives", _match("p_brand, p_size", 2))
def g2(spark, sf_dir):
    return G.matched_negatives(_items(spark, sf_dir), _pool(spark, sf_dir), ["p_brand", "p_size"], 2, 5).select("item_id", "cand_id", "turn")


def _shortfall(k: int) -> str:
    return f"""WITH n AS (SELECT item_id, count(*) AS n FROM ({_match("p_brand, p_size", k)}) GROUP BY 1)
    SELECT p_partkey AS item_id, coalesce(n, 0) AS n_found, {k} - coalesce(n, 0) AS n_short FROM part LEFT JOIN n ON item_id = p_partkey"""


@query("G2_shortfall", _shortfall(3))
def g2b(spark, sf_dir):
    items = _items(spark, sf_dir)
    return G.shortfall(items, G.matched_negatives(items, _pool(spark, sf_dir), ["p_brand", "p_size"], 3, 5), 3)


_LADDER = f"""WITH a AS (SELECT *, 1 AS level_used FROM ({_match("p_brand, p_size", 2)})), b AS (SELECT *, 2 AS level_used FROM ({_match("p_brand", 2)}) WHERE item_id NOT IN (SELECT item_id FROM a))
    SELECT * FROM a UNION ALL SELECT * FROM b"""


@query("G3_matched_negatives_ladder", _LADDER)
def g3(spark, sf_dir):
    return G.matched_negatives_ladder(_items(spark, sf_dir), _pool(spark, sf_dir), [["p_brand", "p_size"], ["p_brand"]], 2, 5)


_WORDS = "array_remove(array_distinct(regexp_extract_all(lower(text), '[a-z]+', 0)), '')"
_SETS = "SELECT doc_id AS k, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents"
_SIM = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


def _alike(spark, sf_dir, sets: bool = False) -> tuple[DataFrame, DataFrame]:
    """The classes of equal word sets with those of a similarity of 0.5 or more, and the documents of each class."""
    return G.alike(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.expr(_WORDS).alias("s")), "k", "s", 0.5, sets)


def _of_rows(found: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for an item's class, for each of its rows."""
    return found.join(members.select(F.col("k").alias("item_id"), F.col("rep").alias("item")), "item").drop("item")


_ALIKE = f"""WITH w AS MATERIALIZED ({_SETS}), t AS (SELECT k, unnest(s) AS t FROM w), c AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.k <> b.k GROUP BY 1, 2)
    SELECT ka AS item_id, kb AS cand_id, x.s AS sa, y.s AS sb, c / (len(x.s) + len(y.s) - c) AS similarity FROM c JOIN w x ON x.k = ka JOIN w y ON y.k = kb WHERE c / (len(x.s) + len(y.s) - c) >= 0.5"""


@query(
    "G4_hard_negatives",
    f"""WITH x AS ({_ALIKE}), y AS (SELECT *, similarity BETWEEN 0.65 AND 0.95 AS ok, count(*) FILTER (NOT similarity BETWEEN 0.65 AND 0.95) OVER (PARTITION BY item_id) AS n_rejected FROM x)
    SELECT item_id, cand_id, similarity, n_rejected FROM (SELECT *, {_TURN} AS turn FROM y WHERE ok) WHERE turn <= 2""",
    "similarity",
)
def g4(spark, sf_dir):
    pairs, members = _alike(spark, sf_dir)
    return G.hard_negatives(pairs, members, "k", 0.65, 0.95, 2, 5)


@query(
    "G5_min_distance_filter",
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT item_id, cand_id, sb, row_number() OVER (PARTITION BY item_id ORDER BY cand_id) AS r FROM ({_ALIKE}) WHERE 1 - similarity >= 0.05::DOUBLE),
    g AS (SELECT item_id, cand_id, r, [sb] AS kept, TRUE AS ok FROM n WHERE r = 1 UNION ALL
      SELECT item_id, cand_id, r, CASE WHEN ok THEN list_append(kept, sb) ELSE kept END, ok FROM (
        SELECT n.item_id, n.cand_id, n.r, n.sb, g.kept, len(list_filter(g.kept, lambda o: 1 - {_SIM.format(a="o", b="n.sb")} < 0.2::DOUBLE)) = 0 AS ok FROM g JOIN n ON n.item_id = g.item_id AND n.r = g.r + 1))
    SELECT item_id, cand_id FROM g WHERE ok""",
)
def g5(spark, sf_dir):
    """Of all alike documents, those not equal and not too near to one taken before."""
    pairs, members = _alike(spark, sf_dir, True)
    # Of equal candidates only the first can be taken, which stands for its class.
    rows = pairs.select("item", F.col("cand").alias("cand_id"), "sb", (1 - F.col("similarity")).alias("d"))
    return _of_rows(G.min_distance_filter(rows, "item", "cand_id", "sb", "d", 0.05, 0.2).select("item", "cand_id"), members)


@query("G6_maxmin_select")
def g6(spark, sf_dir):
    """Of each word set the three others alike that lie farthest apart. Greedy by nature, so without SQL; see test_maxmin_choice_equals_greedy."""
    pairs, members = _alike(spark, sf_dir, True)
    rows = pairs.where("item <> cand").select("item", F.col("cand").alias("cand_id"), "sb")
    return _of_rows(G.maxmin_select(rows, "item", "cand_id", "sb", 3, 5), members)


@query(
    "G7_distance_summary",
    f"""WITH x AS MATERIALIZED (SELECT item_id, cand_id, sb, 1 - similarity AS d FROM ({_ALIKE})), o AS (SELECT item_id, count(*) AS n, min(d) AS min_d, avg(d) AS mean_d, max(d) AS max_d FROM x GROUP BY 1),
    p AS (SELECT a.item_id, min(1 - {_SIM.format(a='a.sb', b='b.sb')}) AS min_pair_d, avg(1 - {_SIM.format(a='a.sb', b='b.sb')}) AS mean_pair_d FROM x a JOIN x b ON a.item_id = b.item_id AND a.cand_id < b.cand_id GROUP BY 1) SELECT o.*, min_pair_d, mean_pair_d FROM o LEFT JOIN p USING (item_id)""",
    "min_d mean_d max_d min_pair_d mean_pair_d",
)
def g7(spark, sf_dir):
    pairs, members = _alike(spark, sf_dir, True)
    return _of_rows(G.distance_summary(pairs.withColumn("d", 1 - F.col("similarity")), "item", "cand", "sb", "d", "n_cand"), members)


_OTHERS = f"SELECT x.* FROM ({_ALIKE}) x JOIN (SELECT k, min(k) OVER (PARTITION BY list_sort(s)) AS rep FROM ({_SETS})) c ON c.k = cand_id AND c.rep = cand_id"


@query(
    "G8_edge_distance",
    f"SELECT item_id, cand_id, (len(sa) + len(sb) - 2 * len(list_intersect(sa, sb))) / (2.0 * (len(sa) + 1)) AS d FROM ({_OTHERS})",
    "d",
)
def g8(spark, sf_dir):
    """Distance of each document from every word set alike, its own too, which its least document stands for, so equal sets are told by their rows of 0."""
    pairs, members = _alike(spark, sf_dir)
    rows = pairs.select("item", F.col("cand").alias("cand_id"), edge_distance_of(F.col("similarity"), F.col("na"), F.col("nb"), F.col("na") + 2).alias("d"))
    return _of_rows(rows, members).where("item_id <> cand_id")


@query("G9_similarity_stats", f"SELECT item_id, min(similarity) AS min_similarity, median(similarity) AS median_similarity FROM ({_ALIKE}) GROUP BY 1", "min_similarity median_similarity")
def g9(spark, sf_dir):
    pairs, members = _alike(spark, sf_dir)
    return _of_rows(G.similarity_stats(pairs, "item", copies="n_cand"), members)


@query(
    "G10_covariate_balance",
    """SELECT 'p_size' AS attribute, avg(abs(i.p_size - c.p_size)) AS mean_abs_diff, count(*) AS n FROM lineitem JOIN part i ON i.p_partkey = l_partkey JOIN part c ON c.p_partkey = l_suppkey
       UNION ALL SELECT 'p_retailprice', avg(abs(i.p_retailprice - c.p_retailprice)), count(*) FROM lineitem JOIN part i ON i.p_partkey = l_partkey JOIN part c ON c.p_partkey = l_suppkey""",
    "mean_abs_diff",
)
def g10(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    item, cand = (part.select(F.col("p_partkey").alias(k), F.col("p_size").alias(f"p_size_{e}"), F.col("p_retailprice").alias(f"p_retailprice_{e}")) for k, e in (("l_partkey", "item"), ("l_suppkey", "cand")))
    return G.covariate_balance(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(item, "l_partkey").join(cand, "l_suppkey"), ["p_size", "p_retailprice"])


def _screened(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_size", "p_name")
    scores = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("score"))
    checks = [(F.col("p_name").isNull(), "missing"), (F.col("p_size") > 45, "too_large")]
    return G.screen(items, _pool(spark, sf_dir), scores, ["p_brand"], checks, 5, 5)


_SCREEN = f"""WITH c AS (SELECT p_partkey AS item_id, p_brand, p_retailprice AS s, p_size > 45 AS big, p_size > 3 AS own FROM part),
    n AS (SELECT item_id, cand_id, CASE WHEN p_size > 3 THEN p_retailprice END AS ns FROM ({_match("p_brand", 5, "p_size <= 45")}) JOIN part ON p_partkey = cand_id), a AS (SELECT item_id, count(*) AS n, count(ns) AS k FROM n GROUP BY 1),
    u AS (SELECT n.item_id, avg(CASE WHEN s > ns THEN 1.0 WHEN s = ns THEN 0.5 ELSE 0 END) AS auc FROM n JOIN c USING (item_id) WHERE ns IS NOT NULL AND own GROUP BY 1)
    SELECT c.item_id, CASE WHEN big OR coalesce(n, 0) = 0 OR coalesce(k, 0) = 0 OR auc IS NULL THEN 'SKIP' ELSE 'OK' END AS status, CASE WHEN big THEN 'too_large' WHEN coalesce(n, 0) = 0 THEN 'no_negatives' WHEN coalesce(k, 0) = 0 THEN 'no_scores' WHEN auc IS NULL THEN 'no_auc' END AS reason,
    coalesce(n, 0) AS n_negatives, coalesce(k, 0) AS n_scored, auc FROM c LEFT JOIN a USING (item_id) LEFT JOIN u USING (item_id)"""
#: With one positive all ranks are equally likely.
_GATE = "least(1.0, (greatest(ceil(0.95::DOUBLE * (n_scored + 1)), 1) - 1) / n_scored + 0.05::DOUBLE)"


@query("G11_screen", _SCREEN, "auc")
def g11(spark, sf_dir):
    """The flow without the gate columns."""
    return _screened(spark, sf_dir).select("item_id", "status", "reason", "n_negatives", "n_scored", "auc")


@query(
    "G11_screen_verdicts",
    f"""SELECT item_id, status, reason, n_negatives, n_scored, auc, CASE WHEN auc IS NOT NULL THEN {_GATE} END AS gate, auc - {_GATE} AS slack,
    CASE WHEN round(auc - {_GATE}, 9) >= 0 THEN 'PASS' WHEN round(auc - {_GATE}, 9) < 0 THEN 'FAIL' END AS verdict FROM ({_SCREEN})""",
    "auc gate slack",
)
def g11b(spark, sf_dir):
    return _screened(spark, sf_dir)


_ELIGIBLE = "CASE WHEN quality IS NULL THEN 'no_truth' WHEN n_chars > 5000 THEN 'too_large' WHEN toxic = 1 THEN 'toxic' ELSE 'eligible' END"


@query("G12_eligibility_funnel", f"SELECT {_ELIGIBLE} AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "share")
def g12(spark, sf_dir):
    rules = [(F.col("quality").isNull(), "no_truth"), (F.col("n_chars") > 5000, "too_large"), (F.col("toxic") == 1, "toxic")]
    return G.eligibility_funnel(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", rules)


@query(
    "G13_lift_report",
    """WITH e AS (SELECT doc_id, quality AS hit, n_chars FROM documents JOIN labels USING (doc_id)), r AS (SELECT hit FROM e ORDER BY md5('3|' || doc_id::VARCHAR), doc_id LIMIT 60), t AS (SELECT hit FROM e ORDER BY n_chars DESC, doc_id LIMIT 60), f AS (SELECT hit FROM e WHERE n_chars < 4000 ORDER BY n_chars DESC, doc_id LIMIT 60)
       SELECT 'random' AS method, count(*) AS k_eff, avg(hit) AS hit_rate FROM r UNION ALL SELECT 'top_score', count(*), avg(hit) FROM t UNION ALL SELECT 'filtered', count(*), avg(hit) FROM f""",
    "hit_rate",
)
def g13(spark, sf_dir):
    """Hit rates of selections of k rows, which is the measure itself."""
    e = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return G.lift_report(e, "doc_id", "quality", "n_chars", 60, 3, F.col("n_chars") < 4000)


@query(
    "G14_bootstrap_ci",
    """WITH x AS (SELECT lang AS g, quality::DOUBLE AS x, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN labels USING (doc_id)), s AS (SELECT g, n, i AS slot, unnest(range(1, 41)) AS draw FROM x),
       p AS (SELECT g, draw, ('0x' || substr(md5('9|' || draw::VARCHAR || '|' || slot::VARCHAR), 1, 8))::BIGINT % n AS i FROM s), m AS (SELECT p.g, p.draw, avg(x.x) AS m FROM p JOIN x ON x.g = p.g AND x.i = p.i GROUP BY 1, 2), r AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY m, draw) - 1 AS r FROM m)
       SELECT g AS lang, max(m) FILTER (r = 0) AS low, max(m) FILTER (r = 38) AS high FROM r GROUP BY 1""",
    "low high",
)
def g14(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "doc_id", "quality")
    return G.bootstrap_ci(rows, "lang", "doc_id", "quality", 40, 9)


@query("G15_resume_screen", "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE o_orderstatus END AS outcome FROM orders")
def g15(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_orderstatus")
    done = items.where("item_id % 3 = 0").select("item_id", F.lit("kept").alias("outcome"))
    return G.resume_screen(items, done, lambda rows: rows.select("item_id", F.col("o_orderstatus").alias("outcome")))
