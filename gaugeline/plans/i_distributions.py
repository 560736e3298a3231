"""Distributions and chains over events: chain = user, state = type, trace = value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import distributions as I  # noqa: E741
from gaugeline.operators.stats import to_distribution
from gaugeline.operators.windows import cumulative_unique, lag1_autocorr
from gaugeline.plans.e_windows import _LAGS
from gaugeline.registry import query, table

_ORDER = ["ts", "event_id"]


def _e(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Distributions of the types of each user group, for small and for large values."""
    e = _e(spark, sf_dir).withColumn("g", F.col("user_id") % 10)
    return tuple(to_distribution(e.where(c), ["g"], "event_type") for c in ("value < 40", "value >= 40"))


_SUPPORT = """SELECT coalesce(a.g, b.g) AS g, coalesce(a.k, b.k) AS k, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM
  (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS p FROM (SELECT user_id % 10 AS g, event_type AS k, count(*) AS n FROM events WHERE value < 40 GROUP BY 1, 2)) a FULL OUTER JOIN
  (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS p FROM (SELECT user_id % 10 AS g, event_type AS k, count(*) AS n FROM events WHERE value >= 40 GROUP BY 1, 2)) b ON a.g = b.g AND a.k = b.k"""
_EPS = "1e-6::DOUBLE"
_ADD = f"SELECT g, k, (p + {_EPS}) / (1 + n * {_EPS}) AS p, (q + {_EPS}) / (1 + n * {_EPS}) AS q FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({_SUPPORT}))"


@query("I1_kl_add", f"SELECT g, sum(p * ln(p / q)) AS kl FROM ({_ADD}) GROUP BY 1", "kl")
def i1(spark, sf_dir):
    return I.kl(*_halves(spark, sf_dir), ["g"], "event_type", "add", 1e-6)


@query("I1_kl_floor", f"SELECT g, sum(greatest(p, {_EPS}) * ln(greatest(p, {_EPS}) / greatest(q, {_EPS}))) AS kl FROM ({_SUPPORT}) GROUP BY 1", "kl")
def i1b(spark, sf_dir):
    return I.kl(*_halves(spark, sf_dir), ["g"], "event_type", "floor", 1e-6)


@query("I1_kl_support", f"SELECT g, sum(CASE WHEN p > 0 THEN p * ln(p / (q + {_EPS})) ELSE 0 END) AS kl FROM ({_SUPPORT}) GROUP BY 1", "kl")
def i1c(spark, sf_dir):
    return I.kl(*_halves(spark, sf_dir), ["g"], "event_type", "support", 1e-6)


@query("I2_symmetric_kl", f"SELECT g, sum(p * ln(p / q)) AS pq, sum(q * ln(q / p)) AS qp, (sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2 AS kl FROM ({_ADD}) GROUP BY 1", "pq qp kl")
def i2(spark, sf_dir):
    return I.symmetric_kl(*_halves(spark, sf_dir), ["g"], "event_type", "add", 1e-6)


_PAIRWISE = f"""WITH c AS (SELECT user_id AS c, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id AS c FROM events), s AS (SELECT DISTINCT event_type AS k FROM events),
  d AS (SELECT u.c, s.k, (coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY u.c) + {_EPS}) / (1 + (SELECT count(*) FROM s) * {_EPS}) AS p FROM u CROSS JOIN s LEFT JOIN c ON c.c = u.c AND c.k = s.k),
  x AS (SELECT a.c AS a, b.c AS b, sum(a.p * ln(a.p / b.p)) AS d FROM d a JOIN d b ON a.k = b.k AND a.c <> b.c GROUP BY 1, 2)"""


@query("I3_pairwise_kl", f"{_PAIRWISE} SELECT max(d) AS kl_max, avg(d) AS kl_mean FROM x", "kl_max kl_mean")
def i3(spark, sf_dir):
    return I.pairwise_kl(_e(spark, sf_dir), "user_id", "event_type", 1e-6)


_SPLIT = f"""SELECT u.user_id, CASE WHEN any_value(u.n) >= 4 THEN sum((p + {_EPS}) / (1 + m * {_EPS}) * ln((p + {_EPS}) / (q + {_EPS}))) END AS kl FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) u LEFT JOIN (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM (SELECT user_id, k, coalesce(count(*) FILTER (h = 1) / any_value(n1), 0) AS p, coalesce(count(*) FILTER (h = 2) / any_value(n2), 0) AS q FROM (
    SELECT *, nullif(count(*) FILTER (h = 1) OVER (PARTITION BY user_id), 0) AS n1, count(*) FILTER (h = 2) OVER (PARTITION BY user_id) AS n2 FROM (
      SELECT user_id, event_type AS k, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= count(*) OVER (PARTITION BY user_id) // 2 THEN 1 ELSE 2 END AS h FROM events)) GROUP BY 1, 2)) x ON x.user_id = u.user_id GROUP BY 1"""


@query("I4_split_half_kl", _SPLIT, "kl")
def i4(spark, sf_dir):
    return I.split_half_kl(_e(spark, sf_dir), "user_id", _ORDER, "event_type", 1e-6)


_RHAT = """SELECT {by} min(n) AS n, count(*) AS m, sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m1)) / avg(v)) AS rhat FROM (
  SELECT {by} user_id, any_value(n) AS n, avg(value) AS m1, var_samp(value) AS v FROM (SELECT {by} user_id, value, row_number() OVER (PARTITION BY {by} user_id ORDER BY ts, event_id) AS i, (SELECT {low}) AS n FROM {rows} AS t) WHERE i <= n GROUP BY ALL) {group}"""
_RHAT_ALL = _RHAT.format(by="", low="min(c) FROM (SELECT count(*) AS c FROM events GROUP BY user_id)", rows="events", group="")


@query("I5_rhat", _RHAT_ALL, "rhat")
def i5(spark, sf_dir):
    return I.rhat(_e(spark, sf_dir), "user_id", _ORDER, "value")


_ESS = f"""{_LAGS}, m AS (SELECT *, min(rho) OVER (PARTITION BY user_id ORDER BY lag) AS lo FROM rho), u AS (SELECT user_id, sum(rho) AS s FROM m WHERE lo > 0 GROUP BY 1)
  SELECT e.user_id, count(*) / (1 + 2 * coalesce(any_value(s), 0)) AS ess FROM events e LEFT JOIN u ON u.user_id = e.user_id GROUP BY 1"""


@query("I6_ess_initial_positive", _ESS, "ess")
def i6(spark, sf_dir):
    return I.ess_initial_positive(_e(spark, sf_dir), "user_id", _ORDER, "value", 5)


@query(
    "I7_ess_ar1",
    """WITH d AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, ts, event_id FROM events), p AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM d),
       r AS (SELECT user_id, count(*) AS n, greatest(-1, least(1, coalesce(sum(d * q) / nullif(sum(d * d), 0), 0))) AS r FROM p GROUP BY 1) SELECT user_id, greatest(1, least(n, n * (1 - r) / (1 + r))) AS ess FROM r""",
    "ess",
)
def i7(spark, sf_dir):
    return lag1_autocorr(_e(spark, sf_dir), "user_id", _ORDER, "value").select("user_id", I.ess_ar1(F.col("n"), F.col("rho1")).alias("ess"))


@query(
    "I8_coverage_curve",
    """WITH r AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT user_id, k, ceil(min(i) * 10 / any_value(n))::INTEGER AS bin FROM r GROUP BY 1, 2)
       SELECT g.user_id, g.bin, count(f.k) / 5.0 AS coverage FROM (SELECT DISTINCT user_id, unnest(range(1, 11))::INTEGER AS bin FROM events) g LEFT JOIN f ON f.user_id = g.user_id AND f.bin <= g.bin GROUP BY 1, 2""",
    "coverage",
)
def i8(spark, sf_dir):
    return cumulative_unique(_e(spark, sf_dir), "user_id", _ORDER, "event_type", 10).select("user_id", "bin", (F.col("n_unique") / 5.0).alias("coverage"))


@query(
    "I9_mixing_report",
    f"""SELECT (SELECT max(d) FROM ({_PAIRWISE} SELECT d FROM x)) AS kl_max, (SELECT avg(d) FROM ({_PAIRWISE} SELECT d FROM x)) AS kl_mean, (SELECT max(kl) FROM ({_SPLIT})) AS split_kl_max,
    (SELECT rhat FROM ({_RHAT_ALL})) AS rhat, (SELECT min(ess) FROM ({_ESS})) AS ess_min, (SELECT min(n) FROM (SELECT count(DISTINCT event_type) AS n FROM events GROUP BY user_id)) AS min_unique""",
    "kl_max kl_mean split_kl_max rhat ess_min",
)
def i9(spark, sf_dir):
    return I.mixing_report(_e(spark, sf_dir), "user_id", _ORDER, "event_type", "value", 5, 10, 1e-6)


@query(
    "I10_weighted_softmax",
    "SELECT p_partkey, p_size * exp(-0.05 * (p_retailprice - lo)) / sum(p_size * exp(-0.05 * (p_retailprice - lo))) OVER (PARTITION BY p_brand) AS p FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo FROM part)",
    "p",
)
def i10(spark, sf_dir):
    return I.weighted_softmax(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice", 0.05).select("p_partkey", "p")


@query(
    "I10_weighted_softmax_cold",
    "SELECT p_partkey, CASE WHEN p_retailprice = lo THEN p_size / sum(p_size) FILTER (p_retailprice = lo) OVER (PARTITION BY p_brand) ELSE 0 END AS p FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo FROM part)",
    "p",
)
def i10b(spark, sf_dir):
    return I.weighted_softmax(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice", 1.0, 0.0).select("p_partkey", "p")


def _best_lam(grid: str) -> str:
    """SQL: (lam, kl), the first of the least, over a table of lam."""
    return f"""SELECT lam, kl FROM (SELECT lam, sum(CASE WHEN o > 0 THEN o * ln(o / greatest(g * exp(-lam * (e - lo)) / z, 1e-300::DOUBLE)) END) AS kl FROM (SELECT *, sum(g * exp(-lam * (e - lo))) OVER (PARTITION BY lam) AS z FROM x, ({grid})) GROUP BY 1) ORDER BY kl, lam LIMIT 1"""


@query(
    "I11_fit_temperature",
    f"""WITH n AS (SELECT c_nationkey, count(*)::DOUBLE AS g, -avg(c_acctbal) / 1000 AS e, count(*) FILTER (c_acctbal > 5000)::DOUBLE AS r FROM customer GROUP BY 1), x AS (SELECT g, e, r / (SELECT sum(r) FROM n) AS o, (SELECT min(e) FROM n) AS lo FROM n),
    f AS ({_best_lam("SELECT i * (10.0::DOUBLE / 400) AS lam FROM (SELECT unnest(range(0, 401)) AS i)")}), a AS (SELECT greatest(0.0::DOUBLE, lam - 10.0::DOUBLE / 400) AS a, least(10.0::DOUBLE, lam + 10.0::DOUBLE / 400) AS b FROM f)
    {_best_lam("SELECT a + i * ((b - a) / 200) AS lam FROM a, (SELECT unnest(range(0, 201)) AS i)")}""",
    "lam kl",
)
def i11(spark, sf_dir):
    """Shares of rich customers by nation against all customers, weighted by their mean balance."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("g"), (-F.avg("c_acctbal") / 1000).alias("e"), F.count_if(F.col("c_acctbal") > 5000).alias("r"))
    rows = rows.join(F.broadcast(rows.agg(F.sum("r").alias("t")))).select("g", "e", (F.col("r") / F.col("t")).alias("o"))
    return I.fit_temperature(rows, "o", "g", "e")


@query(
    "I12_bias_vector",
    "SELECT l_suppkey, ln((p + 1e-6::DOUBLE) / (q + 1e-6::DOUBLE)) AS log_ratio FROM (SELECT l_suppkey, avg(l_tax) AS p, avg(l_discount) AS q FROM lineitem GROUP BY 1) ORDER BY abs(log_ratio) DESC, l_suppkey LIMIT 5",
    "log_ratio",
)
def i12(spark, sf_dir):
    """A report of the five largest biases."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_tax").alias("p"), F.avg("l_discount").alias("q"))
    return I.bias_vector(rows, "l_suppkey", "p", "q", 5, 1e-6)


@query(
    "I13_task_board",
    """WITH s AS (SELECT l_orderkey AS task, count(*) AS n, count(DISTINCT l_returnflag) AS d FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
       SELECT o_custkey AS setting, count(n) AS n_ready, count(*) AS n_total, coalesce(string_agg(CASE WHEN n IS NULL THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey::VARCHAR), '') AS missing, count(*) FILTER (d > 1) AS n_mismatch, count(n) = count(*) AS complete
       FROM orders LEFT JOIN s ON task = o_orderkey GROUP BY 1""",
)
def i13(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("setting"), F.col("o_orderkey").alias("task"))
    done = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("task"), "l_returnflag")
    return I.task_board(tasks, done, "setting", "task", "l_returnflag")


@query(
    "I14_merge_runs",
    """WITH e AS (SELECT *, user_id % 10 AS g FROM events), ok AS (SELECT g FROM e GROUP BY 1 HAVING count(DISTINCT user_id) >= 12), x AS (SELECT * FROM e WHERE g IN (SELECT g FROM ok)), c AS (SELECT g, user_id, count(*) AS c FROM x GROUP BY 1, 2), lo AS (SELECT g, min(c) AS n, count(*) AS m FROM c GROUP BY 1),
       r AS (SELECT x.g, x.user_id, value, row_number() OVER (PARTITION BY x.g, x.user_id ORDER BY ts, event_id) AS i, n FROM x JOIN lo ON lo.g = x.g), p AS (SELECT g, user_id, any_value(n) AS n, avg(value) AS m1, var_samp(value) AS v FROM r WHERE i <= n GROUP BY 1, 2),
       h AS (SELECT g, CASE WHEN min(n) >= 2 AND avg(v) > 0 THEN sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m1)) / avg(v)) END AS rhat FROM p GROUP BY 1)
       SELECT x.g, count(DISTINCT event_type) AS n_unique, avg(value) AS mean_x, count(*) AS n_rows, count(DISTINCT event_type) / 5.0 AS coverage, any_value(rhat) AS rhat FROM x JOIN h ON h.g = x.g GROUP BY 1""",
    "mean_x coverage rhat",
)
def i14(spark, sf_dir):
    rows = _e(spark, sf_dir).withColumn("g", F.col("user_id") % 10)
    return I.merge_runs(rows, "g", "user_id", _ORDER, "value", "event_type", 12, 5)


@query(
    "I15_convergence_compare",
    f"SELECT a.g, kl_pq, kl_qp, mass_seen FROM (SELECT g, sum(p * ln(p / q)) AS kl_pq, sum(q * ln(q / p)) AS kl_qp FROM ({_ADD}) GROUP BY 1) a JOIN (SELECT g, sum(CASE WHEN p > 0 THEN q ELSE 0 END) AS mass_seen FROM ({_SUPPORT}) GROUP BY 1) b ON a.g = b.g",
    "kl_pq kl_qp mass_seen",
)
def i15(spark, sf_dir):
    return I.convergence_compare(*_halves(spark, sf_dir), ["g"], "event_type", 1e-6)


@query(
    "I16_mean_distribution",
    "SELECT event_type, sum(p) / (SELECT count(DISTINCT user_id) FROM events) AS p FROM (SELECT event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1",
    "p",
)
def i16(spark, sf_dir):
    return I.mean_distribution(_e(spark, sf_dir), "user_id", "event_type")
