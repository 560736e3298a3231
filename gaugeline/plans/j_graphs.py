"""Graphs of parts and suppliers per customer, and spectra of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators import graphs as J
from gaugeline.operators.ordered import dealt
from gaugeline.registry import query, table

_EDGES = "SELECT o_custkey AS graph, l_suppkey AS u, l_partkey % 100 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_UND = f"SELECT DISTINCT graph, least(u, v) AS u, greatest(u, v) AS v FROM ({_EDGES}) WHERE u <> v"
_BOTH = f"SELECT graph, u, v FROM ({_UND}) UNION ALL SELECT graph, v, u FROM ({_UND})"
_DEG = f"SELECT graph, u AS node, count(*) AS degree FROM ({_BOTH}) GROUP BY 1, 2"
_NODES = f"SELECT graph, node, node % 3 AS type FROM (SELECT graph, u AS node FROM ({_EDGES}) UNION SELECT graph, v FROM ({_EDGES}))"


def _edges(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("graph"))
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.join(orders, "l_orderkey").select("graph", F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 100).alias("v"))
    return dealt(edges, ["graph"], lines.count())


def _nodes(spark, sf_dir) -> DataFrame:
    e = _edges(spark, sf_dir)
    nodes = e.select("graph", F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.withColumn("type", F.col("node") % 3)


def _types(spark, sf_dir) -> DataFrame:
    """Limits, potentials and chi of node types, from the region table."""
    t = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region").where(t < 3).select(t.alias("type"), (2 + t).alias("limit"), (t * 0.5).alias("potential"), (1.0 + t).alias("chi"))


@query("J1_degrees", _DEG)
def j1(spark, sf_dir):
    return J.degrees(_edges(spark, sf_dir))


@query("J1_degree_sequence", f"SELECT graph, string_agg(degree::VARCHAR, ',' ORDER BY degree) AS sequence FROM ({_DEG}) GROUP BY 1")
def j1b(spark, sf_dir):
    return J.degree_sequence(_edges(spark, sf_dir))


@query(
    "J2_valence_check",
    f"SELECT graph, count(*) FILTER (d > type + 2) = 0 AS ok, count(*) FILTER (d > type + 2) AS n_over, sum(greatest(type + 2 - d, 0))::BIGINT AS free FROM (SELECT n.graph, n.type, coalesce(degree, 0) AS d FROM ({_NODES}) n LEFT JOIN ({_DEG}) USING (graph, node)) GROUP BY 1",
)
def j2(spark, sf_dir):
    return J.valence_check(_nodes(spark, sf_dir), _edges(spark, sf_dir), _types(spark, sf_dir).select("type", "limit"))


@query(
    "J3_components",
    f"""WITH RECURSIVE b AS MATERIALIZED ({_BOTH}), n AS MATERIALIZED ({_NODES}), r AS (SELECT graph, node, node AS root FROM n UNION SELECT r.graph, b.v, r.root FROM r JOIN b ON b.graph = r.graph AND b.u = r.node AND r.root < b.v),
    l AS (SELECT graph, node, min(root) AS label FROM r GROUP BY 1, 2), c AS (SELECT graph, count(*) AS n_nodes, count(DISTINCT label) AS n_components FROM l GROUP BY 1), e AS (SELECT graph, count(*) AS n_edges FROM ({_UND}) GROUP BY 1)
    SELECT c.graph, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components, coalesce(n_edges, 0) - n_nodes + n_components AS cyclomatic FROM c LEFT JOIN e USING (graph)""",
)
def j3(spark, sf_dir):
    return J.components(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query(
    "J4_node_role",
    f"SELECT n.graph, CASE WHEN max(d) IS NULL THEN 'none' WHEN max(d) = 0 THEN 'isolated' WHEN max(d) = 1 THEN 'terminal' WHEN max(d) = 2 THEN 'link' ELSE 'branch' END AS role FROM (SELECT n.graph, CASE WHEN type = 1 THEN coalesce(degree, 0) END AS d FROM ({_NODES}) n LEFT JOIN ({_DEG}) USING (graph, node)) n GROUP BY 1",
)
def j4(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return J.node_role(nodes, _edges(spark, sf_dir), 1)


_DIAG = f"SELECT n.graph, coalesce(degree, 0) AS d, type * 0.5 AS p FROM ({_NODES}) n LEFT JOIN ({_DEG}) USING (graph, node)"


@query("J5_operator_trace", f"SELECT graph, sum(d) AS trace_l, sum(d + p) AS trace_h FROM ({_DIAG}) GROUP BY 1", "trace_l trace_h")
def j5(spark, sf_dir):
    return J.operator_trace(_nodes(spark, sf_dir), _edges(spark, sf_dir), _types(spark, sf_dir).select("type", "potential"))


@query("J6_operator_energy", f"SELECT graph, (sum((d + p) ** 2) + sum(d)) / count(*) AS energy FROM ({_DIAG}) GROUP BY 1", "energy")
def j6(spark, sf_dir):
    return J.operator_energy(_nodes(spark, sf_dir), _edges(spark, sf_dir), _types(spark, sf_dir).select("type", "potential"))


@query(
    "J7_spectral_moments",
    f"""WITH b AS MATERIALIZED ({_BOTH}), n AS (SELECT graph, count(DISTINCT u) AS n, count(*) AS t2 FROM b GROUP BY 1), s AS MATERIALIZED (SELECT x.graph, x.u AS i, y.v AS j, count(*) AS w FROM b x JOIN b y ON x.graph = y.graph AND x.v = y.u GROUP BY 1, 2, 3),
    f AS (SELECT graph, sum(w * w) AS t4 FROM s GROUP BY 1), t AS (SELECT s.graph, sum(w) AS t3 FROM s JOIN b ON b.graph = s.graph AND b.u = s.j AND b.v = s.i GROUP BY 1) SELECT graph, t2 / n AS m2, coalesce(t3, 0) / n AS m3, coalesce(t4, 0) / n AS m4 FROM n LEFT JOIN f USING (graph) LEFT JOIN t USING (graph)""",
    "m2 m3 m4",
)
def j7(spark, sf_dir):
    return J.spectral_moments(_edges(spark, sf_dir))


@query("J8_weighted_edges", f"SELECT graph, u, v, 1.0 + abs(u % 3 - v % 3) AS w FROM ({_UND})", "w")
def j8(spark, sf_dir):
    return J.weighted_edges(_nodes(spark, sf_dir), J.undirected(_edges(spark, sf_dir)), _types(spark, sf_dir).select("type", "chi"), "chi").select("graph", "u", "v", "w")


@query("J9_spectrum")
def j9(spark, sf_dir):
    """Eigenvalues, checked in a test."""
    return J.spectrum(_edges(spark, sf_dir))


@query(
    "J9_spectrum_traces",
    f"SELECT graph, count(*) AS n_nodes, 'ok' AS status, count(*) AS n_values, sum(degree) AS trace, sum(degree * degree + degree) AS trace_sq, sum(degree) AS sum_values, sum(degree * degree + degree) AS sum_squares FROM ({_DEG}) GROUP BY 1",
    "trace trace_sq sum_values sum_squares",
)
def j9b(spark, sf_dir):
    """Sums over the eigenvalues of each graph beside those that the degrees give."""
    x = F.col("value")
    return J.spectrum(_edges(spark, sf_dir)).groupBy("graph", "n_nodes", "status", "trace", "trace_sq").agg(F.count("value").alias("n_values"), F.sum(x).alias("sum_values"), F.sum(x * x).alias("sum_squares"))


def _spec(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph"), F.explode("embedding").alias("value")).select("graph", (F.col("value").cast("double") + 2).alias("value"))


_SPEC = "SELECT vec_id AS graph, unnest(embedding)::DOUBLE + 2 AS value FROM embeddings"


@query(
    "J10_spectrum_gap_trace",
    f"SELECT graph, max(value) FILTER (r = 2) - min(value) AS gap, min(value) FILTER (value > 1e-9::DOUBLE) AS smallest_positive, sum(value) AS trace FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY value) AS r FROM ({_SPEC})) GROUP BY 1",
    "gap smallest_positive trace",
)
def j10(spark, sf_dir):
    return J.spectrum_gap_trace(_spec(spark, sf_dir))


@query(
    "J11_spectrum_entropy",
    f"""SELECT graph, -sum(p * ln(p)) AS entropy, -sum(p * ln(p)) / ln(count(p)) AS entropy_norm, -sum(b / z * ln(b / z)) AS entropy_beta FROM (SELECT *, sum(b) OVER (PARTITION BY graph) AS z FROM (
      SELECT graph, CASE WHEN value > 1e-12::DOUBLE THEN value / sum(CASE WHEN value > 1e-12::DOUBLE THEN value END) OVER (PARTITION BY graph) END AS p, exp(-0.7 * (value - min(value) OVER (PARTITION BY graph))) AS b FROM ({_SPEC}))) GROUP BY 1""",
    "entropy entropy_norm entropy_beta",
)
def j11(spark, sf_dir):
    return J.spectrum_entropy(_spec(spark, sf_dir), 0.7)


@query(
    "J12_spectrum_functionals",
    f"SELECT graph, sum(exp(-0.7 * value)) AS heat_trace, -ln(sum(exp(-0.7 * value))) / 0.7 AS free_energy, sum(ln(value + 5)) AS log_det, sum(value) FILTER (r <= 3) AS lowest_sum FROM (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY value) AS r FROM ({_SPEC})) GROUP BY 1",
    "heat_trace free_energy log_det lowest_sum",
)
def j12(spark, sf_dir):
    return J.spectrum_functionals(_spec(spark, sf_dir), 0.7, 5.0, 3)


_KERNEL = "exp(-0.5 * ((x - value) / 0.1) ** 2) / (0.1 * sqrt(2 * pi()))"
_GRID = f"SELECT i, a + (b - a) * i / 40 AS x FROM (SELECT unnest(range(0, 41))::INTEGER AS i), (SELECT min(value) - 3 * 0.1::DOUBLE AS a, max(value) + 3 * 0.1::DOUBLE AS b FROM ({_SPEC}))"


@query("J13_density_curve", f"SELECT i, any_value(x) AS x, avg({_KERNEL}) AS y FROM ({_GRID}), ({_SPEC}) GROUP BY 1", "x y")
def j13(spark, sf_dir):
    return J.density_curve(_spec(spark, sf_dir), 0.1, 41)


_LOCAL = f"SELECT graph, i, any_value(x) AS x, avg({_KERNEL}) AS y FROM ({_GRID}), ({_SPEC}) GROUP BY 1, 2"


@query(
    "J14_local_density_summary",
    f"SELECT graph, arg_max(x, y) AS peak_x, max(y) AS peak_y, -sum(CASE WHEN p > 0 THEN p * ln(p) END) AS entropy FROM (SELECT *, y / sum(y) OVER (PARTITION BY graph) AS p FROM ({_LOCAL})) GROUP BY 1",
    "peak_x peak_y entropy",
)
def j14(spark, sf_dir):
    return J.local_density_summary(J.density_curve(_spec(spark, sf_dir), 0.1, 41, ["graph"]))


def _curve(spark, sf_dir, steps: int) -> DataFrame:
    """A smooth curve per brand, on a grid of the given number of steps, scaled by the brand's mean price."""
    means = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 1000).alias("m"))
    grid = means.select("p_brand", "m", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    return grid.select("p_brand", "i", (F.col("i") / steps).alias("x"), (F.col("m") * F.sin(3.0 * F.col("i") / steps)).alias("y"))


_MEANS = "SELECT p_brand, avg(p_retailprice) / 1000 AS m FROM part GROUP BY 1"


@query(
    "J15_curve_compare",
    f"SELECT p_brand, max(abs(d)) AS max_abs, max(abs(d) / nullif(abs(y), 0)) AS max_rel, count(*) AS n, max(abs(d)) <= 0.02 AS passed FROM (SELECT p_brand, m * sin(3.0 * i / 20) AS y, m * sin(3.0 * i / 20) * 0.01 * m AS d FROM ({_MEANS}), (SELECT unnest(range(0, 21)) AS i)) GROUP BY 1",
    "max_abs max_rel",
)
def j15(spark, sf_dir):
    base = _curve(spark, sf_dir, 20)
    means = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 1000).alias("m"))
    alt = base.join(means, "p_brand").withColumn("y", F.col("y") * (1 + 0.01 * F.col("m")))
    return J.curve_compare(base, alt, ["p_brand"], "i", "y", 0.02)


@query(
    "J16_grid_noise",
    f"SELECT p_brand, median(abs(d)) AS median_abs, median(abs(d) / nullif(abs(y), 0)) AS median_rel FROM (SELECT p_brand, m * sin(3.0 * i / 20) AS y, m * sin(3.0 * i / 20) * 0.001 * i AS d FROM ({_MEANS}), (SELECT unnest(range(0, 21)) AS i)) GROUP BY 1",
    "median_abs median_rel",
)
def j16(spark, sf_dir):
    fine = _curve(spark, sf_dir, 40).withColumn("y", F.col("y") * (1 + 0.0005 * F.col("i")))
    return J.grid_noise(_curve(spark, sf_dir, 20), fine, ["p_brand"], "i", "y")


@query(
    "J17_method_selector",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.07 AND l_quantity >= 20 AND l_discount * 20 > 1 THEN 'alternative' ELSE 'baseline' END AS method,
       CASE WHEN NOT l_tax < 0.07 THEN 'incorrect' WHEN l_quantity < 20 THEN 'below_threshold' WHEN l_discount * 20 <= 1 THEN 'not_faster' ELSE 'faster' END AS reason FROM lineitem""",
)
def j17(spark, sf_dir):
    method, reason = J.method_selector(F.col("l_tax") < 0.07, F.col("l_quantity"), F.col("l_discount") * 20, 20)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", method.alias("method"), reason.alias("reason"))


@query(
    "J18_run_verdict",
    """SELECT l_suppkey, count(*) AS n, median(l_tax) AS noise, median(l_quantity) AS speed, CASE WHEN NOT bool_and(l_quantity > 0) THEN 'INSTRUMENTATION' WHEN NOT bool_and(l_partkey > 1) THEN 'CORRECTNESS'
       WHEN median(l_tax) > 0.04 THEN 'NUMERICAL' WHEN median(l_quantity) < 25 THEN 'LIMIT' ELSE 'SUCCESS' END AS verdict FROM lineitem GROUP BY 1""",
    "noise speed",
)
def j18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"m": F.col("l_quantity") > 0, "c": F.col("l_partkey") > 1})
    return J.run_verdict(rows, ["l_suppkey"], "m", "c", "l_tax", "l_quantity", 0.04, 25)


_STARS = "SELECT o_orderkey AS graph, l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT l_orderkey, 0, l_suppkey FROM lineitem"


@query(
    "J19_graph_distances",
    f"""WITH RECURSIVE und AS MATERIALIZED (SELECT DISTINCT graph, least(u, v) AS u, greatest(u, v) AS v FROM ({_STARS}) WHERE u <> v), b AS MATERIALIZED (SELECT graph, u, v FROM und UNION ALL SELECT graph, v, u FROM und),
    w AS (SELECT graph, u AS s, v AS t, 1 AS d, [u, v] AS path FROM b UNION ALL SELECT w.graph, w.s, b.v, w.d + 1, list_append(w.path, b.v) FROM w JOIN b ON b.graph = w.graph AND b.u = w.t AND NOT list_contains(w.path, b.v)), m AS (SELECT graph, s, t, min(d) AS d FROM w GROUP BY 1, 2, 3),
    g AS (SELECT graph, u, count(*) AS k FROM b GROUP BY 1, 2) SELECT x.graph, diameter, wiener, leaves, max_degree FROM (SELECT graph, max(d) AS diameter, (sum(d) // 2)::BIGINT AS wiener FROM m GROUP BY 1) x JOIN (SELECT graph, count(*) FILTER (k = 1) AS leaves, max(k) AS max_degree FROM g GROUP BY 1) y ON y.graph = x.graph""",
)
def j19(spark, sf_dir):
    """A tree per order: the order, its suppliers, their parts."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("graph"), F.col("l_suppkey").alias("u"), (1_000_000 + F.col("l_partkey")).alias("v")).unionByName(lines.select(F.col("l_orderkey").alias("graph"), F.lit(0).cast("long").alias("u"), F.col("l_suppkey").alias("v")))
    return J.graph_distances(edges)


@query(
    "J20_heat_features",
    f"SELECT graph, t AS tau, avg(exp(-t * value)) AS mean, var_pop(exp(-t * value)) AS var, min(exp(-t * value)) AS low, max(exp(-t * value)) AS high FROM ({_SPEC}), (SELECT unnest([0.5, 1.0])::DOUBLE AS t) GROUP BY 1, 2",
    "mean var low high",
)
def j20(spark, sf_dir):
    return J.heat_features(_spec(spark, sf_dir), [0.5, 1.0])


@query(
    "J21_graph_shape",
    f"""WITH e AS MATERIALIZED ({_UND}), d AS MATERIALIZED (SELECT graph, node, count(*) AS d FROM (SELECT graph, u AS node FROM e UNION ALL SELECT graph, v FROM e) GROUP BY 1, 2), t AS MATERIALIZED (SELECT a.graph, a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON a.graph = b.graph AND a.v = b.u JOIN e c ON c.graph = a.graph AND c.u = a.u AND c.v = b.v),
    k AS (SELECT graph, node, count(*) AS t FROM (SELECT graph, unnest([x, y, z]) AS node FROM t) GROUP BY 1, 2), r AS (SELECT d.graph, d.d, coalesce(t, 0) AS t, CASE WHEN d.d > 1 THEN 2 * coalesce(t, 0) / (d.d * (d.d - 1)) ELSE 0 END AS c FROM d LEFT JOIN k ON k.graph = d.graph AND k.node = d.node)
    SELECT graph, count(*) AS n, (sum(d) // 2)::BIGINT AS m, sum(d) / (count(*) * (count(*) - 1)) AS density, avg(d) AS mean_degree, var_pop(d) AS var_degree, (sum(t) // 3)::BIGINT AS n_triangles, avg(c) AS mean_clustering, stddev_pop(c) AS std_clustering FROM r GROUP BY 1""",
    "density mean_degree var_degree mean_clustering std_clustering",
)
def j21(spark, sf_dir):
    return J.graph_shape(_edges(spark, sf_dir))
