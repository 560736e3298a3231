"""Features of many graphs and spectra kept as long tables.

Edges are ``(graph, u, v)`` with one row per edge; nodes ``(graph, node, ...)``;
a spectrum is ``(graph, value)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.operators.ordered import running
from gaugeline.sources.files import written


def undirected(edges: DataFrame, by: str = "graph") -> DataFrame:
    """Distinct edges with u < v; loops are left out."""
    return edges.where("u <> v").select(by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def both_ways(edges: DataFrame, by: str = "graph") -> DataFrame:
    return edges.select(by, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select(by, F.col("e.a").alias("u"), F.col("e.b").alias("v"))


def degrees(edges: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, node, degree) of distinct undirected edges."""
    return both_ways(undirected(edges, by), by).groupBy(by, F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def degree_sequence(edges: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, sequence): degrees in ascending order, comma-joined."""
    return degrees(edges, by).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("degree")).cast("array<string>"), ",").alias("sequence"))


def valence_check(nodes: DataFrame, edges: DataFrame, limits: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, ok, n_over, free): whether all degrees keep the limit of their node's type, and the sum of what is left."""
    rows = nodes.join(degrees(edges, by), [by, "node"], "left").join(limits, "type", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    over = F.coalesce(F.col("degree") > F.col("limit"), F.lit(True))
    return rows.groupBy(by).agg((~F.bool_or(over)).alias("ok"), F.count_if(over).alias("n_over"), F.sum(F.greatest(F.col("limit") - F.col("degree"), F.lit(0))).alias("free"))


def _small_components(by: str, rows: int):
    """Component counts of whole graphs, from rows (graph, u, v) sorted by graph, in blocks of about ``rows``; a node is a loop."""

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, names = pd.factorize(pdf[by])
        node = pd.factorize(pd.concat([pdf["u"], pdf["v"]]))[0].astype(np.int64)
        where = np.concatenate([graph, graph]) * (node.max() + 1) + node
        _, first, at = np.unique(where, return_index=True, return_inverse=True)
        u, v = np.split(at, 2)
        label = np.arange(len(first))
        while True:
            low = label.copy()
            np.minimum.at(low, u, label[v])
            np.minimum.at(low, v, label[u])
            low = low[low]
            if np.array_equal(low, label):
                break
            label = low
        owner = np.concatenate([graph, graph])[first]

        def per(of):
            return np.bincount(of, minlength=len(names))

        return pd.DataFrame({by: names, "n_nodes": per(owner), "n_edges": per(graph[u != v]), "n_components": per(owner[label == np.arange(len(label))])})

    def run(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ready = int((held[by] != held[by].iloc[-1]).sum()) if len(held) else 0
            if len(held) >= rows and ready:
                yield counted(held.iloc[:ready])
                held = held.iloc[ready:]
        if held is not None and len(held):
            yield counted(held)

    return run


def components(nodes: DataFrame, edges: DataFrame, by: str = "graph", small: int = 100_000) -> DataFrame:
    """(graph, n_nodes, n_edges, n_components, cyclomatic), by least labels along edges.

    Graphs of up to ``small`` nodes and edges are solved whole, many in a task.
    Larger ones are solved in rounds: each takes the least label of the
    neighbours and then follows the label's own label; it ends when no label
    changes. A round is a written table, and graphs in which nothing changed
    are left out of later ones.
    """
    undir = written(undirected(edges, by), "components")
    rows = undir.unionByName(nodes.select(by, F.col("node").alias("u"), F.col("node").alias("v")).distinct())
    large = written(rows.groupBy(by).agg(F.count("*").alias("n_")).where(F.col("n_") > small).select(by), "components")
    kind = dict(nodes.dtypes)[by]
    few = rows.join(large, by, "left_anti").repartition(by).sortWithinPartitions(by)
    found = few.mapInPandas(_small_components(by, small), f"{by} {kind}, n_nodes long, n_edges long, n_components long")
    if not large.isEmpty():
        found = found.unionByName(_large_components(nodes.join(large, by, "left_semi"), undir.join(large, by, "left_semi"), by))
    return found.withColumn("cyclomatic", F.col("n_edges") - F.col("n_nodes") + F.col("n_components"))


def _large_components(nodes: DataFrame, undir: DataFrame, by: str) -> DataFrame:
    links = both_ways(undir, by)
    labels = nodes.select(by, "node").distinct().withColumn("label", F.col("node"))
    done = None
    while True:
        near = links.join(labels.select(by, F.col("node").alias("v"), "label"), [by, "v"]).groupBy(by, F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [by, "node"], "left").select(by, "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hop = step.select(by, F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(hop, [by, "label"], "left").select(by, "node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = written(step, "components")
        moved = step.where("old <> label").select(by).distinct()
        ready = step.join(moved, by, "left_anti").select(by, "node", "label")
        done = ready if done is None else done.unionByName(ready)
        if moved.isEmpty():
            break
        labels = step.join(moved, by, "left_semi").select(by, "node", "label")
        links = links.join(moved, by, "left_semi")
    found = done.groupBy(by).agg(F.count("*").alias("n_nodes"), F.count_distinct("label").alias("n_components"))
    m = undir.groupBy(by).agg(F.count("*").alias("n_edges"))
    return found.join(m, by, "left").select(by, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_components")


def oriented(edges: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, a, b, da, db) of distinct undirected edges, from the node of lower (degree, node) to the other.

    A node has at most sqrt(2 m) edges that leave it in this order, so paths
    that begin with such an edge stay few however large a hub is.
    """
    links = undirected(edges, by)
    d = degrees(links, by)
    rows = links.join(d.select(by, F.col("node").alias("u"), F.col("degree").alias("du")), [by, "u"]).join(d.select(by, F.col("node").alias("v"), F.col("degree").alias("dv")), [by, "v"])
    one, two = F.struct(F.col("du").alias("d"), F.col("u").alias("n")), F.struct(F.col("dv").alias("d"), F.col("v").alias("n"))
    return rows.select(by, F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(by, F.col("x.n").alias("a"), F.col("y.n").alias("b"), F.col("x.d").alias("da"), F.col("y.d").alias("db"))


def triangles(directed: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, a, b, c), once each, from the edges of :func:`oriented`."""
    one, two = directed.select(by, "a", "b", "db"), directed.select(by, "a", F.col("b").alias("c"), F.col("db").alias("dc"))
    pairs = one.join(two, [by, "a"]).where("db < dc OR (db = dc AND b < c)").select(by, "a", "b", "c")
    return pairs.join(directed.select(by, F.col("a").alias("b"), F.col("b").alias("c")), [by, "b", "c"], "left_semi")


def node_role(nodes: DataFrame, edges: DataFrame, special: str, by: str = "graph") -> DataFrame:
    """(graph, role): isolated, terminal, link or branch, by the largest degree of the special nodes; none without one."""
    rows = nodes.where(F.col("type") == special).join(degrees(edges, by), [by, "node"], "left")
    top = rows.groupBy(by).agg(F.max(F.coalesce("degree", F.lit(0))).alias("d"))
    role = F.when(F.col("d").isNull(), "none").when(F.col("d") == 0, "isolated").when(F.col("d") == 1, "terminal").when(F.col("d") == 2, "link").otherwise("branch")
    return nodes.select(by).distinct().join(top, by, "left").select(by, role.alias("role"))


def operator_trace(nodes: DataFrame, edges: DataFrame, potentials: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, trace_l, trace_h) of the Laplacian, and with node potentials added."""
    rows = nodes.join(degrees(edges, by), [by, "node"], "left").join(potentials, "type", "left")
    return rows.groupBy(by).agg(F.sum(F.coalesce("degree", F.lit(0)).cast("double")).alias("trace_l"), F.sum(F.coalesce("degree", F.lit(0)) + F.coalesce("potential", F.lit(0.0))).alias("trace_h"))


def operator_energy(nodes: DataFrame, edges: DataFrame, potentials: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, energy): mean squared eigenvalue, (sum of squared diagonal + 2 m) / n."""
    rows = nodes.join(degrees(edges, by), [by, "node"], "left").join(potentials, "type", "left")
    diagonal = F.coalesce("degree", F.lit(0)) + F.coalesce("potential", F.lit(0.0))
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(diagonal * diagonal).alias("s"), F.sum(F.coalesce("degree", F.lit(0))).alias("two_m"))
    return per.select(by, ((F.col("s") + F.col("two_m")) / F.col("n")).alias("energy"))


def spectral_moments(edges: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, m2, m3, m4): closed walks of the adjacency matrix over its nodes with an edge.

    tr(A^2) = 2 m; tr(A^3) = 6 triangles; tr(A^4) = 2 (sum of squared degrees)
    - 2 m + 8 four-cycles. A four-cycle is counted at its last node in the order
    of :func:`oriented`, by the node opposite to it, so a hub's paths are not
    listed.
    """
    directed = written(oriented(edges, by), "moments")
    d = directed.select(by, F.explode(F.array("a", "b")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("d"))
    n = d.groupBy(by).agg(F.count("*").alias("n"), F.sum("d").alias("t2"), F.sum(F.col("d") * F.col("d")).alias("s"))
    t3 = triangles(directed, by).groupBy(by).agg(F.count("*").alias("tri"))
    last = directed.select(by, F.col("a").alias("v"), F.col("b").alias("u"), F.col("db").alias("du"))
    out, back = directed.select(by, F.col("a").alias("v"), F.col("b").alias("w"), F.col("db").alias("dw")), directed.select(by, F.col("b").alias("v"), F.col("a").alias("w"), F.col("da").alias("dw"))
    corners = last.join(out.unionByName(back), [by, "v"]).where("dw < du OR (dw = du AND w < u)").groupBy(by, "u", "w").agg(F.count("*").alias("k"))
    four = corners.groupBy(by).agg((F.sum(F.col("k") * (F.col("k") - 1)) / 2).cast("bigint").alias("four"))
    rows = n.join(t3, by, "left").join(four, by, "left").fillna(0, ["tri", "four"])
    t = {2: F.col("t2"), 3: 6 * F.col("tri"), 4: 2 * F.col("s") - F.col("t2") + 8 * F.col("four")}
    return rows.select(by, *((x / F.col("n")).alias(f"m{k}") for k, x in t.items()))


def weighted_edges(nodes: DataFrame, edges: DataFrame, params: DataFrame, mode: str, by: str = "graph", strength: float = 1.0) -> DataFrame:
    """Edges with weight 1, their ``order``, or 1 + strength * |difference of the nodes' chi|."""
    if mode == "unweighted":
        return edges.withColumn("w", F.lit(1.0))
    if mode == "order":
        return edges.withColumn("w", F.col("order").cast("double"))
    chi = nodes.join(params, "type").select(by, "node", "chi")
    rows = edges.join(chi.withColumnsRenamed({"node": "u", "chi": "cu"}), [by, "u"]).join(chi.withColumnsRenamed({"node": "v", "chi": "cv"}), [by, "v"])
    return rows.withColumn("w", 1 + F.lit(strength) * F.abs(F.col("cu") - F.col("cv"))).drop("cu", "cv")


#: Cells of the dense matrices that a task solves at once, or one matrix.
CELLS = 1_000_000


def spectrum(edges: DataFrame, by: str = "graph", max_nodes: int = 3000, weights: bool = False) -> DataFrame:
    """(graph, n_nodes, status, k, value, trace, trace_sq[, first_weight]): eigenvalues of the Laplacian of each graph.

    Graphs are solved as dense matrices, many of a size at once, which bounds
    their size: one
    of more than ``max_nodes`` nodes has a single row with status too_large and
    without a value. The sum of its eigenvalues and of their squares, from the
    degrees, are exact for graphs of any size.
    """
    links = written(undirected(edges, by), "links")
    d = F.col("degree")
    sizes = both_ways(links, by).groupBy(by, "u").agg(F.count("*").alias("degree")).groupBy(by).agg(F.count("*").alias("n_nodes"), F.sum(d).cast("double").alias("trace"), F.sum(d * d + d).cast("double").alias("trace_sq"))
    sizes = written(sizes, "sizes")
    small, large = sizes.where(F.col("n_nodes") <= max_nodes), sizes.where(F.col("n_nodes") > max_nodes)
    kind = dict(edges.dtypes)[by]

    def solved(names: list, at: list, n: int) -> pd.DataFrame:
        """Of graphs of n nodes at once."""
        a = np.zeros((len(at), n, n))
        g = np.repeat(np.arange(len(at)), [len(x) // 2 for x in at])
        i, j = np.concatenate([x[: len(x) // 2] for x in at]), np.concatenate([x[len(x) // 2 :] for x in at])
        a[g, i, j] = a[g, j, i] = -1.0
        a[:, np.arange(n), np.arange(n)] = -a.sum(axis=2)
        values, vectors = np.linalg.eigh(a) if weights else (np.linalg.eigvalsh(a), None)
        out = {by: np.repeat(np.array(names), n), "k": np.tile(np.arange(n), len(at)), "value": values.ravel()}
        if weights:
            out["first_weight"] = (vectors[:, 0] ** 2).ravel()
        return pd.DataFrame(out)

    def run(batches):
        for pdf in batches:
            alike: dict = {}
            for name, u, v in zip(pdf[by], pdf["u"], pdf["v"], strict=True):
                nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                names, held = alike.setdefault(len(nodes), ([], []))
                names.append(name)
                held.append(at)
                if len(held) * len(nodes) ** 2 >= CELLS:
                    yield solved(names, held, len(nodes))
                    del alike[len(nodes)]
            for n, (names, held) in alike.items():
                yield solved(names, held, n)

    more = [("first_weight", "double")] if weights else []
    told = links.join(small.select(by), by, "left_semi").groupBy(by).agg(F.collect_list("u").alias("u"), F.collect_list("v").alias("v"))
    found = told.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in [(by, kind), ("k", "int"), ("value", "double"), *more]))
    rows = found.join(small, by).withColumn("status", F.lit("ok"))
    columns = [by, "n_nodes", "status", "k", "value", "trace", "trace_sq", *(n for n, _ in more)]
    gone = {n: F.lit(None).cast(t) for n, t in [("k", "int"), ("value", "double"), *more]}
    return rows.select(columns).unionByName(large.withColumns({**gone, "status": F.lit("too_large")}).select(columns))


def spectrum_gap_trace(spec: DataFrame, by: str = "graph", value: str = "value", eps: float = 1e-9) -> DataFrame:
    """(graph, gap, smallest_positive, trace): second less first value, least over eps, sum."""
    w = Window.partitionBy(by).orderBy(value)
    rows = spec.withColumn("r_", F.row_number().over(w))
    return rows.groupBy(by).agg((F.max(F.when(F.col("r_") == 2, F.col(value))) - F.min(value)).alias("gap"), F.min(F.when(F.col(value) > eps, F.col(value))).alias("smallest_positive"), F.sum(value).alias("trace"))


def spectrum_entropy(spec: DataFrame, beta: float, by: str = "graph", value: str = "value", eps: float = 1e-12) -> DataFrame:
    """(graph, entropy, entropy_norm, entropy_beta): of normalised positive values, over ln n, and of Boltzmann weights."""
    w = Window.partitionBy(by)
    x = F.when(F.col(value) > eps, F.col(value))
    rows = spec.select(by, (x / F.sum(x).over(w)).alias("p"), F.exp(-F.lit(beta) * (F.col(value) - F.min(value).over(w))).alias("b"))
    rows = rows.withColumn("pb", F.col("b") / F.sum("b").over(w))
    out = rows.groupBy(by).agg(F.coalesce(-F.sum(F.col("p") * F.log("p")), F.lit(0.0)).alias("entropy"), F.count("p").alias("n"), (-F.sum(F.when(F.col("pb") > 0, F.col("pb") * F.log("pb")))).alias("entropy_beta"))
    return out.select(by, "entropy", F.when(F.col("n") > 1, F.col("entropy") / F.log("n")).otherwise(0.0).alias("entropy_norm"), "entropy_beta")


def spectrum_functionals(spec: DataFrame, beta: float, shift: float, k: int, by: str = "graph", value: str = "value") -> DataFrame:
    """(graph, heat_trace, free_energy, log_det, lowest_sum): by log-sum-exp about the least value."""
    w = Window.partitionBy(by)
    rows = spec.select(by, F.col(value).alias("x"), F.min(value).over(w).alias("lo"), F.row_number().over(w.orderBy(value)).alias("r"))
    s = F.sum(F.exp(-F.lit(beta) * (F.col("x") - F.col("lo"))))
    out = rows.groupBy(by, "lo").agg(s.alias("s"), F.sum(F.log(F.col("x") + shift)).alias("log_det"), F.sum(F.when(F.col("r") <= k, F.col("x"))).alias("lowest_sum"))
    return out.select(by, (F.col("s") * F.exp(-F.lit(beta) * F.col("lo"))).alias("heat_trace"), (F.col("lo") - F.log("s") / F.lit(beta)).alias("free_energy"), "log_det", "lowest_sum")


def density_curve(spec: DataFrame, eta: float, points: int, by: Sequence[str] = (), value: str = "value", weight: str | None = None) -> DataFrame:
    """([group,] i, x, y): Gaussian density of all values on a shared grid from the least - 3 eta to the largest + 3 eta.

    Values are summed against the grid in the map tasks; only grid rows are shuffled.
    """
    ends = spec.agg((F.min(value) - 3 * eta).alias("a"), (F.max(value) + 3 * eta).alias("b"))
    mass = F.col(weight) if weight else F.lit(1.0)
    rows = spec.join(F.broadcast(ends)).select(*by, F.col(value).alias("e"), mass.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "a", "b")
    x = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.lit(points - 1)
    z = (F.col("x") - F.col("e")) / F.lit(eta)
    rows = rows.withColumn("x", x).withColumn("k", F.col("m") * F.exp(-0.5 * z * z) / (F.lit(eta) * F.sqrt(2 * F.pi())))
    return rows.groupBy(*by, "i", "x").agg((F.sum("k") / F.sum("m")).alias("y"))


def local_density_summary(curve: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, peak_x, peak_y, entropy) of each curve; the least x wins a tie."""
    p = F.col("y") / F.sum("y").over(Window.partitionBy(by))
    rows = curve.withColumn("p", p)
    best = F.max(F.struct("y", (-F.col("x")).alias("nx")))
    return rows.groupBy(by).agg((-best["nx"]).alias("peak_x"), best["y"].alias("peak_y"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("entropy"))


def curve_compare(base: DataFrame, alt: DataFrame, by: Sequence[str], x: str, y: str, tol: float) -> DataFrame:
    """(group, max_abs, max_rel, passed): largest differences at shared x."""
    rows = base.select(*by, x, F.col(y).alias("a")).join(alt.select(*by, x, F.col(y).alias("b")), [*by, x])
    d = F.abs(F.col("a") - F.col("b"))
    return rows.groupBy(*by).agg(F.max(d).alias("max_abs"), F.max(F.try_divide(d, F.abs("a"))).alias("max_rel"), F.count("*").alias("n")).withColumn("passed", F.col("max_abs") <= tol)


def grid_noise(coarse: DataFrame, fine: DataFrame, by: Sequence[str], i: str, y: str) -> DataFrame:
    """(group, median_abs, median_rel) of a curve against one on a grid of half the step, at even indices."""
    rows = coarse.select(*by, i, F.col(y).alias("a")).join(fine.where(F.col(i) % 2 == 0).select(*by, (F.col(i) / 2).cast("int").alias(i), F.col(y).alias("b")), [*by, i])
    d = F.abs(F.col("a") - F.col("b"))
    return rows.groupBy(*by).agg(F.median(d).alias("median_abs"), F.median(F.try_divide(d, F.abs("a"))).alias("median_rel"))


def method_selector(correct: Column, n: Column, speed: Column, least_n: int) -> tuple[Column, Column]:
    """(method, reason): the alternative only if it is correct, large enough and faster."""
    reason = F.when(~F.coalesce(correct, F.lit(False)), "incorrect").when(n < least_n, "below_threshold").when(F.coalesce(speed, F.lit(0.0)) <= 1, "not_faster").otherwise("faster")
    return F.when(reason == "faster", "alternative").otherwise("baseline"), reason


def run_verdict(df: DataFrame, keys: Sequence[str], measured: str, correct: str, noise: str, speed: str, tol: float, gate: float) -> DataFrame:
    """Verdict of each cohort by order: INSTRUMENTATION, CORRECTNESS, NUMERICAL, LIMIT, SUCCESS."""
    row = df.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.col(measured)).alias("m"), F.bool_and(F.col(correct)).alias("c"), F.median(noise).alias("noise"), F.median(speed).alias("speed"))
    bad = F.lit(False)
    verdict = F.when(~F.coalesce("m", bad), "INSTRUMENTATION").when(~F.coalesce("c", bad), "CORRECTNESS").when(F.coalesce(F.col("noise"), F.lit(0.0)) > tol, "NUMERICAL").when(F.coalesce(F.col("speed"), F.lit(0.0)) < gate, "LIMIT").otherwise("SUCCESS")
    return row.select(*keys, "n", "noise", "speed", verdict.alias("verdict"))


def graph_distances(edges: DataFrame, by: str = "graph", small: int = 2000, tiny: int = 100) -> DataFrame:
    """(graph, diameter, wiener, leaves, max_degree) from the distances of all pairs of nodes that are connected.

    Graphs of up to ``tiny`` edges are one row each and searched from each of
    their nodes in the task that holds them, so no pairs are shuffled or
    written; larger ones see :func:`_listed_distances`. All ways are exact.
    """
    told, tiny = edges.where(F.col(by).isNotNull() & (F.col("u") != F.col("v"))).select(by, "u", "v"), min(tiny, small)
    sizes = told.groupBy(by).agg(F.count("*").alias("n_"))
    if (sizes.agg(F.max("n_")).first()[0] or 0) <= tiny:
        return _searched_distances(told, by)
    few = sizes.where(F.col("n_") <= tiny)
    return _searched_distances(told.join(few, by, "left_semi"), by).unionByName(_listed_distances(told.join(few, by, "left_anti"), by, small))


def _searched_distances(edges: DataFrame, by: str) -> DataFrame:
    """(graph, diameter, wiener, leaves, max_degree) of small graphs, a row with its edges for each."""
    names = ["diameter", "wiener", "leaves", "max_degree"]

    def search(ends: Sequence) -> tuple[int, int, int, int]:
        near: dict = {}
        for u, v in zip(ends[::2], ends[1::2], strict=True):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        far = total = 0
        for start in near:
            seen, ring, d = {start}, [start], 0
            while ring:
                far, total = max(far, d), total + d * len(ring)
                ring = {w for u in ring for w in near[u]} - seen
                seen |= ring
                d += 1
        sizes = [len(n) for n in near.values()]
        return far, total // 2, sizes.count(1), max(sizes)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([search(e.tolist()) for e in pdf["e_"]], columns=names).assign(**{by: pdf[by].to_numpy()})[[by, *names]]

    rows = edges.groupBy(by).agg(F.flatten(F.collect_set(F.array(F.least("u", "v"), F.greatest("u", "v")))).alias("e_"))
    return rows.mapInPandas(run, T.StructType([T.StructField(by, edges.schema[by].dataType), *(T.StructField(n, T.LongType()) for n in names)]))


def _listed_distances(edges: DataFrame, by: str, small: int) -> DataFrame:
    """(graph, diameter, wiener, leaves, max_degree) of graphs of any size.

    Graphs of up to ``small`` edges, and larger ones with a cycle, have their
    pairs listed in rounds; the set of pairs is the square of a graph's size by
    its nature. Larger trees and forests are read off their Euler tours, in time
    n log n: see :func:`_tour_distances`. Both ways are exact.
    """
    links = written(both_ways(undirected(edges, by), by), "links")
    m = links.groupBy(by).agg((F.count("*") / 2).alias("m_"), F.count_distinct("u").alias("n_"))
    large = written(m.where((F.col("m_") > small) & (F.col("m_") < F.col("n_"))).select(by), "large")
    none = large.isEmpty()
    dist = _pair_distances(links if none else links.join(large, by, "left_anti"), by)
    if not none:
        # As many trees as nodes exceed edges; a cycle beside other trees is told by the number of tours.
        trees = links.join(large, by, "left_semi")
        tours = written(_tours(trees, by), "tours")
        sound = tours.groupBy(by).agg(F.count_distinct("tour").alias("t"), (F.count("*") / 2).alias("m")).join(m, by).where("t = n_ - m").select(by)
        dist = dist.unionByName(_tour_distances(tours.join(sound, by, "left_semi"), by))
        dist = dist.unionByName(_pair_distances(trees.join(sound, by, "left_anti"), by))
    deg = degrees(edges, by).groupBy(by).agg(F.count_if(F.col("degree") == 1).alias("leaves"), F.max("degree").alias("max_degree"))
    return dist.join(deg, by)


def _pair_distances(links: DataFrame, by: str) -> DataFrame:
    """(graph, diameter, wiener) from all pairs.

    Distances up to L give those up to 2 L: on a shortest path that is longer
    there is a node at distance L from its start. So rounds, each a written
    table, are the logarithm of the largest diameter.
    """
    reached = written(links.select(by, F.col("u").alias("s"), F.col("v").alias("t")).withColumn("d", F.lit(1)), "distances")
    size = 1
    while True:
        edge = reached.where(F.col("d") == size).select(by, "s", F.col("t").alias("m"))
        step = edge.join(reached.select(by, F.col("s").alias("m"), "t", (F.col("d") + size).alias("d")), [by, "m"]).where("s <> t")
        step = step.join(reached.select(by, "s", "t"), [by, "s", "t"], "left_anti").groupBy(by, "s", "t").agg(F.min("d").alias("d"))
        step = written(step, "distances")
        if step.isEmpty():
            break
        reached, size = reached.unionByName(step), 2 * size
    return reached.groupBy(by).agg(F.max("d").cast("bigint").alias("diameter"), (F.sum("d") / 2).cast("bigint").alias("wiener"))


def _tours(links: DataFrame, by: str) -> DataFrame:
    """(graph, tour, u, v, id, back, at, length): the arcs of each Euler tour with their place in it and the arc that leads back.

    The arc after u -> v goes from v to its next neighbour after u, round and
    round, so a tree has one tour and a connected graph with cycles has one or
    more. Places come from pointer jumping: in round k each arc knows the least
    arc among the next 2**k and how far it is. Neighbours are numbered by
    ranges, so a hub is no single task.
    """
    arcs = running(links, [by, "u"], ["v"], {"k": F.lit(1)}, totals=True).withColumnRenamed("k_all", "deg").withColumn("id", F.monotonically_increasing_id())
    arcs = written(arcs, "arcs")
    back = arcs.select(by, F.col("u").alias("v"), F.col("v").alias("u"), F.col("id").alias("back"), ((F.col("k") + 1) % F.col("deg")).alias("k_"))
    arcs = arcs.select(by, "u", "v", "id").join(back, [by, "u", "v"]).join(arcs.select(by, F.col("u").alias("v"), F.col("k").alias("k_"), F.col("id").alias("next")), [by, "v", "k_"]).drop("k_")
    arcs = written(arcs, "arcs")
    found = arcs.select("id", "next", F.struct(F.col("id").alias("tour"), F.lit(0).cast("long").alias("off")).alias("best"))
    span, most = 1, arcs.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while span < most:
        ahead = found.select(F.col("id").alias("next"), F.col("next").alias("far"), F.struct(F.col("best.tour").alias("tour"), (F.col("best.off") + span).alias("off")).alias("other"))
        found = written(found.join(ahead, "next").select("id", F.col("far").alias("next"), F.least("best", "other").alias("best")), "tour")
        span *= 2
    found = found.select("id", "best.tour", "best.off")
    length = found.groupBy("tour").agg(F.count("*").alias("length"))
    rows = arcs.drop("next").join(found, "id").join(length, "tour")
    return rows.withColumn("at", F.pmod(-F.col("off"), F.col("length"))).drop("off")


def _tour_distances(tours: DataFrame, by: str) -> DataFrame:
    """(graph, diameter, wiener) of forests from their Euler tours.

    The arc that comes first leads down, and between it and the arc back lie the
    arcs below: so sizes of subtrees give the Wiener index, each edge with the
    pairs it parts. Depth is a running sum. From the deepest node the distance
    to another is told by the least depth between the two on the tour, a running
    minimum to either side, and the greatest is the diameter.
    """
    both = tours.join(tours.select(F.col("id").alias("back"), F.col("at").alias("to")), "back").withColumn("down", F.col("at") < F.col("to"))
    both = running(both, [by, "tour"], ["at"], {"depth": F.when(F.col("down"), 1).otherwise(-1)})
    rows = written(both.select(by, "tour", "at", "to", "length", "down", (F.col("depth") + F.when(F.col("down"), 1).otherwise(-1)).alias("depth")), "depths")
    size, whole = F.expr("(to - at + 1) div 2"), F.expr("length div 2 + 1")
    wiener = rows.where("down").groupBy(by).agg(F.sum(size * (whole - size)).alias("wiener"))
    deep = rows.groupBy(by, "tour").agg(F.max(F.struct(F.col("depth").alias("d"), (-F.col("at")).alias("at"))).alias("a")).select(by, "tour", F.col("a.d").alias("d_a"), (-F.col("a.at")).alias("a"))
    far = rows.join(deep, [by, "tour"])
    sides = F.when(F.col("at") == F.col("a"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("at") > F.col("a")).cast("int")))
    far = far.select(by, "tour", "depth", "d_a", F.abs(F.col("at") - F.col("a")).alias("away"), F.explode(sides).alias("side"))
    far = running(far, [by, "tour", "side"], ["away"], maxima={"least": -F.col("depth")})
    least = -F.greatest(F.coalesce("least", -F.col("depth")), -F.col("depth"))
    diameter = far.groupBy(by).agg(F.max(F.greatest(F.col("d_a"), F.col("d_a") + F.col("depth") - 2 * least)).cast("bigint").alias("diameter"))
    return diameter.join(wiener, by).select(by, "diameter", "wiener")


def heat_features(spec: DataFrame, taus: Sequence[float], by: str = "graph", value: str = "value") -> DataFrame:
    """(graph, tau, mean, var, low, high) of exp(-tau value) over a spectrum."""
    rows = spec.select(by, value, F.explode(F.array(*(F.lit(float(t)) for t in taus))).alias("tau"))
    h = F.exp(-F.col("tau") * F.col(value))
    return rows.groupBy(by, "tau").agg(F.avg(h).alias("mean"), F.var_pop(h).alias("var"), F.min(h).alias("low"), F.max(h).alias("high"))


def graph_shape(edges: DataFrame, by: str = "graph") -> DataFrame:
    """(graph, n, m, density, mean_degree, var_degree, n_triangles, mean_clustering, std_clustering).

    Triangles are found from the two edges that leave their lowest node (see
    :func:`oriented`) and a look-up of the third.
    """
    directed = written(oriented(edges, by), "shape")
    corner = triangles(directed, by).select(by, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("t"))
    degree = directed.select(by, F.explode(F.array("a", "b")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("degree"))
    rows = degree.join(corner, [by, "node"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    d = F.col("degree")
    rows = rows.withColumn("c", F.when(d > 1, 2 * F.col("t") / (d * (d - 1))).otherwise(0.0))
    out = rows.groupBy(by).agg(F.count("*").alias("n"), (F.sum("degree") / 2).cast("bigint").alias("m"), F.avg("degree").alias("mean_degree"), F.var_pop("degree").alias("var_degree"), (F.sum("t") / 3).cast("bigint").alias("n_triangles"), F.avg("c").alias("mean_clustering"), F.stddev_pop("c").alias("std_clustering"))
    return out.select(by, "n", "m", F.coalesce(F.try_divide(2.0 * F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"), "mean_degree", "var_degree", "n_triangles", "mean_clustering", "std_clustering")


def complexity_score(shape: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Add score: the weighted sum of the named shape columns."""
    return shape.withColumn("score", sum((F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)))
