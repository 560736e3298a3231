"""Comparison of distributions and diagnostics of chains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.scalars import log_ratio
from gaugeline.operators.joins import union_support
from gaugeline.operators.ordered import numbered
from gaugeline.operators.stats import to_distribution
from gaugeline.operators.windows import autocorrelation, cumulative_unique, placed, split_half
from gaugeline.sources.files import written


def _terms(rule: str, eps: float) -> tuple[Column, Column]:
    p, q = F.col("p"), F.col("q")
    if rule == "floor":
        p, q = F.greatest(p, F.lit(eps)), F.greatest(q, F.lit(eps))
    elif rule == "support":
        q = q + eps
    return p, q


def kl(p: DataFrame, q: DataFrame, by: Sequence[str], key: str, rule: str = "add", eps: float = 1e-12) -> DataFrame:
    """(group, kl) of p against q by one of three smoothing rules.

    ``add`` adds eps to both on the joint support and normalises again;
    ``floor`` raises both to eps; ``support`` sums over the support of p, with
    eps added to q.
    """
    rows = union_support(p, q, by, key)
    if rule == "add":
        n = F.count("*").over(Window.partitionBy(*by)) if by else F.lit(None)
        if not by:
            rows = rows.join(F.broadcast(rows.agg(F.count("*").alias("k_"))))
            n = F.col("k_")
        rows = rows.select(*by, ((F.col("p") + eps) / (1 + n * eps)).alias("p"), ((F.col("q") + eps) / (1 + n * eps)).alias("q"))
    a, b = _terms(rule, eps)
    return rows.groupBy(*by).agg(F.sum(F.when(F.col("p") > 0, a * F.log(a / b)).otherwise(a * F.log(a / b) if rule == "floor" else 0.0)).alias("kl"))


def symmetric_kl(p: DataFrame, q: DataFrame, by: Sequence[str], key: str, rule: str = "add", eps: float = 1e-12) -> DataFrame:
    """Mean of both directions."""
    one = kl(p, q, by, key, rule, eps).withColumnRenamed("kl", "pq")
    two = kl(q, p, by, key, rule, eps).withColumnRenamed("kl", "qp")
    both = one.join(two, list(by)) if by else one.join(F.broadcast(two))
    return both.select(*by, "pq", "qp", ((F.col("pq") + F.col("qp")) / 2).alias("kl"))


#: Pairs of chains by their shared keys up to which they are listed, and chains and cells of a block beyond.
SHARED, CHAINS, CELLS = 20_000_000, 1 << 14, 4_000_000
#: Chains of a block that are compared together, and cells of the tables of keys that many chains have.
STRIP, TABLES = 512, 1 << 24


def _block_most(rows: pa.Table) -> pa.Table:
    """(d): the largest f + g - s of a chain of block i (those of ``own``) and one of block j; s adds up v times v over shared keys."""
    own = rows["own"].to_numpy()

    def side(at: np.ndarray):
        part = rows.filter(pa.array(at))
        x, v = part["x"].combine_chunks(), part["v"].combine_chunks()
        row = np.repeat(np.arange(len(part)), x.value_lengths().to_numpy().astype(np.int64))
        return part["t"].to_numpy(), row, x.flatten().to_numpy(), v.flatten().to_numpy()

    (f, ra, xa, va), (g, rb, xb, vb) = side(own), side(~own)
    if not len(f) or not len(g):
        return pa.table({"d": pa.array([], pa.float64())})
    keys = np.union1d(xa, xb)
    xa, xb = np.searchsorted(keys, xa), np.searchsorted(keys, xb)
    work = np.bincount(xa, minlength=len(keys)) * np.bincount(xb, minlength=len(keys))
    # Keys that many chains of both have are columns of a product, the others are taken cell by cell.
    wide = np.argsort(-work, kind="stable")[: max(1, TABLES // (len(f) + len(g)))]
    wide = wide[50 * work[wide] >= len(f) * len(g)]
    column = np.full(len(keys), -1)
    column[wide] = np.arange(len(wide))

    def split(row: np.ndarray, x: np.ndarray, v: np.ndarray, n: int, by: int):
        table = np.zeros((n, len(wide)))
        at = column[x] >= 0
        table[row[at], column[x[at]]] = v[at]
        at = ~at & (work[x] > 0)
        row, x, v = row[at], x[at], v[at]
        order = np.argsort((row, x)[by], kind="stable")
        return table, row[order], x[order], v[order]

    a, ra, xa, va = split(ra, xa, va, len(f), 0)
    b, rb, xb, vb = split(rb, xb, vb, len(g), 1)
    low, high = np.searchsorted(xb, xa), np.searchsorted(xb, xa, "right")
    best = -np.inf
    for at in range(0, len(f), STRIP):
        d = g - a[at : at + STRIP] @ b.T
        d += f[at : at + STRIP, None]
        for k in range(*np.searchsorted(ra, (at, at + STRIP))):
            d[ra[k] - at, rb[low[k] : high[k]]] -= va[k] * vb[low[k] : high[k]]
        best = max(best, float(d.max()))
    return pa.table({"d": [best]})


def _largest_kl(gain: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """(d): the largest divergences of blocks of chains, of gain(c, x, da, lb) and own(c, f, g) with n chains.

    Each two blocks meet in a task, which keeps one number; what is shuffled is
    each chain once for each block. A chain also meets itself, with 0, which no
    two chains are under.
    """
    keys = numbered(gain.select("x").distinct(), ["x"]).select("x", F.col("r_").alias("no"))
    cells = written(gain.join(keys, "x").groupBy("c").agg(F.collect_list(F.struct("no", "da", "lb")).alias("v")).join(own, "c"), "chains")
    mass = cells.agg(F.sum(F.size("v"))).first()[0]
    parts = max(-(-n // CHAINS), -(-mass // CELLS))
    block, each = F.pmod(F.xxhash64("c"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = cells.select(block.cast("int").alias("i"), each.alias("j"), F.lit(True).alias("own"), F.col("f").alias("t"), F.col("v.no").alias("x"), F.col("v.da").alias("v"))
    two = cells.select(each.alias("i"), block.cast("int").alias("j"), F.lit(False).alias("own"), F.col("g").alias("t"), F.col("v.no").alias("x"), F.col("v.lb").alias("v"))
    return one.unionByName(two).repartition(min(parts * parts, 10_000), "i", "j").groupBy("i", "j").applyInArrow(_block_most, "d double")


def pairwise_kl(df: DataFrame, chain: str, key: str, eps: float = 1e-12) -> DataFrame:
    """One row: largest and mean KL over ordered pairs of chains, with eps added on the support of all chains.

    Absent keys all have the same smoothed probability, so a pair's divergence
    is a term of its first chain, a term of its second, and a correction over
    the keys that both have. The mean needs sums by chain and by key only. For
    the largest, chains that share keys meet by key; of those that share none,
    a chain needs only the largest other terms, one more than it has partners.
    With more than SHARED pairs by key, chains are dealt into blocks instead,
    each two of which meet in a task as tables of numbers, so no pair is a row.
    Chains of one distribution, told by two 64-bit digests of its keys and
    probabilities, meet the others once; between them the divergence is 0.
    """
    dist = to_distribution(df, [chain], key)
    n_keys = df.select(key).distinct().agg(F.count("*").alias("n_keys_"))
    k, e, le = F.col("k"), F.col("e"), F.log("e")
    rows = dist.join(F.broadcast(n_keys)).select(F.col(chain).alias("c"), F.col(key).alias("x"), ((F.col("p") + eps) / (1 + F.col("n_keys_") * eps)).alias("p"), F.col("n_keys_").alias("k"), (F.lit(eps) / (1 + F.col("n_keys_") * eps)).alias("e"))
    rows = written(rows, "kl")
    digests = [F.bit_xor(F.xxhash64("x", "p", F.lit(n))).alias(f"d{n}") for n in (1, 2)]
    own = rows.groupBy("c", "k", "e").agg(*digests, F.sum(F.col("p") * F.log("p")).alias("h"), F.sum(F.log("p")).alias("lp"), F.count("*").alias("n"), F.sum("p").alias("mass"))
    # Of a pair without shared keys the divergence is f of the first and g of the second.
    f = F.col("h") - F.col("mass") * le
    g = -e * (F.col("lp") - F.col("n") * le)
    own = written(own.select("c", "n", "d1", "d2", f.alias("f"), g.alias("g")), "kl")
    # Over shared keys: sum of (pa - e) (ln pb - ln e).
    gain = rows.withColumns({"da": F.col("p") - e, "lb": F.log("p") - le})
    per = gain.groupBy("x").agg((F.sum("da") * F.sum("lb") - F.sum(F.col("da") * F.col("lb"))).alias("s"))
    parts = own.agg(F.count("*").alias("m"), (F.sum("f") + F.sum("g")).alias("t")).join(F.broadcast(per.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))))
    mean = parts.select(F.when(F.col("m") > 1, (F.col("t") * (F.col("m") - 1) - F.col("s")) / (F.col("m") * (F.col("m") - 1))).alias("kl_mean"))
    classes = written(own.groupBy("n", "d1", "d2").agg(F.min_by(F.struct("c", "f", "g"), "c").alias("r"), F.count("*").alias("size")), "kl")
    copies = classes.where("size > 1").agg(F.max(F.lit(0.0)).alias("d"))
    own = classes.select("r.*")
    gain = gain.join(own.select("c"), "c", "left_semi")
    n, pairs = own.count(), gain.groupBy("x").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if n > 1 and pairs > SHARED:
        return _largest_kl(gain, own, n).unionByName(copies).agg(F.max("d").alias("kl_max")).join(F.broadcast(mean))
    one, two = gain.select(F.col("c").alias("a"), "x", "da"), gain.select(F.col("c").alias("b"), "x", "lb")
    shared = one.join(two, "x").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("da") * F.col("lb")).alias("s"))
    shared = written(shared, "kl")
    near = shared.join(own.select(F.col("c").alias("a"), "f"), "a").join(own.select(F.col("c").alias("b"), "g"), "b")
    near = near.agg(F.max(F.col("f") + F.col("g") - F.col("s")).alias("d"))
    order = numbered(own.withColumn("down", -F.col("g")), ["down", "c"]).select(F.col("c").alias("b"), "g", F.col("r_").alias("r"))
    partners = shared.groupBy("a").agg(F.count("*").alias("n"))
    asked = own.select(F.col("c").alias("a"), "f").join(partners, "a", "left").select("a", "f", F.explode(F.expr("sequence(1L, coalesce(n, 0L) + 2L)")).alias("r"))
    far = asked.join(order, "r").where("a <> b").join(shared.select("a", "b"), ["a", "b"], "left_anti").agg(F.max(F.col("f") + F.col("g")).alias("d"))
    return near.unionByName(far).unionByName(copies).agg(F.max("d").alias("kl_max")).join(F.broadcast(mean))


def split_half_kl(df: DataFrame, by: str, order: Sequence[str], key: str, eps: float = 1e-12) -> DataFrame:
    """(group, kl) of the first half of a sequence against the second; null for under four rows."""
    halves = split_half(df, [by], order)
    one, two = (to_distribution(halves.where(F.col("half") == k), [by], key) for k in (1, 2))
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.join(kl(one, two, [by], key, "add", eps), by, "left").select(by, F.when(F.col("n") >= 4, F.col("kl")).alias("kl"))


def rhat(df: DataFrame, chain: str, order: Sequence[str], x: str, by: Sequence[str] = (), degenerate: float | None = None) -> DataFrame:
    """Gelman-Rubin statistic over chains cut to the shortest one; ``degenerate`` where it is undefined."""
    sizes = df.groupBy(*by, chain).agg(F.count("*").alias("n_")).groupBy(*by).agg(F.min("n_").alias("n"), F.count("*").alias("m"))
    rows = placed(df, [*by, chain], order)
    rows = (rows.join(sizes, list(by)) if by else rows.join(F.broadcast(sizes))).where("i_ < n")
    per = rows.groupBy(*by, chain, "n", "m").agg(F.avg(x).alias("mean_"), F.var_samp(x).alias("var_"))
    out = per.groupBy(*by, "n", "m").agg(F.avg("var_").alias("w"), F.var_samp("mean_").alias("b"))
    value = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    sound = (F.col("n") >= 2) & (F.col("m") >= 2) & (F.col("w") > 0)
    return out.select(*by, "n", "m", F.when(sound, value).otherwise(F.lit(degenerate)).alias("rhat"))


def ess_initial_positive(df: DataFrame, by: str, order: Sequence[str], x: str, max_lag: int) -> DataFrame:
    """(group, ess): n / (1 + 2 sum of rho), up to the first rho of 0 or less, within max_lag."""
    rho = autocorrelation(df, by, order, x, max_lag)
    w = Window.partitionBy(by).orderBy("lag")
    used = rho.withColumn("least", F.min("rho").over(w)).where("least > 0").groupBy(by).agg(F.sum("rho").alias("s"))
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.join(used, by, "left").select(by, (F.col("n") / (1 + 2 * F.coalesce("s", F.lit(0.0)))).alias("ess"))


def ess_ar1(n: Column, rho1: Column) -> Column:
    """n (1 - rho) / (1 + rho), held between 1 and n."""
    return F.greatest(F.lit(1.0), F.least(n.cast("double"), F.coalesce(F.try_divide(n * (1 - rho1), 1 + rho1), n.cast("double"))))


def mixing_report(df: DataFrame, chain: str, order: Sequence[str], key: str, x: str, max_lag: int, bins: int, eps: float = 1e-12) -> DataFrame:
    """One row: KL between chains, largest split-half KL, R-hat, least effective size, least final number of keys seen.

    The chains are put in order once, by ranges, and written with their places.
    """
    df = written(placed(df.select(chain, *order, *{key, x} - {chain, *order}), [chain], order, x), "chains")
    parts = [
        pairwise_kl(df, chain, key, eps),
        split_half_kl(df, chain, order, key, eps).agg(F.max("kl").alias("split_kl_max")),
        rhat(df, chain, order, x).select("rhat"),
        ess_initial_positive(df, chain, order, x, max_lag).agg(F.min("ess").alias("ess_min")),
        cumulative_unique(df, chain, order, key, bins).where(F.col("bin") == bins).agg(F.min("n_unique").alias("min_unique")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def weighted_softmax(df: DataFrame, by: Sequence[str], g: str, e: str, lam: Column | float, temperature: float = 1.0) -> DataFrame:
    """Add p, in proportion to g exp(-lam e / T) within a group; T of 0 or less puts it on the least e, shared by g."""
    w = Window.partitionBy(*by)
    low = F.min(F.when(F.col(g) > 0, F.col(e))).over(w)
    if temperature <= 0:
        mass = F.when(F.col(e) == low, F.col(g)).otherwise(0.0)
    else:
        mass = F.col(g) * F.exp(-(lam if isinstance(lam, Column) else F.lit(float(lam))) * (F.col(e) - low) / F.lit(float(temperature)))
    return df.withColumn("m_", mass).withColumn("p", F.try_divide("m_", F.sum("m_").over(w))).drop("m_")


def fit_temperature(df: DataFrame, obs: str, g: str, e: str, low: float = 0.0, high: float = 10.0, steps: int = 401, fine: int = 201) -> DataFrame:
    """One row (lam, kl): the lam of a grid, then of a finer one about the best, with least KL of obs against the softmax.

    Sums by lam are taken in the map tasks, so what is shuffled is the grid.
    """
    rows = df.select(F.col(obs).cast("double").alias("o"), F.col(g).cast("double").alias("g"), F.col(e).cast("double").alias("e"))
    least = F.broadcast(rows.where("g > 0").agg(F.min("e").alias("lo")))

    def best(a: float, b: float, n: int):
        grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(a) + i * F.lit((b - a) / (n - 1)))).alias("lam")
        terms = rows.join(least).select("o", "g", (F.col("e") - F.col("lo")).alias("x"), grid).withColumn("m", F.col("g") * F.exp(-F.col("lam") * F.col("x")))
        mass = terms.groupBy("lam").agg(F.sum("m").alias("z"))
        p = F.greatest(F.try_divide("m", F.col("z")), F.lit(1e-300))
        cost = terms.where("o > 0").join(F.broadcast(mass), "lam").groupBy("lam").agg(F.sum(F.col("o") * F.log(F.col("o") / p)).alias("kl"))
        return cost.agg(F.min(F.struct("kl", "lam")).alias("b")).select(F.col("b.lam").alias("lam"), F.col("b.kl").alias("kl"))

    first = best(low, high, steps).first()
    if first.lam is None:
        return best(low, high, steps)
    step = (high - low) / (steps - 1)
    return best(max(low, first.lam - step), min(high, first.lam + step), fine)


def bias_vector(df: DataFrame, key: str, p: str, q: str, k: int, eps: float = 1e-12) -> DataFrame:
    """The k states with the largest absolute log ratio of p to q."""
    rows = df.select(key, log_ratio(F.col(p), F.col(q), eps).alias("log_ratio"))
    return rows.orderBy(F.desc(F.abs("log_ratio")), key).limit(k)


def task_board(tasks: DataFrame, submissions: DataFrame, setting: str, task: str, digest: str) -> DataFrame:
    """Per setting: tasks ready and in all, missing ids, and tasks with two submissions of different digests."""
    done = submissions.groupBy(task).agg(F.count("*").alias("n_"), F.count_distinct(digest).alias("d_"))
    rows = tasks.join(done, task, "left")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_").isNull(), F.col(task).cast("string")))), ",")
    return rows.groupBy(setting).agg(F.count("n_").alias("n_ready"), F.count("*").alias("n_total"), missing.alias("missing"), F.count_if(F.col("d_") > 1).alias("n_mismatch")).withColumn("complete", F.col("n_ready") == F.col("n_total"))


def merge_runs(df: DataFrame, setting: str, chain: str, order: Sequence[str], x: str, key: str, expected_chains: int, expected_keys: int) -> DataFrame:
    """Per complete setting: R-hat, distinct keys and their coverage, mean value; settings with a chain missing are left out."""
    full = df.groupBy(setting).agg(F.count_distinct(chain).alias("c")).where(F.col("c") >= expected_chains).select(setting)
    rows = df.join(full, setting, "left_semi")
    stats = rows.groupBy(setting).agg(F.count_distinct(key).alias("n_unique"), F.avg(x).alias("mean_x"), F.count("*").alias("n_rows"))
    stats = stats.withColumn("coverage", F.col("n_unique") / F.lit(float(expected_keys)))
    return stats.join(rhat(rows, chain, order, x, [setting]).select(setting, "rhat"), setting, "left")


def convergence_compare(p: DataFrame, q: DataFrame, by: Sequence[str], key: str, eps: float = 1e-12) -> DataFrame:
    """Both KL directions and the share of q's mass on keys that p has seen, per group."""
    both = symmetric_kl(p, q, by, key, "add", eps).select(*by, F.col("pq").alias("kl_pq"), F.col("qp").alias("kl_qp"))
    seen = union_support(p, q, by, key).groupBy(*by).agg(F.sum(F.when(F.col("p") > 0, F.col("q")).otherwise(0.0)).alias("mass_seen"))
    return both.join(seen, list(by)) if by else both.join(F.broadcast(seen))


def mean_distribution(df: DataFrame, chain: str, key: str) -> DataFrame:
    """Mean of the chains' probabilities, absent keys as 0, normalised."""
    dist = to_distribution(df, [chain], key)
    n = df.agg(F.count_distinct(chain).alias("n_chains"))
    mean = dist.groupBy(key).agg(F.sum("p").alias("s")).join(F.broadcast(n)).select(key, (F.col("s") / F.col("n_chains")).alias("m"))
    total = mean.agg(F.sum("m").alias("t"))
    return mean.join(F.broadcast(total)).select(key, (F.col("m") / F.col("t")).alias("p"))
