"""Joins: enrichment, truth, nearest values, pairs, tolerances, grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.ordered import dealt, numbered, ranged, running
from gaugeline.sources.files import written


def enrich_left(base: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str], str]], fill: Mapping[str, str] | None = None) -> DataFrame:
    """Left joins with each (table, keys, suffix); clashing columns get the suffix.

    ``fill`` names columns that take another column's value where they are null.
    """
    for dim, keys, suffix in dims:
        clash = {c: f"{c}{suffix}" for c in dim.columns if c in base.columns and c not in keys}
        base = base.join(dim.withColumnsRenamed(clash), list(keys), "left")
    for column, other in (fill or {}).items():
        base = base.withColumn(column, F.coalesce(column, other))
    return base


def join_reference(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a reference value, with it."""
    return df.join(reference, list(keys), "inner")


def compare_cohorts(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer join of two summaries: old, new and difference of each column."""
    a = old.select(key, *(F.col(c).alias(f"{c}_old") for c in columns))
    b = new.select(key, *(F.col(c).alias(f"{c}_new") for c in columns))
    return a.join(b, key, "full_outer").select("*", *((F.col(f"{c}_new") - F.col(f"{c}_old")).alias(f"{c}_delta") for c in columns))


def with_truth(items: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Items with has_truth; items without are the unknown bucket."""
    known = truth.select(key).distinct().withColumn("has_truth", F.lit(True))
    return items.join(known, key, "left").withColumn("has_truth", F.coalesce("has_truth", F.lit(False)))


def pending_items(items: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Items whose key is not done yet."""
    return items if overwrite else items.join(done.select(key), key, "left_anti")


def missing_scores(candidates: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Candidates that have no score."""
    return candidates.join(scores.where("score IS NOT NULL").select(key), key, "left_anti")


def replace_rows(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The base without patched keys, and the patch."""
    return base.join(patch.select(key), key, "left_anti").unionByName(patch, allowMissingColumns=True)


def nearest_join(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """Nearest of a short list of points and the signed distance; the lower point wins a tie."""
    near = F.array_min(F.transform(F.array(*(F.lit(float(p)) for p in sorted(points))), lambda p: F.struct(F.abs(F.col(value) - p).alias("d"), p.alias("p"))))["p"]
    return df.withColumn("nearest", near).withColumn("distance", F.col(value) - F.col("nearest"))


def nearest_join_large(df: DataFrame, value: str, points: DataFrame, point: str) -> DataFrame:
    """Nearest point of a table of any size and the signed distance; the lower point wins a tie.

    Points and distinct values are dealt into ranges of one order. The points
    next to a value lie in its own range, or are the last before or the first
    behind it, which as many rows as there are ranges tell. Nothing else is
    broadcast. Null values keep nulls, and so do all if there is no point.
    """
    marks = points.where(F.col(point).isNotNull()).select(F.col(point).cast("double").alias("x_"), F.col(point).cast("double").alias("p_")).distinct()
    asked = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x_"), F.lit(None).cast("double").alias("p_")).distinct()
    rows = ranged(marks.unionByName(asked), ["x_"])
    ends = rows.groupBy("part_").agg(F.min("p_").alias("a_"), F.max("p_").alias("b_"))
    w = Window.orderBy("part_")
    ends = ends.select("part_", F.max("b_").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("below_"), F.min("a_").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("above_"))
    # Both run from an end to the value: a frame that reaches on to the last row is reckoned anew for each row.
    up, down = (Window.partitionBy("part_").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("x_"), F.desc("x_")))
    low, high = F.max("p_").over(up), F.min("p_").over(down)
    near = rows.withColumns({"low_": low, "high_": high}).where("p_ IS NULL").join(F.broadcast(ends), "part_")
    low, high = F.coalesce("low_", "below_"), F.coalesce("high_", "above_")
    best = F.when(low.isNull(), high).when(high.isNull() | (F.col("x_") - low <= high - F.col("x_")), low).otherwise(high)
    found = near.select("x_", best.alias("nearest")).repartition("x_")
    return df.withColumn("x_", F.col(value).cast("double")).join(found, "x_", "left").withColumn("distance", F.col(value) - F.col("nearest")).drop("x_")


def within_group_pairs(df: DataFrame, group: str, key: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of a group with key_a < key_b.

    The result is the square of a group's size by its nature; skewed groups are
    split by adaptive execution, and no pair is left out.
    """
    a = df.select(group, F.col(key).alias(f"{key}_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = df.select(group, F.col(key).alias(f"{key}_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, group).where(F.col(f"{key}_a") < F.col(f"{key}_b"))


def tolerance_join(df: DataFrame, key: str, value: str, tol: float, columns: Sequence[str] = (), relative: bool = False) -> DataFrame:
    """Pairs key_a < key_b with abs(value_a - value_b) <= tol; with ``relative``, tol is scaled by max(1, abs values).

    An equi join on cells as wide as the tolerance. Relative cells lie on a
    logarithmic scale, on which a tolerance has the same width everywhere.
    """
    if relative:
        size = F.asinh(F.col(value))
        cell = F.floor(size / F.lit(2.0 * tol))
    else:
        cell = F.floor(F.col(value) / F.lit(tol))
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("x"), cell.alias("c"), *columns)
    a = rows.select(F.col("k").alias(f"{key}_a"), F.col("x").alias(f"{value}_a"), "c", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = rows.select(F.col("k").alias(f"{key}_b"), F.col("x").alias(f"{value}_b"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), *(F.col(c).alias(f"{c}_b") for c in columns))
    gap = F.abs(F.col(f"{value}_a") - F.col(f"{value}_b"))
    limit = F.greatest(F.lit(1.0), F.abs(f"{value}_a"), F.abs(f"{value}_b")) * tol if relative else F.lit(tol)
    return a.join(b, "c").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (gap <= limit)).drop("c")


def _reach(tol: float):
    """The greatest double b with b - a <= tol, by halving the doubles from a on."""

    @F.pandas_udf("double")
    def reach(values: pd.Series) -> pd.Series:
        flip = np.int64(2**63 - 1)
        a = values.to_numpy(np.float64) + 0.0
        low = a.view(np.int64)
        low = low ^ ((low >> 63) & flip)  # in the order of the doubles
        high = np.full(len(a), np.float64(np.inf)).view(np.int64)
        for _ in range(64):
            mid = (low & high) + ((low ^ high) >> 1)
            with np.errstate(over="ignore", invalid="ignore"):
                fits = (mid ^ ((mid >> 63) & flip)).view(np.float64) - a <= tol
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        return pd.Series((low ^ ((low >> 63) & flip)).view(np.float64))

    return reach


def tolerance_counts(df: DataFrame, value: str, tol: float, cls: str) -> DataFrame:
    """One row (n_pairs, n_within, n_across, max_across_gap): the pairs of rows with values at most ``tol`` apart, counted and not listed.

    Equal values of a class are one row with a count. A value's partners above
    it end at the greatest value within its reach; sums over the order of all
    values and reaches together tell how many there are, in all and in each
    class, in time n log n however dense the values lie. The last value of
    another class below a reach gives the widest gap across classes, or 0.
    Null and NaN values are left out; a null class is within none and across none.
    """
    x = F.col(value).cast("double")
    blocks = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("v"), F.col(cls).alias("k")).agg(F.count("*").alias("c"))
    blocks = written(blocks.withColumn("end", _reach(tol)("v")), "values")
    points = blocks.select(F.col("v").alias("x"), F.lit(0).alias("kind"), "k", "c", "v")
    asked = blocks.select(F.col("end").alias("x"), F.lit(1).alias("kind"), "k", "c", "v")
    events = points.unionByName(asked).withColumns({"p": F.when(F.col("kind") == 0, F.col("c")), "told": F.col("k").isNotNull()})
    order = ["x", "kind", "k", "v"]
    last = F.when((F.col("kind") == 0) & F.col("told"), F.struct("x", "k"))
    rows = running(events, [], order, {"all": "p", "known": F.when(F.col("told"), F.col("p"))}, {"last": last}, sizes=blocks)
    jump = F.when((F.col("kind") == 0) & F.col("told") & (F.col("last.k") != F.col("k")), F.col("last.x"))
    rows = running(rows, [], order, maxima={"other": jump}, sizes=blocks)
    own = running(events.where("told"), ["k"], order, {"own": "p"}, sizes=blocks)

    def pairs(name: str, told: Column) -> Column:
        c = F.col("c").cast("decimal(19,0)")
        part = F.when(F.col("kind") == 1, c * F.col(name)).otherwise(-c * F.col(name) - c * (c + 1) / 2)
        return F.coalesce(F.sum(F.when(told, part)), F.lit(0)).cast("bigint")

    far = F.when(F.col("last.k") != F.col("k"), F.col("last.x")).otherwise(F.col("other"))
    gap = F.max(F.when((F.col("kind") == 1) & F.col("told") & (far >= F.col("v")), far - F.col("v")))
    found = rows.agg(pairs("all", F.lit(True)).alias("n_pairs"), pairs("known", F.col("told")).alias("n_known"), F.coalesce(gap, F.lit(0.0)).alias("max_across_gap"))
    within = own.agg(pairs("own", F.lit(True)).alias("n_within"))
    return found.join(F.broadcast(within)).select("n_pairs", "n_within", (F.col("n_known") - F.col("n_within")).alias("n_across"), "max_across_gap")


def lookup_or_report(df: DataFrame, params: DataFrame, key: str, value: str) -> DataFrame:
    """Parameter of each row; rows without one have status ERROR."""
    found = df.join(params.select(key, value), key, "left")
    return found.withColumn("status", F.when(F.col(value).isNull(), "ERROR").otherwise("OK"))


def missing_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: the sorted keys of rows with status ERROR, and their number."""
    keys = F.array_sort(F.collect_set(F.when(F.col("status") == "ERROR", F.col(key).cast("string"))))
    return df.agg(F.array_join(keys, ",").alias("missing"), F.count_if(F.col("status") == "ERROR").alias("n_rows"))


def positive_negative_pairs(items: DataFrame, negatives: DataFrame, scores: DataFrame, item: str, negative: str, default_score: float | None = None) -> DataFrame:
    """Each item with its negatives and their scores: pos_score, neg_score, weight, scored."""
    found = items.join(negatives, item).join(scores.select(F.col("key").alias(negative), F.col("score").alias("neg_score"), "weight"), negative, "left")
    scored = F.col("neg_score").isNotNull()
    return found.withColumns({"scored": scored, "neg_score": F.coalesce("neg_score", F.lit(default_score).cast("double")), "weight": F.coalesce("weight", F.lit(1.0))})


def _digests(tokens: str) -> dict[str, Column]:
    return {f"h{n}": F.xxhash64(tokens, F.lit(n)) for n in (1, 2)}


def set_classes(df: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """((rep, s, size), (key, rep)): the different sets of tokens, with their least key and number of rows, and the rows' classes; written.

    ``tokens`` are distinct tokens in an array; null ones are left out. Rows find
    their class by two 64-bit digests, or by the set itself if two classes have the same ones.
    """
    base = df.where(F.col(tokens).isNotNull()).select(F.col(key).alias("k"), F.sort_array(tokens).alias("s")).withColumns(_digests("s"))
    base = written(base, "sets")
    reps = written(base.groupBy("h1", "h2", "s").agg(F.min("k").alias("rep"), F.count("*").alias("size")), "classes")
    told = reps.groupBy("h1", "h2").count().where("count > 1").isEmpty()
    by = ["h1", "h2"] if told else ["h1", "h2", "s"]
    members = base.join(reps.select(*by, "rep"), by).select(F.col("k").alias(key), "rep")
    return reps.select("rep", "s", "size"), written(members, "members")


def equal_sets(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, rep): of each row the least key among those with the same set of tokens."""
    return set_classes(df, key, tokens)[1]


#: Tokens of a block of sets, and blocks that a table has at least if they hold BLOCK_LEAST tokens or more.
BLOCK, BLOCKS, BLOCK_LEAST = 12_000_000, 24, 50_000
#: Matches that a task looks at together.
MATCHES = 2_000_000
#: Words of 64 bits that a set's sketch has at most, and those that are gathered together.
SKETCH, GATHER = 128, 1 << 18


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _sketches(n: np.ndarray, start: np.ndarray, tokens: np.ndarray, words: int) -> np.ndarray:
    """Of each set so many words, with the bits on that its tokens are hashed to."""
    bits = 64 * words
    out = np.empty((len(n), words), np.uint64)
    step = max(1, (GATHER << 3) // bits)
    for lo in range(0, len(n), step):
        size = n[lo : lo + step]
        own = tokens[start[lo] : start[lo] + size.sum()].astype(np.uint64)
        at = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (bits - 1)
        flags = np.zeros(len(size) * bits, bool)
        flags[np.repeat(np.arange(len(size)) * bits, size) + at] = True
        out[lo : lo + step] = np.packbits(flags).view(np.uint64).reshape(-1, words)
    return out


def _block_pairs(low: float, high: float):
    """Pairs of sets of two blocks, i and j up to i, from rows (i, j, own, k, n, s): those of ``own`` are of block i."""
    share, most = 2 * low / (1 + low), (1 - low) / (1 + low)

    def sets(part: pa.Table):
        part = part.sort_by([("n", "ascending"), ("k", "ascending")])
        s = part["s"].combine_chunks()
        n = part["n"].to_numpy().astype(np.int64)
        return part["k"], n, np.cumsum(n) - n, s.flatten().to_numpy()

    def prefix(n: np.ndarray, start: np.ndarray, tokens: np.ndarray, part: float):
        size = n - np.ceil(n * part - 1e-9).astype(np.int64) + 1
        return tokens[_ranges(start, size)].astype(np.int64), np.repeat(np.arange(len(n)), size)

    def run(rows: pa.Table) -> pa.Table:
        own = rows["own"]
        ka, na, sa, ta = sets(rows.filter(own))
        same = rows["i"][0].as_py() == rows["j"][0].as_py()
        kb, nb, sb, tb = (ka, na, sa, ta) if same else sets(rows.filter(pc.invert(own)))
        found = [np.empty((3, 0))]
        if len(na) and len(nb):
            t, ja = prefix(na, sa, ta, low)
            u, jb = prefix(nb, sb, tb, share)
            wide = len(nb) + 1
            held = np.zeros(int(max(ta.max(), tb.max())) + 1, bool)
            held[u] = True
            hit = held[t]
            t, ja = t[hit], ja[hit]
            key = np.sort(u * wide + jb)
            # Of a token's sets those that are long enough, and in one block those before the set itself.
            first = np.searchsorted(key, t * wide + np.searchsorted(nb, low * na - 1e-9)[ja])
            count = np.searchsorted(key, t * wide + (ja if same else len(nb))) - first
            count = np.maximum(count, 0)
            total = np.concatenate([[0], np.cumsum(count)])
            ends = np.searchsorted(ja, np.arange(len(na) + 1))
            words = min(SKETCH, 1 << max(0, int(4 * max(na.max(), nb.max()) - 1).bit_length() - 6))
            ca = _sketches(na, sa, ta, words)
            cb = ca if same else _sketches(nb, sb, tb, words)
            done, mark = 0, np.zeros(len(held), np.int32)
            while done < len(na):
                upto = max(done + 1, int(np.searchsorted(total[ends], total[ends[done]] + MATCHES, "right")) - 1)
                e = slice(ends[done], ends[upto])
                pairs = np.sort(np.repeat(ja[e] * len(nb), count[e]) + key[_ranges(first[e], count[e])] % wide)
                a, b = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(nb))
                # Bits in one sketch only come from tokens in one set only.
                keep = np.empty(len(a), bool)
                for lo in range(0, len(a), step := max(1, GATHER // words)):
                    x, y = a[lo : lo + step], b[lo : lo + step]
                    keep[lo : lo + step] = np.bitwise_count(ca[x] ^ cb[y]).sum(axis=1, dtype=np.int64) <= most * (na[x] + nb[y]) + 1e-9
                a, b = a[keep], b[keep]
                for k, run_ in zip(*np.unique(a, return_index=True), strict=True):
                    mine = b[run_ : np.searchsorted(a, k, "right")]
                    tokens = ta[sa[k] : sa[k] + na[k]]
                    mark[tokens] = 1
                    both = np.add.reduceat(mark[tb[_ranges(sb[mine], nb[mine])]], np.cumsum(nb[mine]) - nb[mine])
                    mark[tokens] = 0
                    similarity = both / (na[k] + nb[mine] - both)
                    fits = (similarity >= low) & (similarity <= high)
                    found.append(np.array([np.full(fits.sum(), k), mine[fits], similarity[fits]]))
                done = upto
        a, b, similarity = np.concatenate(found, axis=1)
        return pa.table({"ka": ka.take(pa.array(a.astype(np.int64))), "kb": kb.take(pa.array(b.astype(np.int64))), "similarity": similarity})

    return run


def numbered_sets(reps: DataFrame) -> DataFrame:
    """(k, s, n) of ``reps(rep, s)`` that are not empty: tokens as their sorted numbers, the rarest first; written."""
    held = reps.select(F.col("rep").alias("k"), F.explode("s").alias("t"))
    counts = numbered(held.groupBy("t").agg(F.count("*").alias("df")), ["df", "t"]).select("t", F.col("r_").cast("int").alias("no"))
    return written(held.join(counts, "t").groupBy("k").agg(F.sort_array(F.collect_list("no")).alias("s")).withColumn("n", F.size("s")), "similarity")


def similar_classes(reps: DataFrame, low: float, high: float = 1.0, sets: DataFrame | None = None) -> DataFrame:
    """(ka, kb, similarity) of pairs of ``reps(rep, s)`` with a Jaccard similarity from low to high, once each.

    Exact. Sets are dealt into blocks by size, and each two blocks whose sizes
    allow a pair meet in a task, so matches are neither shuffled nor written:
    what is shuffled is each set once for each block it meets. There they meet
    by an inverted index over their rarest tokens: two sets with a similarity of
    ``low`` share a token among the n - ceil(low n) + 1 rarest of the larger and
    the n - ceil(2 low / (1 + low) n) + 1 rarest of the smaller. Of a match,
    sketches of hashed bits are compared first: as many bits as differ are
    tokens in one set only, so what differs in too many is no pair. The rest
    are counted on their numbered tokens. Empty sets match nothing. ``sets`` are
    the :func:`numbered_sets` of ``reps``, if they are there already.
    """
    sets = numbered_sets(reps) if sets is None else sets
    sizes = sets.groupBy("n").agg(F.count("*").alias("c"))
    tokens = sizes.agg(F.sum(F.col("n").cast("long") * F.col("c"))).first()[0] or 0
    block = min(BLOCK, max(BLOCK_LEAST, -(-tokens // BLOCKS)))
    mass = F.col("n").cast("long") * F.col("c")
    starts = sizes.select("n", mass.alias("mass"), (F.sum(mass).over(Window.orderBy("n")) - mass).alias("start"))  # a row for each size
    place = F.col("start") + F.col("mass") * (F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    placed = sets.join(F.broadcast(starts), "n").select("k", "n", "s", F.floor(place / block).cast("int").alias("block"))
    ends = placed.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = ends.select(F.col("block").alias("i"), "least"), ends.select(F.col("block").alias("j"), "most")
    meet = one.join(F.broadcast(two), F.expr(f"j <= i AND most >= {low!r}D * least - 1e-9")).select("i", "j")
    meet = meet.select("i", "j", F.explode(F.expr("CASE WHEN i = j THEN array(i) ELSE array(i, j) END")).alias("block"))
    rows = placed.join(F.broadcast(meet), "block").select("i", "j", (F.col("block") == F.col("i")).alias("own"), "k", "n", "s")
    kind = reps.schema["rep"].dataType.simpleString()
    return rows.groupBy("i", "j").applyInArrow(_block_pairs(low, high), f"ka {kind}, kb {kind}, similarity double")


def set_similarity_join(df: DataFrame, key: str, tokens: str, low: float, high: float = 1.0, expand: bool = False) -> DataFrame:
    """(key_a, key_b, similarity) of pairs with a Jaccard similarity from low to high; see :func:`similar_classes`.

    Rows with equal sets are one class, and the pairs are those of the classes'
    least keys, for which :func:`equal_sets` gives the members. With ``expand``
    all pairs of rows are listed, which is quadratic in copies.
    """
    reps, classes = set_classes(df, key, tokens)
    found = similar_classes(reps, low, high)
    first, second = F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")
    if not expand:
        return found.select(first, second, "similarity")
    member = classes.select(F.col(key).alias("k"), "rep")
    pairs = found.join(member.select(F.col("rep").alias("ka"), F.col("k").alias("x")), "ka").join(member.select(F.col("rep").alias("kb"), F.col("k").alias("y")), "kb")
    pairs = pairs.select(F.col("x").alias("ka"), F.col("y").alias("kb"), "similarity")
    if high >= 1.0:
        full = member.join(reps.where(F.size("s") > 0).select("rep"), "rep", "left_semi")
        alike = full.join(full.select("rep", F.col("k").alias("y")), "rep").where("k < y").select(F.col("k").alias("ka"), F.col("y").alias("kb"), F.lit(1.0).alias("similarity"))
        pairs = pairs.unionByName(alike)
    return pairs.select(first, second, "similarity")


def parameter_grid(df_or_spark, **axes: Sequence) -> DataFrame:
    """Every combination of the listed values, one column per axis."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(name))
    return out


def union_support(p: DataFrame, q: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Both distributions over their joint support; p and q are 0 where absent."""
    a = p.select(*by, key, F.col("p").alias("p"))
    b = q.select(*by, key, F.col("p").alias("q"))
    return a.join(b, [*by, key], "full_outer").select(*by, key, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def interleaved_pairs(intervals: DataFrame, graph: str, start: str, end: str) -> DataFrame:
    """Number of pairs of a graph's intervals with a1 < a2 < b1 < b2.

    Counted, not listed. With intervals numbered by (start, -end), two numbers
    differ first in one binary digit, so each pair belongs to one block of one
    level. In a block, an interval of the lower half crosses as many of the
    upper half as start before its end less those that also end by then, which
    is a running sum. So rows are intervals times the logarithm of their number.
    """
    own = Window.partitionBy(graph)
    rows = intervals.select(graph, F.col(start).cast("double").alias("a"), F.col(end).cast("double").alias("b")).where("a < b")
    rows = dealt(rows, [graph], rows.count())
    rows = rows.withColumns({"i": F.row_number().over(own.orderBy("a", F.desc("b"))) - 1, "n": F.count("*").over(own)})
    levels = F.explode(F.expr("sequence(0, cast(ceil(log2(greatest(n, 2))) AS int) - 1)")).alias("level")
    rows = rows.select(graph, "a", "b", "i", levels).withColumn("block", F.expr("shiftright(i, level + 1)"))
    # At one place an end of the upper half counts first, then a question of the lower half, then a start.
    mark = "CASE WHEN shiftright(i, level) % 2 = 0 THEN array(struct(b AS x, 1 AS kind, 0 AS v)) ELSE array(struct(b AS x, 0 AS kind, -1 AS v), struct(a AS x, 2 AS kind, 1 AS v)) END"
    marks = rows.select(graph, "level", "block", F.explode(F.expr(mark)).alias("m")).select(graph, "level", "block", "m.*")
    run = F.sum("v").over(Window.partitionBy(graph, "level", "block").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = marks.withColumn("k", run).where("kind = 1").groupBy(graph).agg(F.sum("k").alias("n_crossings"))
    return intervals.select(graph).distinct().join(found, graph, "left").withColumn("n_crossings", F.coalesce("n_crossings", F.lit(0)))


def suffix(columns: Sequence[str], end: str) -> list[Column]:
    return [F.col(c).alias(f"{c}{end}") for c in columns]
