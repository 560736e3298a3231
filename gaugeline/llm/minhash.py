"""Near-duplicate groups by MinHash, banding, verification and components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, partitions, spread
from gaugeline.llm.components import connected_components

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
_BLOCK = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Letters A-Z are lower-cased and words end at ASCII white space, which is
    what ``bytes.lower`` and ``bytes.split`` do. A text with fewer words than a
    shingle is one shingle; a text without words is the empty set.
    """
    found = (text or "").encode().lower().split()
    size = min(words, len(found))
    if not size:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mixed((out ^ h[k : k + n]) * _ODD)
    return np.unique(out)


def minima(sets: list[np.ndarray], hashes: int, seed: int) -> np.ndarray:
    """uint32[len(sets), hashes]: for each universal hash, the least value over each non-empty set."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, hashes, np.uint64)
    out = np.empty((len(sets), hashes), np.uint32)
    k = 0
    while k < len(sets):
        end, size = k, 0
        while end < len(sets) and (end == k or size + len(sets[end]) <= _BLOCK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[k:end])
        at = np.cumsum([0, *map(len, sets[k : end - 1])])
        y = np.empty_like(x)
        for i in range(hashes):
            np.multiply(x, mult[i], out=y)
            np.add(y, plus[i], out=y)
            out[k:end, i] = np.minimum.reduceat(y, at) >> np.uint64(32)
        k = end
    return out


def _signatures(words: int, bands: int, rows: int, seed: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            full = [k for k, s in enumerate(sets) if len(s)]
            low = minima([sets[k] for k in full], bands * rows, seed)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands)).copy()
            for r in range(rows):
                key = _mixed((key ^ low[:, r::rows].astype(np.uint64)) * _ODD)
            at = dict(zip(full, range(len(full)), strict=True))
            sketch = (low & np.uint32(255)).astype(np.uint8)
            ends = np.cumsum([0, *(bands if k in at else 0 for k in range(len(sets)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch[at[k]].tobytes() if k in at else None for k in range(len(sets))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(key.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "set_key", "sketch", "bands"],
            )

    return run


def _runs(batches):
    """Of rows sorted by band, those whose band has another row here, and the first and last run, which may go on elsewhere."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    first = True

    def out(band, member):
        return pa.RecordBatch.from_arrays([pa.array(band), pa.array(member)], names=["band", "member"])

    for batch in batches:
        if not batch.num_rows:
            continue
        band, member = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if held:
            band, member = np.concatenate([held[0][0], band]), np.concatenate([held[0][1], member])
        cut = int(np.searchsorted(band, band[-1]))  # the last run waits for the next batch; of a long one, two rows wait
        done_b, done_m, rest_b, rest_m = band[:cut], member[:cut], band[cut:], member[cut:]
        if len(done_b):
            same = done_b[1:] == done_b[:-1]
            keep = np.append(same, False) | np.append(False, same)
            keep |= first & (done_b == done_b[0])
            yield out(done_b[keep], done_m[keep])
            first = False
        if len(rest_b) > 2:
            yield out(rest_b[2:], rest_m[2:])
        held = [(rest_b[:2], rest_m[:2])]
    if held:
        yield out(*held[0])


def _by_sketch(hashes: int, least: float):
    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint8) for v in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([int(np.count_nonzero(p == q)) >= least * hashes for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                which = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "which", "shingles"])

    return run


def _by_sets(percent: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                p, q = np.frombuffer(x[k].as_py(), np.uint64), np.frombuffer(y[k].as_py(), np.uint64)
                both = 0
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    z = np.sort(np.concatenate([p, q]), kind="stable")
                    both = int(np.count_nonzero(z[1:] == z[:-1]))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, column of a, column of b)."""
    one = table.select(F.col("doc_id").alias("a"), F.col(column).alias("of_a"))
    two = table.select(F.col("doc_id").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")


def _tokens(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            sets = [np.frombuffer(v, np.int64) for v in part.column(2).to_pylist()]
            ids, which = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), [len(x) for x in sets]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(which), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["doc_id", "which", "token"])


def _across(mixed: DataFrame, sets: DataFrame, percent: int, frequent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a > b, that can link two components of ``mixed(band, member, component)``.

    Listing all pairs of a bucket would take the square of its size, and a
    passage that many texts share fills buckets with texts that stay just under
    the threshold. With shingles ordered from rare to frequent, two linked sets
    share one of their first n - ceil(percent n / 100) + 1 shingles. So either
    they share a rare one there, which few sets hold, or their rare parts are
    disjoint and within that prefix. In that case what they share is frequent,
    and each is also linked with the set of least rare part among all that have
    the same frequent part as the other, if the frequent parts suffice. Such
    representatives stand for their class, and nothing is lost. An id may have
    several sets (``which``), and a repeated row gives the same one.
    """
    docs = mixed.select(F.col("member").alias("doc_id"), "component").distinct()
    held = scratch.keep(sets.join(spread(docs.select("doc_id")), "doc_id", "left_semi").mapInArrow(_tokens, "doc_id long, which long, token long"), "held")
    counts = held.groupBy("token").agg(F.count("*").alias("df"))
    ordered = held.join(spread(counts), "token").groupBy("doc_id", "which").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("all"))
    ordered = ordered.withColumn("n", F.size("all")).withColumn("rare", F.expr(f"filter(all, x -> x.df < {frequent})"))
    ordered = ordered.withColumn("prefix", F.expr(f"n - cast(ceil(n * {percent} / 100D) AS int) + 1"))
    ordered = ordered.select(
        "doc_id",
        "n",
        F.size("rare").alias("n_rare"),
        "prefix",
        F.expr("slice(rare, 1, prefix).token").alias("first"),
        F.xxhash64(F.sort_array(F.expr(f"filter(all, x -> x.df >= {frequent}).token"))).alias("core"),
    )
    ordered = scratch.keep(ordered.join(docs, "doc_id"), "ordered")
    x = ordered.select(F.explode("first").alias("token"), F.col("doc_id").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("n_a"))
    y = x.select("token", F.col("a").alias("b"), F.col("of_a").alias("of_b"), F.col("n_a").alias("n_b"))
    rare = x.join(y, "token").where(f"a > b AND of_a <> of_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
    near = ordered.where("n_rare < prefix").select("doc_id", "component", "core", "n_rare", "n")
    reps = near.groupBy("core").agg(F.min(F.struct("n_rare", "doc_id", "component", "n")).alias("rep")).select("core", "rep.*")
    here = scratch.keep(mixed.select("band", F.col("member").alias("doc_id")).join(near, "doc_id"), "here")
    there = here.select("band", "core").distinct().join(spread(reps), "core")
    there = there.select("band", F.col("doc_id").alias("rep"), F.col("component").alias("of_rep"), F.col("n").alias("n_rep"), F.col("n_rare").alias("rare_rep"))
    enough = f"least(n - n_rare, n_rep - rare_rep) * {100 + percent} >= {percent} * (n + n_rep)"
    core = here.join(spread(there), "band").where(f"component <> of_rep AND {enough}").select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
    return rare.union(core).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
    seed: int = 7,
    frequent: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per document: doc_id, n_shingles, component_id (smallest
    doc_id reachable over links, itself included) and kept.

    ``bands * rows`` universal hash minima are taken over every whole text. Two
    documents that agree in all rows of a band are candidates; at a similarity
    of 0.8 a pair is missed with probability (1 - 0.8**5)**40, under 2e-7.
    Candidates are dropped by their sketches only when the estimate is six
    deviations under the threshold, and every other candidate is confirmed on
    the full sets.

    Documents with equal sets are one class, so copies never meet in pairs. In
    each band's bucket the members are first compared with the one that shares
    most buckets with others; after components are found, members of a bucket
    that are still in different components are compared as far as a link is
    possible (see :func:`_across`; a shingle is frequent from ``frequent``
    sets on). Together these cover every pair that shares a bucket. Buckets are dealt out by range of (band, id), so one
    hot bucket is spread over tasks.

    A null or empty text, or one without words, has the empty set and is linked
    with nothing. A row with a null id is linked with nothing, has a null
    component and is kept. Rows that share an id are one node; each is
    returned. Extra columns are ignored.
    """
    spark, hashes = docs.sparkSession, bands * rows
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(
        base.mapInArrow(_signatures(words, bands, rows, seed), "doc_id long, n_shingles long, set_key binary, sketch binary, bands array<long>"),
        "signed",
    )
    classes = scratch.keep(
        signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes"
    )
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    exploded = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("member"))
    members = scratch.keep(
        exploded.repartitionByRange(partitions(spark), "band", "member").sortWithinPartitions("band", "member").mapInArrow(_runs, "band long, member long"),
        "members",
    )
    least = max(0.0, percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / hashes) ** 0.5)
    ids = members.select(F.col("member").alias("doc_id")).distinct()
    sketches = scratch.keep(signed.join(spread(ids), "doc_id", "left_semi").select("doc_id", "sketch"), "sketches")
    sets = scratch.keep(base.join(spread(ids), "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, which long, shingles binary"), "sets")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        likely = _with_both(pairs, sketches, "sketch").mapInArrow(_by_sketch(hashes, least), "a long, b long")
        likely = scratch.keep(likely, f"likely-{label}")
        links = _with_both(likely, sets, "shingles").mapInArrow(_by_sets(percent), "a long, b long")
        return scratch.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"links-{label}")

    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(members.join(spread(sizes), "band"), "shared")
    weights = shared.groupBy("member").agg(F.sum("n").alias("weight"))
    centers = shared.join(spread(weights), "member").groupBy("band").agg(F.min(F.struct(-F.col("weight"), "member")).member.alias("center"))
    star = shared.join(spread(centers), "band").where("member <> center")
    star = scratch.keep(star.select(F.greatest("member", "center").alias("a"), F.least("member", "center").alias("b")).distinct(), "star")
    links = confirmed(star, "star")
    grouped = scratch.keep(connected_components(links, scratch, "cc1"), "grouped")
    placed = shared.join(grouped, shared.member == grouped.node, "left").select("band", "member", F.coalesce("component", "member").alias("component"))
    placed = scratch.keep(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    mixed = scratch.keep(placed.join(spread(mixed), "band"), "mixed")
    across = _across(mixed, sets, percent, frequent, scratch)
    across = scratch.keep(across.join(star, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        links = links.union(confirmed(across, "across"))
        grouped = scratch.keep(connected_components(links, scratch, "cc2"), "regrouped")

    roots = classes.join(grouped, classes.rep == grouped.node, "left").select("set_key", F.coalesce("component", "rep").alias("root"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(spread(roots), "set_key", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
