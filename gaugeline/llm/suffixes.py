"""Removal of long repeated byte strings through blockwise hashing of suffixes.

Only suffixes that can begin a repeated string of ``length`` bytes are looked
at, and each is compared by a hash of that many bytes. A difference cover of period ``v`` has,
for any two positions, an offset under v at which both positions fall on it. So
if two strings of ``length`` bytes are equal, two cover positions in them have
the same next ``length - v + 1`` bytes. First the cover positions whose hash of
those bytes stands at another position too are found, one bucket at a time.
Then only suffixes within reach of such a position are dealt into buckets.
Equal hashes take the place of ranks and suffix order, since only ties matter;
a tie of suffixes is one of 96 bits of hashes of all their bytes.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, partitions, spread

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ODD_2 = np.uint64(0xD6E8FEB86659FD93)
_MIX_2 = np.uint64(0xA0761D6478BD642F)
_HALF = np.uint64(32)
_SEGMENT = 1 << 20
_BLOCK = 1 << 18
_TEXTS = 2048


def difference_cover(prime: int) -> tuple[int, np.ndarray]:
    """(period, offsets): prime + 1 offsets whose differences give every residue of prime**2 + prime + 1.

    Singer's construction: the powers of a generator of GF(prime**3) that lie in a plane.
    """
    period = prime * prime + prime + 1
    for c0, c1, c2 in product(range(1, prime), range(prime), range(prime)):
        x, found = (1, 0, 0), []
        for k in range(period):
            if x[2] == 0:
                found.append(k)
            x = (x[2] * c0 % prime, (x[0] + x[2] * c1) % prime, (x[1] + x[2] * c2) % prime)
        if len(found) == prime + 1 and len({(a - b) % period for a in found for b in found}) == period:
            return period, np.array(found)
    raise ValueError("no cover for this prime")


def _grown(h: np.ndarray, size: int, length: int, odd: np.uint64, mix: np.uint64) -> np.ndarray:
    """From hashes of the ``size`` elements from each position on, those of ``length`` elements."""

    def joined(x, y):
        z = x * odd
        z ^= y * mix
        z ^= z >> _HALF
        z *= mix
        z ^= z >> _HALF
        return z

    n = len(h) + size - length
    if n <= 0:
        return np.empty(0, np.uint64)
    while size * 2 <= length:
        h = joined(h[:-size], h[size:])
        size *= 2
    return joined(h[:n], h[length - size : length - size + n])


def fingerprints(data: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes (8 or more) from each position on; ``second`` gives independent ones."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    odd, mix = (_ODD_2, _MIX_2) if second else (_ODD, _MIX)
    h = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data).data, 0, (1,)) * odd
    h ^= h >> _HALF
    return _grown(h, 8, length, odd, mix)


def _least_of(h: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The least (or largest) of the ``width`` values from each position on."""
    size, out = 1, h
    while size * 2 <= width:
        out = least(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def chosen_windows(text: bytes, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of some windows of ``gram`` words, such that two texts with ``run`` equal words in a row share one.

    Of every run - gram + 1 neighbouring windows those with the least hash are
    taken, so the choice rests on the words alone. Words end at ASCII white space.
    """
    words = text.split()
    if len(words) < run:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grown(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), 1, gram, _ODD, _MIX)
    width = run - gram + 1
    low = _least_of(h, width)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _least_of(np.concatenate([edge, low, edge]), width, np.maximum))
    fp, first = np.unique(h[at], return_index=True)
    return at[first], fp


#: fp_2: of each entry a second hash, or nothing.
_PACKED = "bucket int, fp binary, pos binary, keys binary, counts binary, fp_2 binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("fp", "pos", "keys", "counts", "fp_2"))])
#: Positions of many texts in a row; the texts of a group meet in one task.
_TOLD = "share int, keys binary, counts binary, pos binary"
_TOLD_ARROW = pa.schema([("share", pa.int32()), *((k, pa.binary()) for k in ("keys", "counts", "pos"))])
_AT = "k1 long, k2 long, at binary"
_AT_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.binary())])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _packed_positions(pos: np.ndarray, starts: np.ndarray) -> bytes:
    """Steps between ascending positions, whole at the start of each text, in two bytes each if all fit, else in four."""
    step = np.diff(pos, prepend=0)
    step[starts] = pos[starts]
    wide = bool(len(step)) and int(step.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + step.astype(np.uint32 if wide else np.uint16).tobytes()


def _unpacked_positions(data: bytes, counts: np.ndarray) -> np.ndarray:
    step = np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint16, offset=1).astype(np.int64)
    starts = np.cumsum(counts) - counts
    total = np.cumsum(step)
    return (total - np.repeat(total[starts] - step[starts], counts)).astype(np.uint32)


def _share(hashes: np.ndarray, n: int) -> np.ndarray:
    """Number under ``n`` of the equal range of 64-bit hashes that each lies in."""
    return (((hashes.view(np.uint64) >> _HALF) * np.uint64(n)) >> _HALF).astype(np.int32)


def _pack(fp: np.ndarray, pos: np.ndarray, who: np.ndarray, keys: np.ndarray, buckets: int, narrow: bool, fp_2: np.ndarray | None = None):
    """A row per bucket; within it positions stand together by text."""
    bucket = _share(fp, buckets)
    order = np.lexsort((pos, who, bucket))
    fp, pos, who, bucket = fp[order], pos[order].astype(np.int64), who[order], bucket[order]
    fp = fp.astype(np.uint32) if narrow else fp
    fp_2 = np.empty(0, np.uint32) if fp_2 is None else fp_2[order].astype(np.uint32)
    cuts = np.append(_runs(bucket), len(bucket)) if len(bucket) else np.zeros(1, int)
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = _runs(who[a:b])
        counts = np.diff(np.append(at, b - a)).astype(np.uint32)
        rows.append((int(bucket[a]), fp[a:b].tobytes(), _packed_positions(pos[a:b], at), keys[who[a:b][at]].tobytes(), counts.tobytes(), fp_2[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _segments(texts, length: int):
    """Group (index, text, wanted positions or None) into buffers; yields (buffer, [(index, offset in buffer, first position, n positions, wanted)])."""
    parts, held, total = [], [], 0
    for k, text, wanted in texts:
        data = np.frombuffer(text, np.uint8)
        n = len(data) - length + 1
        for s in range(0, max(n, 0), _SEGMENT):
            m = min(_SEGMENT, n - s)
            piece = data[s : s + m + length - 1]
            held.append((k, total, s, m, wanted))
            parts.append(piece)
            total += len(piece)
            if total >= _SEGMENT:
                yield np.concatenate(parts), held
                parts, held, total = [], [], 0
    if held:
        yield np.concatenate(parts), held


def _first_of_each(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose keys, the first two columns, are not among those seen before."""
    fresh = []
    for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        fresh.append(key not in seen)
        seen.add(key)
    return batch.filter(pa.array(fresh, pa.bool_()))


def _cover_entries(length: int, prime: int, buckets: int):
    def run(batches):
        period, cover = difference_cover(prime)
        short = length - period + 1
        on = np.zeros(period, bool)
        on[cover] = True
        seen = set()
        for batch in batches:
            batch = _first_of_each(batch, seen)
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            texts = ((k, v.as_buffer(), None) for k, v in enumerate(batch.column(2)))
            for data, held in _segments(texts, short):
                fp = fingerprints(data, short)
                at, pos, who = [], [], []
                for k, base, first, m, _ in held:
                    p = np.flatnonzero(np.resize(np.roll(on, -(first % period)), m))
                    at.append(p + base)
                    pos.append(p + first)
                    who.append(np.full(len(p), k))
                at, pos, who = map(np.concatenate, (at, pos, who))
                if len(at):
                    yield _pack(fp[at], pos, who, keys, buckets, True)

    return run


def _word_entries(gram: int, run_words: int, buckets: int):
    def run(batches):
        seen = set()
        for batch in batches:
            batch = _first_of_each(batch, seen)
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            for a in range(0, batch.num_rows, _TEXTS):
                found = [(k, *chosen_windows(batch.column(2)[k].as_py(), gram, run_words)) for k in range(a, min(a + _TEXTS, batch.num_rows))]
                who = np.repeat([k for k, _, _ in found], [len(x) for _, x, _ in found])
                if len(who):
                    yield _pack(np.concatenate([x for _, _, x in found]), np.concatenate([x for _, x, _ in found]), who, keys, buckets, False)

    return run


def _suffix_entries(length: int, period: int, buckets: int):
    def run(batches):
        seen = set()
        for batch in batches:
            batch = _first_of_each(batch, seen)
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            wanted = batch.column(3).to_pylist()
            texts = ((k, v.as_buffer(), np.frombuffer(wanted[k], np.uint32)) for k, v in enumerate(batch.column(2)))
            for data, held in _segments(texts, length):
                fp = fingerprints(data, length)
                at, pos, who = [], [], []
                for k, base, first, m, tied in held:
                    step = np.zeros(m + 1, np.int64)
                    tied = tied.astype(np.int64) - first
                    np.add.at(step, np.clip(tied - period + 1, 0, m), 1)
                    np.add.at(step, np.clip(tied + 1, 0, m), -1)
                    p = np.flatnonzero(np.cumsum(step[:m]) > 0)
                    at.append(p + base)
                    pos.append(p + first)
                    who.append(np.full(len(p), k))
                at, pos, who = map(np.concatenate, (at, pos, who))
                if len(at):
                    yield _pack(fp[at], pos, who, keys, buckets, False, fingerprints(data, length, second=True)[at])

    return run


def _ties(narrow: bool, shares: int, across: bool = False):
    """Of each bucket in turn, the positions whose fingerprint also stands at another position, or ``across`` in another text.

    Rows come by bucket. Entries are taken in blocks and merged into the
    sorted distinct fingerprints seen so far, so memory follows the number of
    distinct ones in a bucket, however often one is repeated. What is found is
    told in ``shares`` by the texts' keys.
    """
    kind = np.uint32 if narrow else np.uint64

    def found(k1, k2, pos):
        share = _share(k1, shares)
        order = np.lexsort((pos, k2, k1, share))
        share, k1, k2, pos = share[order], k1[order], k2[order], pos[order]
        once = _runs(k1, k2, pos)
        share, k1, k2, pos = share[once], k1[once], k2[once], pos[once].astype(np.int64)
        cuts = np.append(_runs(share), len(share)) if len(share) else np.zeros(1, int)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = _runs(k1[a:b], k2[a:b])
            counts = np.diff(np.append(at, b - a)).astype(np.uint32)
            rows.append((int(share[a]), np.stack([k1[a:b][at], k2[a:b][at]], axis=1).tobytes(), counts.tobytes(), _packed_positions(pos[a:b], at)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_TOLD_ARROW)], schema=_TOLD_ARROW)

    class Bucket:
        def __init__(self):
            self.state = [np.empty(0, kind), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, bool)]
            self.held, self.size = [], 0

        def add(self, row):
            counts = np.frombuffer(row[4], np.uint32).astype(np.int64)
            fp, pos = np.frombuffer(row[1], kind), _unpacked_positions(row[2], counts)
            keys = np.repeat(np.frombuffer(row[3], np.int64).reshape(-1, 2), counts, axis=0)
            fp_2 = np.frombuffer(row[5], np.uint32) if row[5] else np.zeros(len(fp), np.uint32)
            self.held.append((fp, fp_2, keys[:, 0], keys[:, 1], pos))
            self.size += len(fp)

        def merge(self):
            fp, fp_2, k1, k2, pos = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            order = np.argsort(fp, kind="stable")
            if np.any((fp[order][1:] == fp[order][:-1]) & (fp_2[order][1:] != fp_2[order][:-1])):
                order = np.lexsort((fp_2, fp))
            fp, fp_2, k1, k2, pos = fp[order], fp_2[order], k1[order], k2[order], pos[order]
            starts = _runs(fp, fp_2)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp))))
            sfp, sfp_2, s1, s2, spos, told = self.state
            at = np.searchsorted(sfp, fp[starts])
            if len(sfp):
                while True:  # on past entries that share only the first hash
                    safe = np.minimum(at, len(sfp) - 1)
                    other = (at < len(sfp)) & (sfp[safe] == fp[starts]) & (sfp_2[safe] < fp_2[starts])
                    if not other.any():
                        break
                    at[other] += 1
            known = np.zeros(len(starts), bool)
            inside = at < len(sfp)
            known[inside] = (sfp[at[inside]] == fp[starts][inside]) & (sfp_2[at[inside]] == fp_2[starts][inside])
            safe = np.where(known, at, 0)
            first = [np.where(known, s[safe] if len(s) else 0, x[starts]) for s, x in ((s1, k1), (s2, k2), (spos, pos))]
            differs = (k1 != first[0][group]) | (k2 != first[1][group])
            if not across:
                differs |= pos != first[2][group]
            tied = np.zeros(len(starts), bool)
            tied[group[differs]] = True
            before = np.zeros(len(starts), bool)
            before[known] = told[at[known]]
            tied |= before
            say = tied[group]
            again = known & tied & ~before
            out = found(np.append(k1[say], s1[at[again]]), np.append(k2[say], s2[at[again]]), np.append(pos[say], spos[at[again]]))
            told[at[known]] = tied[known]
            new = ~known
            merged = [np.concatenate([s, x]) for s, x in zip(self.state, (fp[starts][new], fp_2[starts][new], first[0][new], first[1][new], first[2][new].astype(np.uint32), tied[new]), strict=True)]
            order = np.argsort(merged[0], kind="stable")
            if np.any(merged[0][order][1:] == merged[0][order][:-1]):
                order = np.lexsort((merged[1], merged[0]))
            self.state = [m[order] for m in merged]
            return out

    def run(batches):
        now, bucket = None, Bucket()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if bucket.size:
                        yield bucket.merge()
                    now, bucket = row[0], Bucket()
                bucket.add(row)
                if bucket.size >= _BLOCK:
                    yield bucket.merge()
        if bucket.size:
            yield bucket.merge()

    return run


def _gathered(batches):
    """Of rows by share, all positions of each text, once each."""
    held: list[tuple] = []

    def out():
        k1, k2, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, k2, k1))
        k1, k2, pos = k1[order], k2[order], pos[order]
        once = _runs(k1, k2, pos)
        k1, k2, pos = k1[once], k2[once], pos[once]
        cuts = _runs(k1, k2)
        for a in range(0, len(cuts), _TEXTS):
            some = np.append(cuts[a : a + _TEXTS], cuts[a + _TEXTS] if a + _TEXTS < len(cuts) else len(k1))
            yield pa.RecordBatch.from_arrays([pa.array(k1[some[:-1]]), pa.array(k2[some[:-1]]), pa.array([pos[x:y].tobytes() for x, y in zip(some, some[1:])], pa.binary())], schema=_AT_ARROW)

    now = None
    for batch in batches:
        for share, keys, counts, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if share != now and held:
                yield from out()
                held.clear()
            now = share
            counts = np.frombuffer(counts, np.uint32).astype(np.int64)
            both = np.repeat(np.frombuffer(keys, np.int64).reshape(-1, 2), counts, axis=0)
            held.append((both[:, 0], both[:, 1], _unpacked_positions(pos, counts)))
    if held:
        yield from out()


def _removal(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                at = np.frombuffer(starts, np.uint32).astype(np.int64)
                step[at] += 1
                step[at + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                rows.append({"k1": k1, "k2": k2, "spans": spans, "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()})
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("spans", pa.list_(span)), ("kept_sha256", pa.string())]))

    return run


def repeated_strings(
    docs: DataFrame,
    length: int = 400,
    prime: int = 13,
    bucket_entries: int = 2_000_000,
    run_words: int = 51,
    gram: int = 36,
    task_bytes: int = 64 << 20,
) -> DataFrame:
    """Bytes of ``docs(doc_id, text)`` that lie in a string of ``length`` bytes which also starts elsewhere.

    Returns a row per document: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 (of the bytes left over), spans (start, end; end exclusive) and
    has_repeat. Strings lie within one document; the other start may be in the
    same one, and they may overlap. They are judged on the input.

    Texts with an identical copy are removed whole by a count of their digests.
    For the rest, entries of cover positions, then of candidate suffixes, go to
    buckets of about ``bucket_entries`` entries or fewer; a task is dealt about
    ``task_bytes`` or less and works on one bucket at a time. A task that makes
    entries takes each distinct text once, so however many copies a text has,
    its positions are dealt at most once a task, and told once in each merge of
    a bucket. Only texts with a tied cover position are looked at again.
    ``length`` must be at least prime**2 + prime + 8. A tie of suffixes means
    that two independent hashes of all their bytes, of 64 and 32 bits, are equal.

    has_repeat is about words, ended by ASCII white space: it is true for every
    document that has ``run_words`` words in a row in common with another
    document, and only for such as have ``gram`` of them in common. It is found
    from few windows of words and changes nothing in the other columns.

    Null and empty texts have no bytes and the digest of the empty string.
    Repeated rows are copies of each other. Ids are only passed on, so null ids
    and repeated ids are fine. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    period, cover = difference_cover(prime)
    if length < period + 7:
        raise ValueError("length is too small for this cover")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    long = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= run_words
    digest = base.select("doc_id", "k1", "k2", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), long.alias("long"))
    digest = scratch.keep(digest, "digest")
    total = digest.agg(F.sum("n_bytes")).first()[0] or 0

    def ties(rows: DataFrame, make, expected: float, narrow: bool, across: bool, label: str) -> DataFrame:
        """(k1, k2, at): the tied positions of each text, from the entries that ``make`` deals into buckets."""
        tasks = max(partitions(spark), ceil(expected * (7 if narrow else 15) / task_bytes))
        buckets = tasks * max(1, ceil(expected / tasks / bucket_entries))
        dealt = rows.mapInArrow(make(buckets), _PACKED).repartitionById(tasks, F.col("bucket")).sortWithinPartitions("bucket")
        told = scratch.keep(dealt.mapInArrow(_ties(narrow, tasks, across), _TOLD), f"{label}-told")
        gathered = told.repartitionById(tasks, F.col("share")).sortWithinPartitions("share").mapInArrow(_gathered, _AT)
        gathered = scratch.keep(gathered, label)
        scratch.drop(f"{label}-told")
        return gathered

    data = base.select("k1", "k2", F.encode("text", "UTF-8").alias("data"), "doc_id")
    tied = ties(data.where(F.length("data") >= length), partial(_cover_entries, length, prime), total * len(cover) / period, True, False, "tied")
    # Two of every run_words - gram + 2 words, of six bytes or so.
    alike = ties(data.where(F.length("data") >= 2 * run_words - 1), partial(_word_entries, gram, run_words), total / 50, False, True, "alike")
    alike = alike.select("k1", "k2", F.lit(True).alias("alike"))
    copies = scratch.keep(digest.groupBy("k1", "k2").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("rep"), F.count("*").alias("n")), "copies")
    looked = data.withColumn("rep", F.coalesce("doc_id", F.lit(-(2**63)))).drop("doc_id")
    wanted = tied.join(copies.drop("n"), ["k1", "k2"])
    looked = scratch.keep(looked.join(wanted, ["k1", "k2", "rep"]).select("k1", "k2", "data", "at"), "looked")
    expected = looked.agg(F.sum(F.least(F.octet_length("data").cast("long"), F.octet_length("at").cast("long") / 4 * period))).first()[0] or 0
    starts = ties(looked, partial(_suffix_entries, length, period), expected, False, False, "starts")
    removed = looked.drop("at").join(starts, ["k1", "k2"]).mapInArrow(_removal(length), "k1 long, k2 long, spans array<struct<start: long, end: long>>, kept_sha256 string")
    removed = removed.dropDuplicates(["k1", "k2"])
    known = copies.select("k1", "k2", "n").join(removed, ["k1", "k2"], "left").join(alike, ["k1", "k2"], "left").where("n > 1 OR spans IS NOT NULL OR alike")
    found = digest.join(spread(known), ["k1", "k2"], "left")
    copied = F.coalesce(F.col("n") > 1, F.lit(False))
    whole = copied & (F.col("n_bytes") >= length)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end")))
    none = F.array().cast("array<struct<start: long, end: long>>")
    found = found.withColumn("spans", F.when(whole, all_of).otherwise(F.coalesce("spans", none)))
    return found.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
        "spans",
        (F.coalesce("alike", F.lit(False)) | (copied & F.col("long"))).alias("has_repeat"),
    )
