"""Periodic runs of words, by recompression.

The words of a document are compressed in rounds: blocks of equal symbols
become one symbol, then pairs of a symbol of one half of the alphabet with one
of the other. The rule looks at the symbols alone, so equal stretches are
compressed equally but at their ends. A query for the longest common extension
of two places climbs the levels while both stand at equal borders, and comes
down again where they differ; this needs a few steps on each level and no
suffix array.

A run of period q and two periods or more holds a multiple of q whose word is
the same q further on. These places, n / q for each q, are the candidates; the
extensions to both sides tell exactly where a run begins and ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are compressed together, and candidates that are held at once.
GROUP_WORDS, CANDIDATES = 1 << 19, 1 << 19

RUNS = "array<struct<start: long, length: long, period: long>>"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _half(symbols: np.ndarray, level: int) -> np.ndarray:
    """The half of the alphabet that each symbol is in on a level."""
    x = (symbols.astype(np.uint64) + np.uint64(level)) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return (x >> np.uint64(60)).astype(np.int64) & 1


def _named(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 on for the different codes."""
    found, names = np.unique(codes, return_inverse=True)
    return names.reshape(-1), len(found)


class Grammar:
    """The levels of a sequence of symbols; symbols at its two ends must be unique."""

    def __init__(self, symbols: np.ndarray):
        names, kinds = _named(symbols)
        self.levels = []
        number = 0
        while kinds < len(names):
            blocks = number % 2 == 0
            if blocks:
                head = np.ones(len(names), bool)
                head[1:] = names[1:] != names[:-1]
                at = np.flatnonzero(head)
                size = np.diff(np.append(at, len(names)))
                above, kinds = _named(names[at] * (int(size.max()) + 1) + size)
            else:
                half = _half(names, number)
                ones = (half[:-1] == 1) & (half[1:] == 0)
                twos = (half[:-1] == 0) & (half[1:] == 1)
                pairs = ones if ones.sum() > twos.sum() else twos
                head = np.ones(len(names), bool)
                head[1:] = ~pairs
                at = np.flatnonzero(head)
                second = np.where(np.append(pairs, False)[at], names[np.minimum(at + 1, len(names) - 1)] + 1, 0)
                above, kinds = _named(names[at] * (kinds + 1) + second)
            up = np.cumsum(head) - 1
            self.levels.append((names, head, np.append(at, len(names)), up, blocks))
            names = above
            number += 1
        self.top = names

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from places x and y on, x < y, in direction ``step``, are equal; both must end at a unique symbol."""
        begun = x
        x, y = x.copy(), y.copy()
        left = np.zeros(len(x), np.int64)  # the level at which a query found a difference
        live = np.arange(len(x))
        for k, (names, head, at, up, blocks) in enumerate(self.levels):  # at: first place of each symbol of the next level, and the end
            if not len(live):
                break
            a, b = x[live], y[live]
            a, b = self._passed(names, head, at, up, blocks, a, b, step)
            same = names[a] == names[b]
            x[live], y[live] = np.where(same, up[a], a), np.where(same, up[b], b)
            left[live[~same]] = k
            live = live[same]
        # On the topmost level all symbols are unique.
        left[live] = len(self.levels)
        for k in reversed(range(len(self.levels))):
            names, head, at, up, blocks = self.levels[k]
            live = np.flatnonzero(left > k)
            if not len(live):
                continue
            a, b = (at[v[live]] if step > 0 else at[v[live] + 1] - 1 for v in (x, y))
            x[live], y[live] = self._shared(names, at, up, blocks, a, b, step)
        return (x - begun) * step

    @staticmethod
    def _passed(names, head, at, up, blocks, a, b, step):
        """Places a and b moved over equal symbols to where both, or one and a different symbol, stand at borders of the next level."""
        same = names[a] == names[b]
        if blocks:
            # Of two blocks of one symbol, as much as both still have; what is left of the longer one meets another symbol.
            ra, rb = _rest(at, up, a, step), _rest(at, up, b, step)
            whole = same & (_edge(head, a, step)) & (_edge(head, b, step)) & (ra == rb)
            move = np.where(same & ~whole, np.minimum(ra, rb), 0)
        else:
            move = (same & ~(_edge(head, a, step) & _edge(head, b, step))).astype(np.int64)
        return a + step * move, b + step * move

    @staticmethod
    def _shared(names, at, up, blocks, a, b, step):
        """Places a and b, at the borders of different symbols of the next level, moved over what these have in common."""
        same = names[a] == names[b]
        if blocks:
            move = np.where(same, np.minimum(_rest(at, up, a, step), _rest(at, up, b, step)), 0)
        else:
            move = same.astype(np.int64)
        return a + step * move, b + step * move


def _rest(at: np.ndarray, up: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
    """Symbols of its block from a place on in direction ``step``."""
    return at[up[v] + 1] - v if step > 0 else v - at[up[v]] + 1


def _edge(head: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether a symbol is the first (going right) or the last (going left) in its symbol of the next level."""
    if step > 0:
        return head[at]
    out = np.ones(len(at), bool)
    inside = at + 1 < len(head)
    out[inside] = head[at[inside] + 1]
    return out


def _candidates(first: np.ndarray, size: np.ndarray, periods):
    """(place, period) of the grids of documents that lie at ``first``, in bounded portions.

    The grid of period q has the multiples of q from the start of the document that have a word q further on.
    """
    doc = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = (size[doc] - 1) // q
    sums = np.cumsum(count)
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + CANDIDATES, side="right")))
        n = count[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield first[doc[row]] + k * q[row], q[row]
        lo = hi


def find_runs(codes: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, ordered by document, start and period.

    ``codes`` are the words of documents of ``size`` words each, one after the
    other, as numbers from 0 on; equal words of one document have equal numbers.
    """
    n = len(size)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) + doc + 1
    total = len(codes) + n + 1
    # Words of different documents differ, and a unique symbol stands before, between and behind documents.
    kinds = int(codes.max()) + 1 if len(codes) else 1
    symbols = np.full(total, -1, np.int64)
    symbols[place] = doc * kinds + codes
    gaps = np.flatnonzero(symbols < 0)
    symbols[gaps] = n * kinds + np.arange(len(gaps))
    grammar = Grammar(symbols)
    words = symbols
    first = begin + np.arange(n) + 1
    found = []
    longest = np.minimum(size // 2, np.maximum(size - 1, 0))
    longest[size < least] = 0
    for i, q in _candidates(first, size, longest):
        hit = words[i] == words[i + q]
        i, q = i[hit], q[hit]
        if not len(i):
            continue
        ahead = grammar.extension(i, i + q, 1)
        back = grammar.extension(i - 1, i + q - 1, -1)
        start, length = i - back, q + ahead + back
        kept = length >= np.maximum(least, 2 * q)
        found.append(np.stack([start[kept], length[kept], q[kept]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # A stretch that is found with several periods has the smallest; the others are multiples of it.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    of = np.searchsorted(first, rows[:, 0], side="right") - 1
    order = np.lexsort((rows[:, 2], rows[:, 0], of))
    rows, of = rows[order], of[order]
    return of, rows[:, 0] - first[of], rows[:, 1], rows[:, 2]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def _scan(least: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            texts = batch.column("text")
            held, lo, words = [], 0, 0
            for k in range(len(texts)):
                held.append((texts[k].as_py() or b"").split())
                words += len(held[-1])
                if words >= GROUP_WORDS or k + 1 == len(texts):
                    yield _rows(ids.slice(lo, len(held)), held, least, schema)
                    held, lo, words = [], k + 1, 0

    return run


def _rows(ids: pa.Array, held: list[list[bytes]], least: int, schema: pa.Schema) -> pa.RecordBatch:
    size = np.fromiter((len(w) for w in held), np.int64, len(held))
    flat = pa.array([w for words in held for w in words], pa.large_binary())
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    of, start, length, period = find_runs(codes, size, least)
    cut = np.searchsorted(of, np.arange(len(held) + 1))
    texts = [_collapsed(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(held, cut[:-1], cut[1:], strict=True)]
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(schema.field("runs").type.value_type))
    runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs)
    return pa.RecordBatch.from_arrays([ids, runs.cast(schema.field("runs").type), pa.array(texts, pa.binary())], schema=schema)


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs and collapsed of every row of ``docs(doc_id, text)``.

    A word is a longest stretch of bytes other than space and 09 to 0D. A run is
    a stretch of words with smallest period q, of ``least`` words and two
    periods or more, that no word beside it continues; ``runs`` has (start,
    length, period), numbered from word 0, by start and then period.
    ``collapsed`` has the words, with one space between, without those that
    stand in a run after its first period.

    Documents are judged where they lie and nothing is shuffled; a task holds
    one batch, or one text if that is longer, with a few numbers for each word
    and level. Null and empty texts have no words. Repeated rows and null ids
    are returned as they come. Extra columns are ignored, and an empty table
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = f"doc_id long, runs {RUNS}, collapsed binary"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = base.mapInArrow(_scan(least, to_arrow_schema(StructType.fromDDL(out))), out)
    return found.select("doc_id", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def looped(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose crc32 h is a multiple of ten its words with a loop, one space between them.

    Of n words, word i >= a becomes word a + (i - a) % p, where g = floor(h / 10),
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null ids have no loop.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        bound = F.array(F.struct(a.alias("a"), p.alias("p")))  # reckoned once for all words
        told = F.transform(bound, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < b["a"], i).otherwise(b["a"] + (i - b["a"]) % b["p"]))), " "))
        return F.when(n > 0, F.get(told, F.lit(0))).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), again), F.lit(0))).otherwise(text)
