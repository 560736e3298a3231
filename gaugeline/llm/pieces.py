"""SentencePiece encoding and decoding, with giant documents cut into chunks.

A byte-pair segmentation is the only path through the lattice of pieces on which
every two neighbouring pieces stay apart when merged on their own. So encoding
is a path problem over the max-plus semiring with weights 0 (allowed) and minus
infinity, and a document can be cut anywhere: the state at a cut is the piece
that begins before it and ends at or behind it. A chunk yields the matrix from
states at its left cut to states at its right cut, the matrices of a document
are combined associatively, and each chunk is then traced back on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch, partitions

_SPACE = "▁"


class Pieces:
    """The piece table of a model of the byte-pair kind."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        plain = [k for k in range(n) if not (self.library.is_control(k) or self.library.is_unknown(k) or self.library.is_byte(k) or self.library.is_unused(k))]
        self.id = {self.library.id_to_piece(k): k for k in plain}
        self.rank = {self.library.id_to_piece(k): self.library.get_score(k) for k in plain}
        self.byte = [self.library.piece_to_id(f"<0x{k:02X}>") for k in range(256)]
        self.longest = max(map(len, self.id))
        if any(_SPACE in p.lstrip(_SPACE) for p in self.id):
            raise ValueError("a piece of this model goes over a word boundary")
        self._apart: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        return [found] if found is not None else [self.byte[b] for b in piece.encode()]

    def apart(self, x: str, y: str) -> bool:
        """Whether byte-pair merging of x + y ends in x and y."""
        found = self._apart.get((x, y))
        if found is None:
            parts = list(x + y)
            while len(parts) > 1:
                best, k = max((self.rank.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1))
                if best == -np.inf:
                    break
                parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
            if len(self._apart) > 200_000:
                self._apart.clear()
            found = self._apart[x, y] = parts == [x, y]
        return found

    def starting(self, s: str, at: int) -> list[int]:
        """Ends of the pieces that begin at a position; one character is always a piece."""
        return [at + k for k in range(1, min(self.longest, len(s) - at) + 1) if k == 1 or s[at : at + k] in self.id]

    def crossing(self, s: str, cut: int) -> list[tuple[int, int]]:
        """States at a cut: (start, end) with start < cut <= end."""
        return [(i, j) for i in range(max(0, cut - self.longest), cut) for j in self.starting(s, i) if j >= cut]

    def stretch(self, s: str) -> list[int]:
        """The ids of whole words, the first of which begins with a space mark."""
        if s == _SPACE:
            return self.ids(s)
        return self.library.encode(s[1:].replace(_SPACE, " ")) if s else []


def _word_starts(s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last position in [lo, hi) at which a space mark follows another character, where every path passes."""
    first = next((k for k in range(max(lo, 1), hi) if s[k] == _SPACE and s[k - 1] != _SPACE), None)
    if first is None:
        return None
    return first, next(k for k in range(hi - 1, first - 1, -1) if s[k] == _SPACE and s[k - 1] != _SPACE)


def _walk(p: Pieces, s: str, states: list, stop: int, from_word: bool) -> tuple[dict, dict]:
    """Pieces reachable from each state, as bits by state, going over pieces that begin before ``stop``.

    Returns (bits of every piece, predecessors of every piece).
    """
    bits: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], list] = {}
    ending: dict[int, list] = {}
    for k, state in enumerate(states):
        bits[state] = bits.get(state, 0) | 1 << k
        ending.setdefault(state[1], []).append(state)
    if not states:
        return bits, back
    for at in range(min(ending), stop):
        if at not in ending:
            continue
        for end in p.starting(s, at):
            for prev in ending[at]:
                free = from_word and prev[0] == prev[1]
                if free or p.apart(s[prev[0] : prev[1]], s[at:end]):
                    if (at, end) not in bits:
                        ending.setdefault(end, []).append((at, end))
                    bits[at, end] = bits.get((at, end), 0) | bits[prev]
                    back.setdefault((at, end), []).append(prev)
    return bits, back


def _trace(p: Pieces, s: str, start: tuple, stop: int, goal, from_word: bool) -> list[int]:
    """Ids of the pieces on the path from a state to the goal piece (or, as a number, to any piece that ends there)."""
    _, back = _walk(p, s, [start], stop, from_word)
    ends = [goal] if isinstance(goal, tuple) else [x for x in back if x[1] == goal]
    if goal == start or (not isinstance(goal, tuple) and start[1] == goal):
        return []
    for at in ends:
        out, x = [], at
        while x != start and x in back:
            out.append(x)
            x = back[x][0]
        if x == start:
            return [k for i, j in reversed(out) for k in p.ids(s[i:j])]
    raise ValueError("no path through a chunk")


def chunk_matrix(p: Pieces, s: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """(states at lo, states at hi, max-plus matrix between them) of the chunk s[lo:hi] with its surroundings.

    States are (characters before the cut, characters behind it). At the two
    ends of a document there is one state, (0, 0).
    """
    ins = [(lo, lo)] if first else p.crossing(s, lo)
    outs = [(hi, hi)] if last else p.crossing(s, hi)
    words = _word_starts(s, max(lo, *(j for _, j in ins)), hi)
    matrix = np.full((len(ins), len(outs)), -np.inf)

    def exits(bits: dict, rows: list[int]) -> None:
        for c, out in enumerate(outs):
            found = 0
            for state, b in bits.items():
                if state == out or (last and state[1] == hi):
                    found |= b
            for r in rows:
                if found >> r & 1:
                    matrix[r, c] = 0.0

    if words is None:
        exits(_walk(p, s, ins, hi, first)[0], list(range(len(ins))))
    else:
        bits, _ = _walk(p, s, ins, words[0], first)
        arrived = 0
        for (_, end), b in bits.items():
            if end == words[0]:
                arrived |= b
        tail, _ = _walk(p, s, [(words[1], words[1])], hi, True)
        reach = np.full(len(outs), -np.inf)
        for c, out in enumerate(outs):
            if any(state == out or (last and state[1] == hi) for state in tail):
                reach[c] = 0.0
        for r in range(len(ins)):
            if arrived >> r & 1:
                matrix[r] = reach
    return [(lo - i, j - lo) for i, j in ins], [(hi - i, j - hi) for i, j in outs], matrix


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(axis=1) if x.size and y.size else np.full((x.shape[0], y.shape[1]), -np.inf)


def chunk_ids(p: Pieces, s: str, lo: int, hi: int, last: bool, into: tuple, out: tuple) -> list[int]:
    """Ids of the pieces that begin in s[lo:hi], given the states at both cuts."""
    first = into == (0, 0)
    start, goal = (lo - into[0], lo + into[1]), hi if last else (hi - out[0], hi + out[1])
    words = _word_starts(s, max(lo, start[1]), hi)
    if words is None:
        return _trace(p, s, start, hi, goal, first)
    return _trace(p, s, start, words[0], words[0], first) + p.stretch(s[words[0] : words[1]]) + _trace(p, s, (words[1], words[1]), hi, goal, True)


def _marked(text: str) -> str:
    return _SPACE + text.replace(" ", _SPACE)


def _slices(batches, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _encoder(model: bytes):
    def run(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for part in _slices(batches, 256):
            found = library.encode(part.column(2).to_pylist(), num_threads=1)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, ends[-1])))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["doc_id", "text_key", "ids"])

    return run


_CHUNK = "doc_id long, text_key long, row long, part int, lo int, last boolean, body string"


def _cutter(size: int, around: int):
    def run(batches):
        for one in _slices(batches, 16):
            for doc, key, text, row in zip(*(c.to_pylist() for c in one.columns), strict=True):
                s = _marked(text)
                for part, at in enumerate(range(0, len(s), size)):
                    lo = min(at, around)
                    body = s[at - lo : at + size + around]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "text_key": key, "row": row, "part": part, "lo": lo, "last": at + size >= len(s), "body": body}], schema=_ARROW)

    return run


_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("lo", pa.int32()), ("last", pa.bool_()), ("body", pa.string())])


_ENDS = "row long, part int, ins array<int>, outs array<int>, open array<int>"
_ENDS_ARROW = pa.schema([("row", pa.int64()), ("part", pa.int32()), *((k, pa.list_(pa.int32())) for k in ("ins", "outs", "open"))])
_STEP = "row long, part int, n_in int, n_out int, open array<int>"
_STEP_ARROW = pa.schema([("row", pa.int64()), *((k, pa.int32()) for k in ("part", "n_in", "n_out")), ("open", pa.list_(pa.int32()))])
_CUTS = "row long, part int, enter int, leave int"
_CUTS_ARROW = pa.schema([("row", pa.int64()), *((k, pa.int32()) for k in ("part", "enter", "leave"))])


def _matrices(model: bytes, size: int):
    def run(batches):
        p = Pieces(model)
        for batch in _slices(batches, 64):
            out = []
            for r in batch.to_pylist():
                hi = len(r["body"]) if r["last"] else r["lo"] + size
                ins, outs, m = chunk_matrix(p, r["body"], r["lo"], hi, r["part"] == 0, r["last"])
                out.append({"row": r["row"], "part": r["part"], "ins": [x for s in ins for x in s], "outs": [x for s in outs for x in s], "open": np.argwhere(m == 0).reshape(-1).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_ENDS_ARROW)

    return run


def _matrix(r: dict) -> np.ndarray:
    m = np.full((r["n_in"], r["n_out"]), -np.inf)
    at = np.reshape(r["open"], (-1, 2)).astype(int)
    m[at[:, 0], at[:, 1]] = 0.0
    return m


def _blocks(batches) -> Iterator[tuple[tuple[int, int], list[dict]]]:
    """((row, block), its rows), from rows sorted by both."""
    rows = (r for part in _slices(batches, 1024) for r in part.to_pylist())
    for key, group in groupby(rows, key=lambda r: (r["row"], r["block"])):
        yield key, list(group)


def _products(batches):
    """The product of the matrices of each block."""
    for (row, block), rows in _blocks(batches):
        m = _matrix(rows[0])
        for r in rows[1:]:
            m = combine(m, _matrix(r))
        yield pa.RecordBatch.from_pylist([{"row": row, "part": block, "n_in": m.shape[0], "n_out": m.shape[1], "open": np.argwhere(m == 0).reshape(-1).tolist()}], schema=_STEP_ARROW)


def _cuts(batches):
    """The number of the state at both ends of each matrix of a block, given those at the block's ends."""
    for (row, _), rows in _blocks(batches):
        mats = [_matrix(r) for r in rows]
        ahead = [np.where(np.arange(mats[0].shape[0]) == rows[0]["enter"], 0.0, -np.inf)[None, :]]
        behind = [np.where(np.arange(mats[-1].shape[1]) == rows[0]["leave"], 0.0, -np.inf)[:, None]]
        for m, w in zip(mats, reversed(mats), strict=True):
            ahead.append(combine(ahead[-1], m))
            behind.append(combine(w, behind[-1]))
        score = [a[0] + b[:, 0] for a, b in zip(ahead, reversed(behind), strict=True)]
        if any(x.max() == -np.inf for x in score):
            raise ValueError("no path through a document")
        best = [int(x.argmax()) for x in score]
        yield pa.RecordBatch.from_pylist([{"row": row, "part": r["part"], "enter": x, "leave": y} for r, x, y in zip(rows, best, best[1:], strict=False)], schema=_CUTS_ARROW)


def _scan(steps: DataFrame, scratch: Scratch, fan: int) -> DataFrame:
    """(row, part, enter, leave): the state at both cuts of every chunk, from ``steps(row, part, n_in, n_out, open)``.

    A parallel scan: blocks of ``fan`` neighbouring matrices are multiplied, and
    their products again, until a document is one block; then the states go
    down the same levels, block by block. No task holds more than ``fan``
    matrices of a document, and levels are few: their number is the logarithm
    of the longest document's chunks to the base ``fan``.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(df.sparkSession), "row", "block").sortWithinPartitions("row", "block", "part")

    levels, top = [steps], steps.agg(F.max("part")).first()[0] or 0
    block = F.expr(f"part div {fan}").cast("int").alias("block")
    while top >= fan:
        levels.append(scratch.keep(dealt(levels[-1].select("*", block)).mapInArrow(_products, _STEP), f"level-{len(levels)}"))
        top //= fan
    found = None
    for k, level in reversed(list(enumerate(levels))):
        rows = level.select("*", block)
        if found is None:
            rows = rows.withColumns({"enter": F.lit(0), "leave": F.lit(0)})
        else:
            rows = rows.join(found.withColumnRenamed("part", "block"), ["row", "block"])
        found = scratch.keep(dealt(rows).mapInArrow(_cuts, _CUTS), f"cuts-{k}")
    return found


def _tracer(model: bytes, size: int):
    def run(batches):
        p = Pieces(model)
        for batch in _slices(batches, 64):
            out = []
            for r in batch.to_pylist():
                hi = len(r["body"]) if r["last"] else r["lo"] + size
                ids = chunk_ids(p, r["body"], r["lo"], hi, r["last"], (r["in_back"], r["in_over"]), (r["out_back"], r["out_over"]))
                out.append({"doc_id": r["doc_id"], "text_key": r["text_key"], "row": r["row"], "part": r["part"], "ids": ids})
            yield pa.RecordBatch.from_pylist(
                out, schema=pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))])
            )

    return run


def encode(docs: DataFrame, model_path: str, chunk_chars: int = 16_384, fan: int = 64) -> DataFrame:
    """doc_id, text_key and ids of every document of ``docs(doc_id, text)``; the ids are those the library gives.

    text_key is a hash of the text (null counts as empty, and has no ids).
    A text of at most ``chunk_chars`` characters is one chunk, from one end of
    the document to the other. A longer one is cut into chunks that are spread
    over tasks: each gives its boundary matrix, the matrices of the document
    are combined in a scan by blocks of ``fan``, and each chunk is traced back
    with the two states found. Within a chunk, every path passes the first and the last word start,
    so the words between are encoded as they are. Repeated rows and null ids
    are encoded like others. The model is read on the driver and sent along.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    small = base.where(F.length("text") <= chunk_chars).mapInArrow(_encoder(model), "doc_id long, text_key long, ids array<int>")
    scratch = Scratch(spark, "pieces")
    around = 2 * Pieces(model).longest
    giant = base.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    chunks = scratch.keep(giant.mapInArrow(_cutter(chunk_chars, around), _CHUNK).repartition(partitions(spark), "row", "part"), "chunks")
    ends = scratch.keep(chunks.mapInArrow(_matrices(model, chunk_chars), _ENDS), "ends")
    cuts = _scan(ends.select("row", "part", F.expr("size(ins) div 2").cast("int").alias("n_in"), F.expr("size(outs) div 2").cast("int").alias("n_out"), "open"), scratch, fan)

    def state(side: str, at: str, name: str) -> list[Column]:
        return [F.get(side, 2 * F.col(at)).alias(f"{name}_back"), F.get(side, 2 * F.col(at) + 1).alias(f"{name}_over")]

    states = ends.join(cuts, ["row", "part"]).select("row", "part", *state("ins", "enter", "in"), *state("outs", "leave", "out"))
    parts = chunks.join(states, ["row", "part"]).mapInArrow(_tracer(model, chunk_chars), "doc_id long, text_key long, row long, part int, ids array<int>")
    whole = parts.groupBy("doc_id", "text_key", "row").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return small.union(whole.select("doc_id", "text_key", F.flatten("parts.ids").alias("ids")))


def _decoder(model: bytes):
    def run(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for part in _slices(batches, 256):
            ids = part.column(2).fill_null([])
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *ids.value_lengths().to_pylist()])
            texts = [library.decode(flat[x:y].tolist()) if y > x else "" for x, y in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(texts, pa.string())], names=["doc_id", "text_key", "ids", "text"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Add the text of ``encoded(doc_id, text_key, ids)``; null and empty ids give the empty text.

    The text is the original one, except that the mark U+2581 comes back as a space.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    return encoded.select("doc_id", "text_key", "ids").mapInArrow(_decoder(model), "doc_id long, text_key long, ids array<int>, text string")
