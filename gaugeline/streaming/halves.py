"""Sequences that still grow, in any order of arrival: halves and lag products that equal the batch results.

A chain's rows are kept in order as blocks in map state, beside an index of the
blocks, so a batch reads and writes the blocks its rows fall into and not the
whole chain. State stores that keep maps are needed (RocksDB).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of a block; one that grows to twice as many is split.
BLOCK = 256

_LONG, _DOUBLE, _TEXT = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


class Chain(StatefulProcessor):
    """The rows of each chain so far, (place, value), in order of place; equal places in order of arrival."""

    def __init__(self, chain: str, order: str, value: str, kind: T.DataType):
        self.chain, self.order, self.value, self.kind = chain, order, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getMapState("blocks", _struct(block=_LONG), _struct(places=T.ArrayType(_LONG), values=T.ArrayType(self.kind)))
        self.index = handle.getValueState("index", _struct(blocks=T.ArrayType(_LONG), starts=T.ArrayType(_LONG), sizes=T.ArrayType(_LONG)))

    def load(self) -> None:
        self.blocks, self.starts, self.sizes = (list(x) for x in self.index.get()) if self.index.exists() else ([], [], [])
        self.held: dict[int, tuple[list, list]] = {}

    def block(self, at: int) -> tuple[list, list]:
        """Places and values of the block that is ``at`` in order."""
        b = self.blocks[at]
        if b not in self.held:
            places, values = self.stored.getValue((b,))
            self.held[b] = (list(places), list(values))
        return self.held[b]

    def value_at(self, rank: int):
        for at, size in enumerate(self.sizes):
            if rank < size:
                return self.block(at)[1][rank]
            rank -= size
        raise IndexError(rank)

    def insert(self, place: int, value) -> tuple[int, object, object]:
        """Put a row in its place; tells its rank and the values before and after it, None at an end."""
        if not self.blocks:
            self.blocks, self.starts, self.sizes, self.held[0] = [0], [place], [0], ([], [])
        at = max(bisect_right(self.starts, place) - 1, 0)
        places, values = self.block(at)
        i = bisect_right(places, place)
        before = values[i - 1] if i else (self.block(at - 1)[1][-1] if at else None)
        after = values[i] if i < len(values) else (self.block(at + 1)[1][0] if at + 1 < len(self.blocks) else None)
        places.insert(i, place)
        values.insert(i, value)
        rank = sum(self.sizes[:at]) + i
        self.starts[at] = places[0]
        self.sizes[at] += 1
        if len(places) >= 2 * BLOCK:
            new = max(self.blocks) + 1
            self.held[new] = (places[BLOCK:], values[BLOCK:])
            del places[BLOCK:], values[BLOCK:]
            self.blocks.insert(at + 1, new)
            self.starts.insert(at + 1, self.held[new][0][0])
            self.sizes[at : at + 1] = [len(places), len(self.held[new][0])]
        return rank, before, after

    def save(self) -> None:
        for b, rows in self.held.items():
            self.stored.updateValue((b,), rows)
        self.index.update((self.blocks, self.starts, self.sizes))

    def fresh(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        found = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        return list(zip(found[self.order].tolist(), found[self.value].tolist(), strict=True))

    def close(self) -> None:
        pass


class Halves(Chain):
    """For each key its rows in all and in the first half; a row that arrives may move the middle by one."""

    def __init__(self, chain: str, order: str, key: str):
        super().__init__(chain, order, key, _TEXT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counted = handle.getMapState("counts", _struct(key=_TEXT), _struct(n=_LONG, first=_LONG))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        half, counts = sum(self.sizes) // 2, {}

        def count(name: str) -> list[int]:
            if name not in counts:
                counts[name] = list(self.counted.getValue((name,))) if self.counted.containsKey((name,)) else [0, 0]
            return counts[name]

        for place, name in self.fresh(rows):
            rank, _, _ = self.insert(place, name)
            count(name)[0] += 1
            if rank < half:  # the last row of the first half goes over to the second
                count(name)[1] += 1
                count(self.value_at(half))[1] -= 1
            if sum(self.sizes) // 2 > half:
                count(self.value_at(half))[1] += 1
                half += 1
        self.save()
        for name, pair in counts.items():
            self.counted.updateValue((name,), tuple(pair))
        yield pd.DataFrame([(key[0], name, n, first, n - first, sum(self.sizes)) for name, (n, first) in counts.items()], columns=[self.chain, self.value, "n", "n_first", "n_second", "n_chain"])


class Moments(Chain):
    """Count, sum, sum of squares and sum of lag-1 products; a row between two others takes their product's place."""

    def __init__(self, chain: str, order: str, x: str):
        super().__init__(chain, order, x, _DOUBLE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sums = handle.getValueState("sums", _struct(n=_LONG, s=_DOUBLE, q=_DOUBLE, p=_DOUBLE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        n, s, q, p = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0)
        for place, x in self.fresh(rows):
            _, before, after = self.insert(place, x)
            n, s, q = n + 1, s + x, q + x * x
            p += x * (before or 0.0) + x * (after or 0.0) - (before or 0.0) * (after or 0.0)
        self.save()
        self.sums.update((n, s, q, p))
        yield pd.DataFrame([(key[0], n, s, q, p)], columns=[self.chain, "n", "sum_x", "sum_xx", "sum_lag"])


def _processed(samples: DataFrame, processor: Chain, **out: T.DataType) -> DataFrame:
    chain, order, value = processor.chain, processor.order, processor.value
    rows = samples.where(samples[order].isNotNull() & samples[value].isNotNull())
    rows = rows.select(chain, samples[order].cast("long").alias(order), samples[value].cast(processor.kind).alias(value))
    schema = T.StructType([T.StructField(chain, samples.schema[chain].dataType), *_struct(**out).fields])
    return rows.groupBy(chain).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="None")


def stream_halves(samples: DataFrame, chain: str, order: str, key: str) -> DataFrame:
    """(chain, key, n, n_first, n_second, n_chain): rows of a key so far, in all and in either half of its chain.

    The first half are the first n // 2 rows of the chain by ``order``, a long,
    whenever they arrive. Each batch tells the keys that changed; the last row
    told of a (chain, key) is the batch result. Rows with a null order or key are
    left out.
    """
    return _processed(samples, Halves(chain, order, key), **{key: _TEXT}, n=_LONG, n_first=_LONG, n_second=_LONG, n_chain=_LONG)


def stream_ordered_moments(samples: DataFrame, chain: str, order: str, x: str) -> DataFrame:
    """(chain, n, sum_x, sum_xx, sum_lag) of each chain so far, as if its rows had arrived by ``order``, a long."""
    return _processed(samples, Moments(chain, order, x), n=_LONG, sum_x=_DOUBLE, sum_xx=_DOUBLE, sum_lag=_DOUBLE)
