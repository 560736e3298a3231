"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_UNTRAINED = -20.0
_SLICE = 256
_PUNCTUATION = bytes(32 if chr(k) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else k for k in range(256))


def features(text: str | None, bits: int) -> np.ndarray:
    """Hashed word unigrams, bigrams and skip-grams over one and two words, as indices under 2**bits with repeats."""
    words = (text or "").encode().lower().translate(_PUNCTUATION).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = [h] + [(h[:-gap] * _ODD + np.uint64(gap)) ^ (h[gap:] * _MIX) for gap in (1, 2, 3) if len(h) > gap]
    x = np.concatenate(parts)
    return (((x ^ (x >> np.uint64(31))) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _extracted(bits: int):
    """Labelled texts -> their distinct features, so that texts stay where they are read."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                found = [np.unique(features(t, bits)).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _ROW[:-1]), pa.array(found, pa.binary())], names=_ROW)

    return run


_ROW = ["turn", "doc_id", "label", "text_key", "features"]


def fit(rows: list[np.ndarray], labels: list[float], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) other than 0 after FTRL-proximal learning over the rows, ``epochs`` times in seeded orders.

    A feature whose weight is 0 moves by less than 1 in each row that holds it,
    so one in l1 / epochs rows or fewer never passes the penalty and is left out.
    The list of rows is changed in place, so that the full ones are let go.
    """
    z, n, seen = (np.zeros((1 << bits) + 1) for _ in range(3))
    for at in rows:
        seen[at] += 1
    free = np.int32(1 << bits)  # the bias, without penalty
    for k, at in enumerate(rows):
        rows[k] = np.append(at[seen[at] * epochs > l1], free)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[k]
            zs, ns = z[at], n[at]
            lasso = np.full(len(at), l1)
            lasso[-1] = 0
            w = np.where(np.abs(zs) <= lasso, 0.0, -(zs - np.sign(zs) * lasso) / ((beta + np.sqrt(ns)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    lasso = np.full(len(z), l1)
    lasso[-1] = 0
    w = np.where(np.abs(z) <= lasso, 0.0, -(z - np.sign(z) * lasso) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return at, w[at]


def _trainer(bits: int, *settings):
    def run(batches):
        rows, labels = [], []
        for batch in batches:
            rows += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("features")]
            labels += batch.column("label").to_pylist()
        at, weights = fit(rows, labels, bits, *settings)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weights, pa.float64())], names=["feature", "weight"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    bits: int = 20,
    epochs: int = 6,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 12.0,
    l2: float = 0.0,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Fit weights (feature, weight) on ``labels(doc_id, label)`` joined with ``docs(doc_id, text)``.

    At most ``max_rows`` labelled rows are used, taken in the order of a hash
    of doc_id; the texts are read whole. The bound holds for the labels and
    again for the rows that they meet, so repeated ids do not pass it.
    Features are taken where the texts lie. Online learning goes over them in
    one task, ``epochs`` times; per-coordinate rates and the L1 penalty leave
    few weights, never more than 2**bits + 1. Feature 2**bits is the bias. Rows
    with a null id or label are left out. Without any row there are no weights,
    and then nothing scores as toxic.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    some = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label", F.xxhash64("doc_id").alias("turn"))
    some = some.orderBy("turn", "doc_id", "label").limit(max_rows)
    order = ["turn", "doc_id", "label", "text_key"]
    rows = docs.join(F.broadcast(some), "doc_id").select("turn", "doc_id", "label", F.xxhash64("text").alias("text_key"), "text")
    rows = scratch.keep(rows.mapInArrow(_extracted(bits), "turn long, doc_id long, label int, text_key long, features binary"), "rows")
    if rows.count() > max_rows:  # ids repeat
        rows = scratch.keep(rows.orderBy(*order).limit(max_rows), "first-rows")
    rows = rows.repartition(1).sortWithinPartitions(*order)
    return scratch.keep(rows.mapInArrow(_trainer(bits, epochs, alpha, beta, l1, l2), "feature long, weight double"), "weights")


def scorer(weights: DataFrame, bits: int = 20) -> Callable[[Column], Column]:
    """A function from a text column to its score (0 to 1).

    Each distinct n-gram of the whole text counts once. A null text scores as
    an empty one, by the bias. Only the text goes to the Python worker and only
    the score comes back, a slice of rows at a time.
    """
    table = {row.feature: row.weight for row in weights.collect()}  # at most 2**bits + 1 pairs
    table = table or {1 << bits: _UNTRAINED}
    bias = table.pop(1 << bits, 0.0)
    at, w = np.array(list(table), np.int64), np.array(list(table.values()), float)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = np.zeros(1 << bits)
        dense[at] = w
        used = dense != 0
        for part in parts:
            out = []
            for k in range(0, len(part), _SLICE):
                for text in part.slice(k, _SLICE).to_pylist():
                    found = features(text, bits)
                    found = np.unique(found[used[found]])
                    out.append(1 / (1 + np.exp(-np.clip(bias + dense[found].sum(), -35, 35))))
            yield pa.array(out, pa.float64())

    return score


def with_score(docs: DataFrame, weights: DataFrame, bits: int = 20, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (a score from 0 to 1) behind the others; a column of that name is replaced.

    Repeated rows and null ids are scored like any others; see :func:`scorer`.
    """
    return docs.withColumn(name, scorer(weights, bits)(F.col(text_col)))


def held_out(col="doc_id"):
    """Whether crc32 of the id as text leaves 0 on division by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from ``labels(doc_id, toxic)``.

    Only labels of rows that are not held out are learned, and only the text is
    an input of the score. A null id is not held out. Labels of documents that
    are missing, and extra columns of either table whatever their names, are
    ignored. Empty tables give no rows; very long texts are scored whole.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    found = with_score(base, train(base, known, **training), training.get("bits", 20))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
