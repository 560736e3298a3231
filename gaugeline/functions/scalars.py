"""Column functions: parsing, guards, bins, hashes, clamps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_number(text: Column, strict: bool = False, default: float | None = None) -> Column:
    """A number from text; a bad one fails if ``strict``, else gives the default."""
    text = F.trim(text)
    if strict:
        return text.cast("double")
    return F.coalesce(finite(text.try_cast("double")), F.lit(default).cast("double"))


def clamp01(x: Column) -> Column:
    """The value held between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


def safe_ratio(num: Column, den: Column, guard: Column | None = None) -> Column:
    """num / den where the guard holds and den is not 0; else null."""
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    return ratio if guard is None else F.when(guard, ratio)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation (an aggregate); null without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log_ratio(p: Column, q: Column, eps: float = 1e-12) -> Column:
    return F.log((p + eps) / (q + eps))


def hardness_bin(similarity: Column, medium: float = 0.50, hard: float = 0.70) -> Column:
    """unknown, easy, medium or hard."""
    x = finite(similarity)
    return F.when(x.isNull(), "unknown").when(x < medium, "easy").when(x < hard, "medium").otherwise("hard")


def size_bin(n: Column, edges: Sequence[int] = (80, 200, 500)) -> Column:
    """Label of the size range that holds n."""
    low, out = None, None
    for edge in edges:
        label = f"<={edge}" if low is None else f"{low + 1}-{edge}"
        out = F.when(n <= edge, label) if out is None else out.when(n <= edge, label)
        low = edge
    return F.when(n.isNotNull(), out.otherwise(f">{low}"))


def classify_rules(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    return F.coalesce(*(F.when(c, F.lit(label)) for c, label in rules), F.lit(default))


def hex_number(key: Column, digits: int) -> Column:
    """The first hexadecimal digits of a key's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("bigint")


def hash_bucket_label(key: Column, percent: int = 5) -> Column:
    """PASS for about ``percent`` in 100 keys, by digest; else FAIL."""
    return F.when(hex_number(key, 8) % 100 < percent, "PASS").otherwise("FAIL")


def hash_score(hex_text: Column) -> Column:
    """The first 12 hexadecimal digits as a score from 0 to 1."""
    return F.conv(F.substring(hex_text, 1, 12), 16, 10).cast("double") / float(16**12 - 1)


def row_seed(seed: int, key: Column) -> Column:
    """A seed for each row: the seed XOR the key's CRC-32."""
    return F.crc32(key.cast("binary")).bitwiseXOR(F.lit(seed).cast("bigint"))


def task_seed(base: Column, steps: Column, start: Column, chain: Column) -> Column:
    return base + 10_000 * steps + 1_000_000 * start + 101 * chain


def normalised_size(x: Column, n: Column) -> Column:
    """x / (n log2(1 + n)); null for n of 1 or less."""
    return F.when(n > 1, x / (n * F.log2(1 + n)))


def linear_model(x: Column, slope: float, intercept: float) -> Column:
    return F.lit(slope) * x + F.lit(intercept)


def pair_credit(pos: Column, neg: Column, eps: float = 1e-12) -> Column:
    """1 if the positive scores higher, one half for a tie within eps, else 0."""
    return F.when(F.abs(pos - neg) <= eps, 0.5).when(pos > neg, 1.0).when(pos < neg, 0.0)


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def parse_edges(text: Column) -> Column:
    """Edges of ``edges=0-1,0-2;types=...`` as structs with the smaller endpoint first."""
    pairs = F.split(F.regexp_extract(text, r"edges=([^;]*)", 1), ",")
    pairs = F.filter(pairs, lambda e: e.rlike(r"^\d+-\d+$"))

    def edge(e: Column) -> Column:
        a, b = F.split_part(e, F.lit("-"), F.lit(1)).cast("int"), F.split_part(e, F.lit("-"), F.lit(2)).cast("int")
        return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    return F.transform(pairs, edge)


def parse_types(text: Column) -> Column:
    """Node types of ``edges=...;types=0,0,2`` as integers."""
    types = F.filter(F.split(F.regexp_extract(text, r"types=([^;]*)", 1), ","), lambda t: t.rlike(r"^\d+$"))
    return F.transform(types, lambda t: t.cast("int"))


def edge_set_hash(edges: Column) -> Column:
    """SHA-256 of the sorted edges, whatever their order and direction."""
    text = F.transform(edges, lambda e: F.concat_ws("-", F.least(e["u"], e["v"]).cast("string"), F.greatest(e["u"], e["v"]).cast("string")))
    return F.sha2(F.array_join(F.array_sort(text), ";"), 256)


def edge_distance(a: Column, b: Column, n: Column) -> Column:
    """Symmetric difference of two edge sets over 2 (n - 1)."""
    return F.try_divide((F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("double"), 2.0 * (n - 1))


def edge_distance_of(similarity: Column, na: Column, nb: Column, n: Column) -> Column:
    """:func:`edge_distance` of two sets from their sizes and Jaccard similarity, which tell how many they share."""
    shared = F.round((na + nb) * similarity / (1 + similarity))
    return F.try_divide(na + nb - 2 * shared, 2.0 * (n - 1))


def list_cost(found: Column, target: Sequence[float], n: int, empty: float = 1e9) -> Column:
    """Squared distance of the first n entries of a list from a target; ``empty`` for an empty list."""
    goal = F.array(*(F.lit(float(t)) for t in target[:n]))
    k = F.least(F.size(found), F.lit(min(n, len(target))))
    parts = F.zip_with(F.slice(found, 1, k), F.slice(goal, 1, k), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(found) == 0, F.lit(empty)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
