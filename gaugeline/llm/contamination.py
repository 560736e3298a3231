"""Benchmark passages in documents, by spaced seeds. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import Scratch

#: Masks; a 0 is a position that may hold any token. Wherever 3 of 13 or 12, or 2
#: of 11 or 10 consecutive tokens are replaced, one of them still fits beside these.
MASKS = ("11101", "100111")
#: Tokens of the shortest item that is looked for.
LEAST_TOKENS = 10
#: Seeds of more items than this are lengthened by two tokens more.
HOT_ITEMS = 8


def tokens(col):
    """Lower-case runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{M}\p{N}]+"), "")


def _more(mask: str) -> list[tuple[int, int]]:
    """Two places besides a mask, counted from its start, of which some are equal wherever a passage counts.

    A passage has up to 13 tokens with 3 replaced, or 12 with 3, or 11 or 10 with
    2, and the mask somewhere in it. Outside the mask stand neighbours two by
    two, to the left and to the right; where an odd number of tokens is on a
    side, the outermost is alone. If the replaced tokens are enough to break all
    the twos, then two of those alone and of the mask's gaps are left.
    """
    size, gaps = len(mask), [j for j, x in enumerate(mask) if x == "0"]
    outer = 13 - size
    left = [(-i, -i - 1) for i in range(1, outer + 1, 2)]
    right = [(size + i, size + i + 1) for i in range(0, outer, 2)]
    alone = [-a for a in range(1, outer + 1, 2)] + [size + b - 1 for b in range(1, outer + 1, 2)]
    both = [(-a, size + n - a - 1) for n in range(outer, LEAST_TOKENS - size - 1, -1) if n % 2 == 0 for a in range(1, n, 2)]
    return [*left, *right, *((gaps[0], x) for x in alone), *both, *([tuple(gaps)] if len(gaps) > 1 else [])]


def _longer() -> Column:
    """Keys of a seed with two more tokens each, of ``hashes``, ``at``, ``mask`` and ``seed``."""

    def keys(mask: str) -> Column:
        found = []
        for k, places in enumerate(_more(mask)):
            x, y = (F.get("hashes", F.col("at") + p) for p in places)
            found.append(F.when(x.isNotNull() & y.isNotNull(), F.xxhash64("seed", F.lit(k), x, y)))
        return F.array_compact(F.array(*found))

    out = keys(MASKS[-1])
    for k, mask in enumerate(MASKS[:-1]):
        out = F.when(F.col("mask") == k, keys(mask)).otherwise(out)
    return out


def _seeds(df: DataFrame) -> DataFrame:
    """Add (at, mask, seed) for each mask at each position of ``hashes``."""
    df = df.where(F.size("hashes") >= LEAST_TOKENS)

    def masked(k: int, mask: str):
        at = [j for j, x in enumerate(mask) if x == "1"]
        return F.transform(F.sequence(F.lit(0), F.size("hashes") - len(mask)), lambda i: F.xxhash64(F.lit(k), *(F.get("hashes", i + j) for j in at)))

    placed = df.select("*", F.posexplode(F.flatten(F.array(*(masked(k, m) for k, m in enumerate(MASKS))))).alias("at", "seed"))
    # Places count the positions mask after mask.
    first, at, no = F.lit(0), F.col("at"), F.lit(0)
    for k, mask in enumerate(MASKS[:-1], 1):
        first = first + F.size("hashes") - (len(mask) - 1)
        at = F.when(F.col("at") >= first, F.col("at") - first).otherwise(at)
        no = F.when(F.col("at") >= first, F.lit(k)).otherwise(no)
    return placed.withColumns({"at": at, "mask": no})


def _hashed(df: DataFrame, text: str, **keys) -> DataFrame:
    """The keys, and the token hashes of a text."""
    df = df.select(*(c.alias(k) for k, c in keys.items()), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return df.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    least: float = 0.75,
    block_rows: int = 500_000,
    passes: int = 8,
) -> DataFrame:
    """Documents of ``docs(doc_id, text)`` that hold a passage of ``benchmark(item_id, text)``.

    Returns a row per document and item: doc_id, text_key (hash of the text),
    item_id, n_equal (tokens equal on the alignment), n_overlap (tokens
    aligned) and doc_start (token at which the item begins; negative if its
    head is missing).

    Seeds of both sides, which leave out the masked positions, are joined; each
    hit fixes an alignment of the item with the document. An alignment counts
    if some ``window`` consecutive aligned tokens, or the whole item if it is
    shorter, have a share of ``least`` or more that are equal. Every position
    of every whole text is looked up. With the default ``window`` and ``least``
    every alignment that counts has a seed; smaller ones may have none.

    Items with equal tokens are looked for once. A seed that stands in more than
    HOT_ITEMS items, such as a common phrase, is not joined as it is: it is
    lengthened on both sides by two more tokens (see :func:`_more`), so items
    and documents that share the phrase alone never meet. The item seeds are
    broadcast in blocks of about ``block_rows`` rows, each under 40 bytes, so
    what is broadcast stays under 20 MB; each block is a pass over the
    documents, in which only alignments are shuffled. A benchmark of more than
    ``passes`` blocks is joined by shuffles of the document seeds instead. Items and
    documents under ten tokens, null and empty texts match nothing. Texts of
    any length are read whole. Equal rows are returned once; null ids are
    returned as such. Extra columns are ignored; an empty table on either side
    gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    listed = _hashed(benchmark, "text", item_id=F.col("item_id").cast("long")).where(F.size("hashes") >= LEAST_TOKENS)
    listed = scratch.keep(listed.withColumn("item_key", F.xxhash64("hashes")).distinct(), "listed")
    items = scratch.keep(listed.select("item_key", "hashes").distinct(), "items")
    named = ["item_key", F.col("at").alias("item_at"), F.size("hashes").alias("item_n")]
    seeds = scratch.keep(_seeds(items).select("seed", "mask", *named, "hashes").distinct(), "seeds")
    hot = scratch.keep(seeds.groupBy("seed").agg(F.count_distinct("item_key").alias("n")).where(F.col("n") > HOT_ITEMS).select("seed"), "hot")
    cold = seeds.join(hot, "seed", "left_anti").select("seed", "item_key", "item_at", "item_n")
    posts = seeds.join(hot, "seed", "left_semi").withColumn("at", F.col("item_at")).select(F.explode(_longer()).alias("key"), "item_key", "item_at", "item_n")
    posts = scratch.keep(posts.distinct(), "posts")
    cold = scratch.keep(cold.distinct(), "cold")
    n_hot = hot.count()
    blocks = max(1, ceil((cold.count() + posts.count()) / max(1, block_rows - n_hot)))
    words = _hashed(docs, "text", doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64("text"))
    placed = _seeds(words)
    start = F.expr("at - item_at").alias("doc_start")
    near = F.expr("slice(hashes, greatest(doc_start, 0) + 1, item_n + least(doc_start, 0))").alias("near")
    none = {"item_key": F.lit(None).cast("long"), "item_at": F.lit(None).cast("int"), "item_n": F.lit(None).cast("int")}
    if blocks <= passes and n_hot < block_rows // 2:
        hits = None
        for k in range(blocks):
            own = cold.where(F.pmod(F.xxhash64("item_key", "item_at", "seed"), F.lit(blocks)) == k)
            found = placed.join(F.broadcast(own.unionByName(hot.withColumns(none)) if n_hot else own), "seed")
            if n_hot:
                longer = posts.where(F.pmod("key", F.lit(blocks)) == k).select("key", *(F.col(c).alias(f"p_{c}") for c in none))
                keys = F.when(F.col("item_key").isNull(), _longer()).otherwise(F.array(F.lit(None).cast("long")))
                found = found.select("doc_id", "text_key", "hashes", "at", *none, F.explode(keys).alias("key")).join(F.broadcast(longer), "key", "left")
                found = found.withColumns({c: F.coalesce(c, f"p_{c}") for c in none}).where("item_key IS NOT NULL")
            found = found.select("*", start).select("doc_id", "text_key", "item_key", "doc_start", near)
            hits = found if hits is None else hits.union(found)
    else:
        place = [F.col("doc_id").alias("spot_id"), F.col("text_key").alias("spot_key"), "at"]
        spots = placed.select(*place, "seed").join(cold, "seed").select("spot_id", "spot_key", "item_key", "item_n", start)
        far = placed.join(hot, "seed").select(*place, F.explode(_longer()).alias("key")).join(posts, "key").select("spot_id", "spot_key", "item_key", "item_n", start)
        spots = scratch.keep(spots.union(far).distinct(), "spots")
        same = F.col("doc_id").eqNullSafe(F.col("spot_id")) & (F.col("text_key") == F.col("spot_key"))
        hits = words.join(spots, same).select("doc_id", "text_key", "item_key", "doc_start", near)
    aligned = scratch.keep(hits.distinct(), "aligned").join(items, "item_key")
    aligned = aligned.withColumn("item_part", F.expr("slice(hashes, greatest(-doc_start, 0) + 1, size(near))"))
    aligned = aligned.withColumn("equal", F.expr("zip_with(near, item_part, (x, y) -> if(x = y, 1, 0))"))
    aligned = aligned.withColumn("wide", F.least(F.lit(window), F.size("hashes")))
    dense = F.expr(
        "size(equal) >= wide AND exists(sequence(1, greatest(size(equal) - wide + 1, 1)), "
        f"s -> aggregate(slice(equal, s, wide), 0, (a, x) -> a + x) >= {least}D * wide)"
    )
    total = F.expr("aggregate(equal, 0, (a, x) -> a + x)")
    aligned = aligned.where(dense).select("doc_id", "text_key", "item_key", F.struct(total.alias("n_equal"), F.size("equal").alias("n_overlap"), (-F.col("doc_start")).alias("back")).alias("best"))
    best = aligned.groupBy("doc_id", "text_key", "item_key").agg(F.max("best").alias("best"))
    return best.join(listed.select("item_key", "item_id"), "item_key").select("doc_id", "text_key", "item_id", "best.n_equal", "best.n_overlap", (-F.col("best.back")).alias("doc_start"))
