"""Language of texts by compression with one dictionary for each language.

A dictionary is raw content: lines of texts that are known to be in the
language. A text is cut into portions, each is compressed with every
dictionary, and the language whose dictionary makes the whole smallest wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bounded sample a dictionary is made of: texts of a language, lines of them, characters of a line, bytes in all.
TEXTS, LINES, LINE, BYTES = 400, 1024, 512, 1 << 16
#: Bytes that are compressed together; one portion never learns from another.
PORTION = 2048
#: A best language whose size is not smaller than the second one's by this share is rejected.
MARGIN = 0.01
#: Shares of size are made a score by this factor: a gain of 5 % over one other language gives 0.88.
SHARPNESS = 40.0


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of ids by which predictions are judged."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def dictionaries(labelled: DataFrame, texts: int = TEXTS, lines: int = LINES, most: int = BYTES, max_languages: int = 200) -> dict[str, bytes]:
    """language -> dictionary of ``labelled(text, lang)``, in the order of the languages.

    Of each language the ``texts`` different texts with the smallest hashes are
    cut into lines, and of these the ``lines`` with the smallest hashes are
    taken, LINE characters of each, up to ``most`` bytes. Repeated texts and
    lines count once, and a line that occurs in several languages, such as a
    licence, only where a language has no other. Rows without a text or a
    language are left out. The driver holds ``max_languages`` times these
    bounds at most; more languages are refused.
    """
    rows = labelled.where("lang IS NOT NULL AND trim(text) <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    by = Window.partitionBy("lang")
    ids = rows.select("lang", "h").distinct()
    counts = {r.lang: r["count"] for r in ids.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted(counts)
    # Hashes are spread evenly, so those under a bound that leaves four times as many are enough to rank.
    below = [(name, int((min(1.0, 4 * texts / n) - 0.5) * 2**64) - 1) for name, n in counts.items()]
    near = ids.join(F.broadcast(labelled.sparkSession.createDataFrame(below, "lang string, most long")), "lang").where("h <= most")
    few = near.withColumn("r", F.row_number().over(by.orderBy("h"))).where(F.col("r") <= texts).select("lang", "h")
    # At most texts * max_languages rows of a name and a number.
    found = rows.join(F.broadcast(few), ["lang", "h"]).select("lang", F.explode(F.split("text", "\n")).alias("line")).select("lang", F.trim("line").alias("line")).where("line <> ''")
    listed = found.groupBy("line").agg(F.collect_set("lang").alias("langs"))
    listed = listed.select((F.size("langs") > 1).alias("common"), F.explode("langs").alias("lang"), F.left("line", F.lit(LINE)).alias("line"), F.xxhash64("line").alias("h"))
    listed = listed.withColumn("r", F.row_number().over(by.orderBy("common", "h", "line"))).where(F.col("r") <= lines)
    held: dict[str, list[bytes]] = {name: [] for name in names}
    for r in listed.orderBy("lang", "r").collect():
        held[r.lang] += [r.line.encode()] if not r.common or not held[r.lang] else []
    return {name: b"\n".join(x)[:most].ljust(8) for name, x in held.items()}


def _classifier(dictionaries: dict[str, bytes], schema: pa.Schema):
    def run(batches):
        import math

        import zstandard

        how = zstandard.ZstdCompressionParameters(
            window_log=17,
            chain_log=17,
            hash_log=17,
            search_log=4,
            min_match=4,
            target_length=16,
            strategy=zstandard.STRATEGY_LAZY2,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
        )
        compress = {}
        for name, content in dictionaries.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            compress[name] = zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress
        for batch in batches:
            best, score, margin = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not text or not compress or not any(map(str.isalpha, text)):
                    best.append(None)
                    score.append(0.0)
                    margin.append(None)
                    continue
                data = text.encode()
                parts = [data[p : p + PORTION] for p in range(0, len(data), PORTION)]
                sizes = sorted((sum(len(f(part)) for part in parts), name) for name, f in compress.items())
                least = sizes[0][0]
                best.append(sizes[0][1])
                score.append(1.0 / sum(math.exp(-SHARPNESS * (size - least) / least) for size, _ in sizes))
                margin.append((sizes[1][0] - least) / sizes[1][0] if len(sizes) > 1 else 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(best, pa.string()), pa.array(score), pa.array(margin, pa.float64())], schema=schema)

    return run


def languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang, nearest, score and margin of every row of ``docs(doc_id, text)``.

    ``nearest`` is the language whose dictionary makes the whole text smallest
    (the first by name of equal ones), ``margin`` the share by which its size is
    under the second one's (1 if there is one language only), and ``lang`` is
    ``nearest`` unless the margin is under ``margin``: such a text is rejected
    and has none. ``score`` is 1 / sum of exp(-SHARPNESS * excess share of size)
    over all languages. Null texts, texts without a letter, and all texts if no
    language was learned, have a null language and a score of 0. Texts of any
    length are compressed whole, portion by portion. Documents are judged where
    they lie; nothing is shuffled. Null ids and repeated rows are returned as
    they come, extra columns are ignored, and an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = "doc_id long, held_out boolean, nearest string, score double, margin double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    found = base.mapInArrow(_classifier(dictionaries, to_arrow_schema(StructType.fromDDL(out))), out)
    return found.select("doc_id", "held_out", F.when(F.col("margin") >= margin, F.col("nearest")).alias("lang"), "nearest", "score", "margin")
