"""URL verdicts: domain rules first, then a weighted vocabulary matched by an automaton."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TERMS = "term string, kind string, weight int"
#: Soft terms of a joint weight of SOFT_LIMIT or more block a URL if there are SOFT_LEAST different ones.
SOFT_LIMIT, SOFT_LEAST = 2, 2


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from CSV files with the columns term, kind (strict or soft) and weight, below a header line."""
    return spark.read.csv(path, TERMS, header=True, encoding="UTF-8")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to a slash, question mark, hash sign or the end, with A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("-"), url), "://", 1))
    behind = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 3))
    return F.coalesce(F.translate(F.regexp_extract(behind, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to a question mark, hash sign or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("-"), url), "://", 1))
    behind = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 3))
    return F.coalesce(F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _counter(strict: frozenset[str], soft: dict[str, int]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in (*strict, *soft):
            automaton.add_word(word, word)
        automaton.make_automaton()

        for batch in batches:
            n_strict, n_soft, weight = [], [], []
            for url in batch.column("url_").to_pylist():
                low = unquote(url or "").lower()
                found = set()
                for at, word in automaton.iter(low) if len(automaton) else ():
                    start = at - len(word) + 1
                    if word not in found and (start == 0 or not low[start - 1].isalnum()) and (at + 1 == len(low) or not low[at + 1].isalnum()):
                        found.add(word)
                n_strict.append(len(found & strict))
                n_soft.append(len(found - strict))
                weight.append(sum(soft[w] for w in found - strict))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url_"), pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array(weight, pa.int64())],
                names=["page_id", "url_", "n_strict", "n_soft", "weight"],
            )

    return run


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    terms: DataFrame,
    soft_limit: int = SOFT_LIMIT,
    soft_least: int = SOFT_LEAST,
    max_terms: int = 1_000_000,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft of every row of ``pages(page_id, url)``.

    ``rules`` are (verdict, host, path). A rule fits its host and all its
    subdomains if the path begins with the rule's; the longest rule wins, the
    first of equally long ones. Where none fits, one automaton looks for all of
    ``terms(term, kind, weight)`` in the URL, after percent-decoding and in
    lower case; a term counts if no letter or digit of any script stands next to
    it, and once however often it occurs. The URL is blocked for one strict term, or
    for ``soft_least`` different soft terms with a joint weight of
    ``soft_limit`` or more. A term that is listed as strict is not soft, and
    one listed twice has its largest weight. Null and empty terms are left out,
    and a vocabulary of more than ``max_terms`` rows is refused, since every
    task holds it.

    A null URL, or one without ``://``, has an empty host and path; the terms
    of the latter still count. URLs of any length are read whole. Rows are
    judged where they lie, repeated ones and null ids alike; an empty table
    gives no rows. Extra columns are ignored.
    """
    listed = terms.where("term <> ''").groupBy(F.lower("term").alias("term")).agg(F.bool_or(F.col("kind") == "strict").alias("hard"), F.max(F.coalesce("weight", F.lit(1))).alias("weight"))
    listed = listed.limit(max_terms + 1).collect()
    if len(listed) > max_terms:
        raise ValueError(f"the vocabulary has more than {max_terms} terms")
    strict = frozenset(r.term for r in listed if r.hard)
    soft = {r.term: r.weight for r in listed if not r.hard}
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url_"))
    found = base.mapInArrow(_counter(strict, soft), "page_id long, url_ string, n_strict long, n_soft long, weight long")
    found = found.withColumns({"host": host_of(F.col("url_")), "path": path_of(F.col("url_"))})
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for _, h, p in order]
    none = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(c, F.lit(h + p)) for c, (_, h, p) in zip(fits, order, strict=True)), none)
    given = F.coalesce(*(F.when(c, F.lit(v)) for c, (v, _, _) in zip(fits, order, strict=True)), none)
    several = (F.col("n_soft") >= soft_least) & (F.col("weight") >= soft_limit)
    own = F.when((F.col("n_strict") >= 1) | several, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(given, own).alias("verdict"), "n_strict", "n_soft")
