"""Queries of the training-data operators, with SQL where SQL can state the result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import contamination, exact, language, minhash, pieces, pii, runs, secrets, suffixes, toxicity, trie, urls, warc
from gaugeline.llm.common import Scratch, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Public tokenizer files; the folder can be set by TOKENIZERS_DIR.
PIECES = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secret spans of each document."""
    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    counts = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS long)") for k in secrets.BASE_KINDS}
    return found.select(
        "doc_id",
        *(c.alias(k) for k, c in counts.items()),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans"),
    )


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, the removed spans as start:end, and whether it shares a passage of over 50 words."""
    found = suffixes.repeated_strings(read(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("spans", F.array_join(spans, ","))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item and the alignment."""
    return contamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


#: (verdict, host, path)
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


#: The query's vocabulary, as a file given to urls.read_terms would list it: (term, kind, weight).
URL_TERMS = (
    *((t, "strict", 1) for t in ("casino", "porn", "viagra", "xxx", "escort", "hentai", "sexcam", "kasino", "spielcasino", "porno", "казино", "порно", "赌场")),
    *((t, "soft", 2) for t in ("poker", "roulette", "jackpot", "nude", "spielautomaten", "apuestas")),
    *((t, "soft", 1) for t in ("bets", "bet", "cheap", "free", "pills", "win", "bonus", "adult", "loan", "kredit", "gratis", "billig", "gewinn", "gratuit", "gagner", "ganar", "slots", "dating", "pharmacy", "replica")),
)


def _url_sql() -> str:
    fits = {h + p: (v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))}
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, (_, c) in fits.items())
    given = " ".join(f"WHEN {c} THEN '{v}'" for v, c in fits.values())
    has = {t: rf"regexp_matches(low, '(^|[^\pL\pN]){t}([^\pL\pN]|$)')::BIGINT" for t, _, _ in URL_TERMS}
    strict, soft = (" + ".join(has[t] for t, k, _ in URL_TERMS if k == kind) for kind in ("strict", "soft"))
    weight = " + ".join(f"{w} * {has[t]}" for t, k, w in URL_TERMS if k == "soft")
    return f"""
    WITH cut AS (
      SELECT page_id, lower(url_decode(coalesce(url, ''))) AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
    ), parts AS (
      SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
             {strict} AS n_strict, {soft} AS n_soft, {weight} AS weight
      FROM cut
    )
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {given} WHEN n_strict >= 1 OR (n_soft >= {urls.SOFT_LEAST} AND weight >= {urls.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
    FROM parts
    """


@query("op5_url_filter", _url_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES, spark.createDataFrame(URL_TERMS, urls.TERMS))


@query("op6_sentencepiece_codec")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and whether they decode to its text."""
    encoded = pieces.encode(read(spark, sf_dir, "documents"), PIECES)
    return pieces.decode(encoded, PIECES).select(
        "doc_id",
        F.size("ids").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.xxhash64("text") == F.col("text_key")).alias("round_trip"),
    )


@query("op7_toxicity_ftrl")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op8_warc_archive",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
    ), q AS (
      SELECT page_id, octet_length(encode(body)) AS payload_bytes,
             array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
               lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i * 5 + 1)::BIGINT, 5))::BIGINT >> s) % 32 + 1)::BIGINT, 1)), '')), '') AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first_id
      FROM p
    )
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM q
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, rebuild the records from the archive's tables, and read those."""
    return warc.read_archive(*warc.write_archive(read(spark, sf_dir, "pages"), Scratch(spark, "warc")))


@query(
    "op10_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW same AS (PARTITION BY t)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


#: A secret of PSEUDONYM_KEY in production; this one serves demonstration.
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY", "demonstration key")


@query("op9_pii_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data, pseudonymised."""
    keys = pii.key_table(spark, {1: PSEUDONYM_KEY.encode()})
    return pii.pseudonymised(read(spark, sf_dir, "documents"), keys, 1).drop("text_key")


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest language of each document; ``rejected`` where the margin is narrow, or nothing can be told."""
    docs = read(spark, sf_dir, "documents")
    learned = language.dictionaries(docs.where("doc_id IS NOT NULL").where(~language.held_out()).select("text", "lang"))
    return language.languages(docs, learned).select(
        "doc_id", "held_out", F.coalesce("nearest", F.lit("und")).alias("lang_pred"), "score", F.col("lang").isNull().alias("rejected"), "margin"
    )


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest and digests of the periodic runs of each document, some of which are given a loop first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    told = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(told, "\n"), F.lit("\n"))).otherwise("")
    # The greatest by length, then by smallest start and period.
    top = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    found = runs.periodic_runs(docs).withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        "top.length",
        (-F.col("top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_conversation_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each with the first turns of the hundred it belongs to."""
    return trie.prefix_trie(trie.turn_sequences(read(spark, sf_dir, "conversations"), branch=100, heads=6))
