"""Format-preserving pseudonyms of personal data. DataFrame functions only.

A value is a row of symbols, each with a radix: ten for a digit, 26 for a
letter, 256 for an octet, and so on. A Feistel network permutes the rows of
symbols with the same radices: in each round one half is shifted, symbol by
symbol and modulo its radix, by a keyed digest of the other half. It keeps the
format, is one to one, and maps equal values to equal pseudonyms everywhere.
The digest is an HMAC; its key comes from a table, so it stands in no plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind -> pattern; at one place the first kind listed here wins. Repeats without a bound are possessive: they take no stack, however long a text is.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ -]?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])",
}
ROUNDS = 8
#: Dates from 1800 on, over the 400 years after which the calendar repeats: 146097 days, 189 times 773.
_ERA, _DAYS = "1800-01-01", (189, 773)


def _kind(m: str) -> str:
    """SQL: the kind of a match by its shape."""
    tests = {
        "email": f"instr({m}, '@') > 0",
        "phone": f"startswith({m}, '+')",
        "ip": f"instr({m}, '.') > 0",
        "ssn": f"{m} rlike '^[0-9]{{3}}-[0-9]{{2}}-'",
        "date": f"{m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'",
    }
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests.items()) + " ELSE 'card' END"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(body: str, first: int) -> str:
    """SQL: the Luhn sum of a digit string whose last digit has place ``first``; even places are doubled."""
    digit = f"cast(substr({body}, length({body}) - i + 1, 1) AS int)"
    value = f"if((i + {first - 1}) % 2 = 0, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"
    return f"aggregate(sequence(1, length({body})), 0, (a, i) -> a + {value})"


def _day(m: str) -> str:
    return f"datediff(try_to_date({m}, 'yyyy-MM-dd'), date'{_ERA}')"


def _valid(m: str, kind: str) -> str:
    """SQL: whether a match is a value of its kind."""
    a, g, s = (f"cast(substr({m}, {k}, {n}) AS int)" for k, n in ((1, 3), (5, 2), (8, 4)))
    tests = {
        "ip": f"forall(split({m}, '[.]'), x -> cast(x AS int) < 256 AND (x = '0' OR NOT startswith(x, '0')))",
        "ssn": f"{a} BETWEEN 1 AND 899 AND {a} <> 666 AND {g} > 0 AND {s} > 0",
        "date": f"coalesce({_day(m)} BETWEEN 0 AND 146096, false)",
        "card": f"{_luhn(_digits(m), 1)} % 10 = 0",
    }
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in tests.items()) + " ELSE true END"


def _symbols(m: str, kind: str) -> str:
    """SQL: the symbols of a value, as structs of value v and radix r."""

    def of(v: str, r) -> str:
        return f"named_struct('v', cast({v} AS int), 'r', {r})"

    local = f"split(lower(substring_index({m}, '@', 1)), '')"
    letter = f"named_struct('v', CASE WHEN c rlike '[0-9]' THEN cast(c AS int) WHEN c rlike '[a-z]' THEN ascii(c) - 97 ELSE 0 END, 'r', CASE WHEN c rlike '[0-9]' THEN 10 WHEN c rlike '[a-z]' THEN 26 ELSE 1 END)"
    area = f"cast(substr({m}, 1, 3) AS int)"
    tests = {
        "email": f"transform(filter({local}, c -> c <> ''), c -> {letter})",
        "phone": f"transform(split(right({_digits(m)}, 10), ''), c -> {of('c', 10)})",
        "ip": f"transform(split({m}, '[.]'), c -> {of('c', 256)})",
        "ssn": f"array({of(f'{area} - if({area} > 666, 2, 1)', 898)}, {of(f'substr({m}, 5, 2)', 0).replace(', 0)', ', 99)').replace('AS int)', 'AS int) - 1')}, {of(f'substr({m}, 8, 4)', 0).replace(', 0)', ', 9999)').replace('AS int)', 'AS int) - 1')})",
        "date": f"array({of(f'{_day(m)} div {_DAYS[1]}', _DAYS[0])}, {of(f'{_day(m)} % {_DAYS[1]}', _DAYS[1])})",
        "card": f"transform(split(left({_digits(m)}, length({_digits(m)}) - 1), ''), c -> {of('c', 10)})",
    }
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in tests.items()) + " END"


def key_table(spark: SparkSession, secrets: Mapping[int, bytes]) -> DataFrame:
    """(key_id, inner, outer): secrets as the two padded blocks of HMAC-SHA512, one row for each id.

    Explained plans, the interface of Spark and its event log show the names of
    the columns only.
    """

    def block(secret: bytes, pad: int) -> bytes:
        secret = hashlib.sha512(secret).digest() if len(secret) > 128 else secret
        return bytes(x ^ pad for x in secret.ljust(128, b"\0"))

    rows = [(k, bytearray(block(v, 0x36)), bytearray(block(v, 0x5C))) for k, v in secrets.items()]
    return spark.createDataFrame(rows, "key_id int, inner binary, outer binary")


def _permuted(symbols: str, kind: str) -> str:
    """SQL: the symbols after all rounds, under the columns inner and outer; the kind and the radices are part of what is keyed."""
    left = "j < size(s) div 2"
    other = f"array_join(transform(filter(transform(s, (x, j) -> if(({left}) = (k % 2 = 0), -1, x.v)), y -> y >= 0), y -> cast(y AS string)), ',')"
    radices = "array_join(transform(s, x -> cast(x.r AS string)), ',')"
    told = f"encode(concat_ws('|', {kind}, cast(k AS string), {radices}, {other}), 'UTF-8')"
    digest = f"sha2(concat(outer, unhex(sha2(concat(inner, {told}), 512))), 512)"
    shift = "cast(conv(substr(d, (j * 4) % 124 + 1, 4), 16, 10) AS int)"
    moved = f"transform(s, (x, j) -> if(({left}) = (k % 2 = 0), named_struct('v', (x.v + {shift}) % x.r, 'r', x.r), x))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {symbols}, (s, k) -> element_at(transform(array({digest}), d -> {moved}), 1))"


def _filled(m: str, digits: str) -> str:
    """SQL: a match with its digits replaced in order."""
    place = f"length(regexp_replace(substr({m}, 1, j + 1), '[^0-9]', ''))"
    return f"array_join(transform(filter(split({m}, ''), c -> c <> ''), (c, j) -> if(c rlike '[0-9]', substr({digits}, {place}, 1), c)), '')"


def _written(m: str, kind: str, p: str) -> str:
    """SQL: the pseudonym of match ``m`` from its permuted symbols ``p``."""
    text = f"array_join(transform({p}, x -> cast(x.v AS string)), '')"
    local = f"filter(split(substring_index({m}, '@', 1), ''), c -> c <> '')"
    char = f"CASE WHEN c rlike '[0-9]' THEN cast({p}[j].v AS string) WHEN c rlike '[a-z]' THEN char({p}[j].v + 97) WHEN c rlike '[A-Z]' THEN char({p}[j].v + 65) ELSE c END"
    area = f"{p}[0].v + if({p}[0].v >= 665, 2, 1)"
    lead = f"left({_digits(m)}, length({_digits(m)}) - 10)"
    tests = {
        "email": f"concat(array_join(transform({local}, (c, j) -> {char}), ''), substr({m}, instr({m}, '@')))",
        "phone": f"concat({_filled(m, f'concat({lead}, {text})')})",
        "ip": f"array_join(transform({p}, x -> cast(x.v AS string)), '.')",
        "ssn": f"concat_ws('-', lpad(cast({area} AS string), 3, '0'), lpad(cast({p}[1].v + 1 AS string), 2, '0'), lpad(cast({p}[2].v + 1 AS string), 4, '0'))",
        "date": f"date_format(date_add(date'{_ERA}', {p}[0].v * {_DAYS[1]} + {p}[1].v), 'yyyy-MM-dd')",
        "card": _filled(m, f"concat({text}, cast((10 - {_luhn(text, 2)} % 10) % 10 AS string))"),
    }
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in tests.items()) + " END"


def pseudonymised(docs: DataFrame, keys: DataFrame, key_id: int) -> DataFrame:
    """Documents of ``docs(doc_id, text)`` that hold personal data, with pseudonyms in their place.

    Returns doc_id, text_key (hash of the text), n_email, n_phone, n_ssn,
    n_date, n_ip, n_card (validated values, repeats included) and text.
    Numbers must be valid: cards by their check digit, which is computed anew;
    octets under 256; social security numbers outside the unused ranges; dates
    of the calendar from 1800 to 2199. What is not valid is left as it is. Of an
    email address the local part is replaced, of a phone number the last ten
    digits. A row of one symbol, such as the local part of one letter, is moved
    by a shift that is the same for all letters, so it has as many pseudonyms as
    the letter has values. Equal values get equal pseudonyms in all documents,
    under the same secret, which is row ``key_id`` of ``keys`` (see
    :func:`key_table`; without such a row the run fails). Documents without
    such values are not returned; neither are null and empty texts. Repeated
    rows and null ids are returned as they come. Extra columns are ignored.
    """
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where(F.col("text").rlike("[0-9@]"))
    found = base.withColumn("found", F.expr(f"regexp_extract_all(text, '{quoted}', 0)")).where(F.size("found") > 0)
    kind = "f.kind"
    named = F.expr(f"transform(transform(found, m -> named_struct('m', m, 'kind', {_kind('m')})), f -> named_struct('m', f.m, 'kind', if({_valid('f.m', kind)}, f.kind, 'none')))")
    found = found.withColumn("named", named).where(F.expr("exists(named, f -> f.kind <> 'none')"))
    known = keys.where(F.col("key_id") == key_id)
    for block in ("inner", "outer"):
        given = known.select(block).scalar()
        found = found.withColumn(block, F.when(given.isNull(), F.raise_error(F.lit("no such key")).cast("binary")).otherwise(given))
    permuted = F.expr(f"transform(named, f -> named_struct('m', f.m, 'kind', f.kind, 'p', if(f.kind = 'none', null, {_permuted(_symbols('f.m', kind), kind)})))")
    found = found.withColumn("permuted", permuted)
    found = found.withColumn("new", F.expr(f"transform(permuted, f -> if(f.kind = 'none', f.m, {_written('f.m', kind, 'f.p')}))"))
    parts = F.expr(f"split(text, '{quoted}', -1)")
    text = F.array_join(F.expr("flatten(zip_with(parts, new, (x, y) -> array(x, coalesce(y, ''))))"), "")
    counts = [F.expr(f"cast(size(filter(named, f -> f.kind = '{k}')) AS long)").alias(f"n_{k}") for k in PATTERNS]
    return found.withColumn("parts", parts).select("doc_id", "text_key", *counts, text.alias("text"))
