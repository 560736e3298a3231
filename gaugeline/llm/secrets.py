"""Secrets in texts: keyword automaton, anchored patterns near hits, checksums."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with equal starts stand.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE_KINDS = KINDS[:3]
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_matches(found: re.Match) -> bool:
    """The last six characters are the CRC-32 of the ones before, in base 62."""
    body, check = found[1][:-6], found[1][-6:]
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, k = divmod(crc, 62)
        digits = _BASE62[k] + digits
    return digits.rjust(6, "0") == check


def _is_jwt(found: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    try:
        head = base64.urlsafe_b64decode(found[1] + "=" * (-len(found[1]) % 4))
        return "alg" in json.loads(head)
    except (binascii.Error, ValueError, TypeError):
        return False


def _pattern(text: str, flags: int = 0) -> re.Pattern:
    return re.compile(text, flags | re.ASCII)


#: kind -> (keywords in lower case, pattern anchored at a keyword, test of a match)
_RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        _pattern(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        lambda m: len(m[2]) >= 6,
    ),
    "access": (("akia",), _pattern(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _pattern(r"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_matches),
    "npm": (("npm_",), _pattern(r"(?<![A-Za-z0-9_])npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_matches),
    "jwt": (("eyj",), _pattern(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _is_jwt),
}
_HEX = _pattern(r"[0-9a-f]{24,}")


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (words, _, _) in _RULES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of a text, in code points.

    The automaton runs over the text with ASCII letters lower-cased. At each
    hit the pattern of its kind is tried there and only there; matches of a
    kind are leftmost and do not overlap, and a match that fails its test is
    dropped but still passed over. Long runs of hexadecimal digits have no
    keyword and are looked for directly.
    """
    low = text.encode().lower().decode() if not text.isascii() else text.lower()
    out, end = [], {}
    hits = sorted((at - size + 1, kind) for at, (kind, size) in automaton.iter(low))
    for start, kind in hits:
        if start < end.get(kind, 0):
            continue
        _, pattern, good = _RULES[kind]
        found = pattern.match(text, start)
        if found:
            end[kind] = found.end()
            if good(found):
                out.append((start, found.end(), kind))
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanner(batches):
    automaton = _automaton()
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t, automaton)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every document of ``docs(doc_id, text)``.

    Whole texts are scanned where they lie; nothing is shuffled. A null or
    empty text has no spans. Repeated rows and null ids are returned as they
    come. Extra columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.mapInArrow(_scanner, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def spans_text(spans) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
