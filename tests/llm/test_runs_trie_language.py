"""Periodic runs, conversation trie and languages against plain Python, on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import language, queries, runs, trie

# Periodic runs


def plain_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def looping(rng, n, kinds):
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if rng.random() < 0.7 and n > 10:
        p, a = rng.randint(1, 9), rng.randrange(n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = "odd"
    return w


@pytest.mark.parametrize("portion", [1, 7, 1 << 19])
def test_runs_equal_brute_force(monkeypatch, portion):
    monkeypatch.setattr(runs, "CANDIDATES", portion)
    rng = random.Random(portion)
    for _ in range(60):
        docs = [looping(rng, rng.choice([0, 1, 2, 12, 40, 90]), rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 6))]
        names = {x: k for k, x in enumerate(sorted({x for d in docs for x in d}))}
        codes = np.array([names[x] for d in docs for x in d], np.int64)
        least = rng.choice([2, 4, 12])
        of, *rest = runs.find_runs(codes, np.array([len(d) for d in docs]), least)
        found = list(zip(of.tolist(), *(x.tolist() for x in rest), strict=True))
        assert found == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d, least)]


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 40):
        x = np.concatenate([[-1], rng.integers(0, kinds, 300), [-2]])
        a, b = np.sort(rng.integers(1, 301, (2, 200)), axis=0)
        a, b = a[a < b], b[a < b]
        g = runs.Grammar(x)
        for step in (1, -1):
            want = []
            for i, j in zip(a, b, strict=True):
                k = 0
                while x[i + k * step] == x[j + k * step]:
                    k += 1
                want.append(k)
            assert g.extension(a, b, step).tolist() == want


def test_periodic_runs_on_odd_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 12, "a b " * 6 + "a", " ".join(["x"] * 40), "  \u0085 " * 20, "\x1c \x1f " * 20, "é ü " * 10]
    texts += [" ".join(looping(rng, rng.choice([20, 60, 200]), rng.choice([2, 4, 30]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "a " * 30), (None, None), (7, "again " * 20), (-10, "b c d " * 9), (3_000_000_000, "q r " * 50), (4, "a " * 12)]
    rows += [(900, " ".join(f"w{k % 20011}" for k in range(60_000)))]
    docs = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], "doc_id long, text string, length int, runs string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = [plain_row(*r) for r in rows[:-1]] + [(900, 1, 0, 60_000, 20_011, 2998, *([None] * 2))]
    if zlib.crc32(b"900") % 10 == 0:
        want[-1] = plain_row(*rows[-1])
    key = str
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((r[:6] for r in want), key=key)
    assert sorted((tuple(r) for r in got if r.doc_id != 900), key=key) == sorted((r for r in want if r[0] != 900), key=key)
    shown = runs.periodic_runs(docs.where("doc_id = 4")).collect()
    assert [(tuple(r.runs[0]), r.collapsed) for r in shown] == [((0, 12, 1), "a")] * 2
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op12_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


# Conversation trie


def plain_trie(rows):
    held = {}
    for c, t, r, x in rows:
        if c is not None:
            held.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    held = {c: [v[2:] for v in sorted(x, key=lambda v: v[:2])] for c, x in held.items()}
    nodes, whole = {}, {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = held.get(base, [])[:h] + own[h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    kids, told = {}, {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        m, k = nodes[p], kids.get(p, [])
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(p)))
        saved = (len(m) - 1) * len(p[-1][1]) if p else 0
        told[p] = (
            min(m),
            len(p),
            min(nodes[p[:-1]]) if p else None,
            len(m),
            len(k),
            sum(told[x][5] for x in k) or 1,
            saved + sum(told[x][6] for x in k),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(told.values(), key=str)


def conversations(rng, n):
    rows = []
    for c in [*range(0, n), *range(-5, 0), 100, 205, 777, 3_000_000_000]:
        turns = rng.choice([0, 1, 2, 5, 9]) if c != 1 else 90
        rows += [(c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]), rng.choice(["a", "bé", "", "c" * 9])) for t in range(turns)]
    rows += [(c, t, "user", "the same") for c in range(300, 340) for t in range(50)]
    rows += [(341, t, "user", "the same" if t < 48 else "end") for t in range(50)]
    return rows + [(None, 1, "user", "nobody's"), (None, None, None, None), (150, 1, "u", "x"), (150, 1, "u", "x"), (150, 1, "u", "x")]


@pytest.mark.parametrize("block", [1, 3, 1 << 18])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    rows = list({(r[0], r[1]): r for r in conversations(random.Random(block), 60)}.values()) + [(150, 1, "u", "x"), (150, 1, "u", "x")]
    table = spark.createDataFrame([(*r, 5, "seq") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string")
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_of_an_empty_table_and_of_empty_conversations(spark, tmp_path):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)).count() == 0
    empty = spark.createDataFrame([(5, bytearray()), (3, bytearray()), (None, bytearray())], "conv_id long, seq binary")
    rows = [tuple(r) for r in trie.prefix_trie(empty).collect()]
    assert rows == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_extents_equal_a_plain_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        x = rng.integers(0, 4, n)
        levels = trie._sparse(x)
        at, least = rng.integers(0, n, 40), rng.integers(0, 5, 40)
        for step in (1, -1):
            want = []
            for i, v in zip(at, least, strict=True):
                k = 0
                while 0 <= i + k * step < n and x[i + k * step] >= v:
                    k += 1
                want.append(k)
            assert trie._extent(levels, at, least, step).tolist() == want


# Languages


def sentence(rng, letters, n):
    own = random.Random(letters)
    vocabulary = ["".join(own.choice(letters) for _ in range(own.randint(3, 8))) for _ in range(80)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_languages(spark, tmp_path):
    rng = random.Random(2)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = []
    for k in range(300):
        name = rng.choice(list(kinds))
        text = sentence(rng, kinds[name], rng.choice([30, 80])) + "\nAll rights reserved, every one of them."
        # Labels of held-out rows are turned round; they must not be learned.
        rows.append((k, text, "cc" if zlib.crc32(str(k).encode()) % 5 == 0 else name, name))
    odd = [(None, sentence(rng, "abcde", 40), None, "aa"), (1001, None, None, "und"), (1002, "", "aa", "und"), (1003, "12 34 !?", None, "und"), (1004, sentence(rng, "fghij", 30_000), None, "bb")]
    odd += [rows[0], (1005, "zzz", None, None)]
    docs = spark.createDataFrame([(k, t, x, "s", "q", w) for k, t, x, w in rows + odd], "doc_id long, text string, lang string, source string, score string, want string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_language_id"](spark, str(tmp_path)).collect()
    want = {k: w for k, _, _, w in rows + odd}
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert want[r.doc_id] is None or r.lang_pred == want[r.doc_id]
        assert r.rejected or r.lang_pred != "und"
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert not any(r.rejected for r in got if want[r.doc_id] not in ("und", None))


def test_language_dictionaries_are_bounded_and_order_free(spark):
    rows = [("aa", f"line {k} of aa\nshared line") for k in range(50)] * 2 + [("bb", f"line {k} of bb\n\nshared line") for k in range(50)] + [("cc", "shared line"), (None, "x"), ("dd", None), ("ee", " ")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = language.dictionaries(docs, most=200)
    assert list(found) == ["aa", "bb", "cc"] and all(len(x) <= 200 for x in found.values())
    assert b"shared" not in found["aa"] + found["bb"] and found["cc"] == b"shared line"
    assert len(set(found["aa"].split(b"\n"))) == len(found["aa"].split(b"\n"))
    assert found == language.dictionaries(docs.orderBy(F.rand(3)).repartition(7), most=200)
    with pytest.raises(ValueError, match="languages"):
        language.dictionaries(docs, max_languages=2)


def test_nothing_learned_or_one_language(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert [(r.lang, r.score) for r in language.languages(docs, {}).collect()] == [(None, 0.0)] * 2
    assert [(r.lang, r.margin) for r in language.languages(docs, {"aa": b"some words here"}).collect()] == [("aa", 1.0), (None, None)]


def test_held_out_languages_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op11_language_id"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.95
