"""Operators on small frames against plain Python."""

import hashlib
import itertools
import math
import os
import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions import scalars as S
from gaugeline.operators import audit, contracts, distributions, graphs, joins, nulls, ordered, ranking, screening, stats, windows
from gaugeline.sources import files


def brute_auc(rows):
    pos = [(s, w) for s, y, w in rows if y == 1]
    neg = [(s, w) for s, y, w in rows if y == 0]
    if not pos or not neg:
        return None
    credit = sum(a * b * (1.0 if p > n else 0.5 if p == n else 0.0) for p, a in pos for n, b in neg)
    return credit / (sum(a for _, a in pos) * sum(b for _, b in neg))


def scored(spark, seed, n=200):
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), float(rng.randint(0, 9)), rng.randint(0, 1), rng.choice([0.5, 1.0, 2.0])) for _ in range(n)] + [("one", 1.0, 1, 1.0), ("all", 2.0, 0, 1.0), ("all", 3.0, 0, 1.0)]
    return rows, spark.createDataFrame(rows, "g string, score double, label int, weight double")


def test_pairwise_kl_of_equal_chains_meets_once(spark, monkeypatch):
    kinds = ["aab", "bc", "abbb"]
    rows = [(c, k) for c in range(90) for k in kinds[c % 3] * 2]
    dist = [{k: (kind.count(k) / len(kind) + 1e-6) / (1 + 3e-6) for k in "abc"} for kind in kinds]
    kl = [sum(p[k] * math.log(p[k] / q[k]) for k in "abc") for p in dist for q in dist]
    seen = []
    monkeypatch.setattr(distributions, "written", lambda df, name: (seen.append(df.columns == ["a", "b", "s"] and df.count()), files.written(df, name))[1])
    got = distributions.pairwise_kl(spark.createDataFrame(rows, "c int, k string"), "c", "k", 1e-6).first()
    assert (got.kl_max, got.kl_mean) == (pytest.approx(max(kl), rel=1e-9), pytest.approx(sum(kl) * 900 / (90 * 89), rel=1e-9))
    assert max(seen) <= 6
    same = distributions.pairwise_kl(spark.createDataFrame([(c, "a") for c in range(3)], "c int, k string"), "c", "k", 1e-6).first()
    assert same.kl_max == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_equals_brute_force(spark, seed):
    rows, df = scored(spark, seed)
    got = {r.g: r.auc for r in audit.weighted_auc(df, ["g"]).collect()}
    for g in got:
        want = brute_auc([r[1:] for r in rows if r[0] == g])
        assert got[g] == (pytest.approx(want, abs=1e-12) if want is not None else None)


def test_auc_is_the_same_for_any_partitioning(spark):
    _, df = scored(spark, 3)
    one, many = (sorted((r.g, r.auc is None, round(r.auc or 0, 12)) for r in audit.weighted_auc(df.repartition(n), ["g"]).collect()) for n in (1, 50))
    assert one == many


def test_auc_ignores_null_and_infinite_scores(spark):
    df = spark.createDataFrame([("a", None, 1, 1.0), ("a", float("inf"), 0, 1.0), ("a", 2.0, 1, 1.0), ("a", 1.0, 0, 1.0)], "g string, score double, label int, weight double")
    assert audit.weighted_auc(df, ["g"]).first().auc == 1.0


def test_global_auc(spark):
    rows, df = scored(spark, 4, 500)
    assert audit.weighted_auc_global(df, ranges=16).first().auc == pytest.approx(brute_auc([r[1:] for r in rows]), abs=1e-12)


@pytest.mark.parametrize("m, n", [(1, 5), (2, 3), (3, 4), (5, 1)])
def test_exact_null_equals_enumeration(m, n):
    aucs = []
    for pos in itertools.combinations(range(m + n), m):
        aucs.append(sum(p > q for p in pos for q in range(m + n) if q not in pos) / (m * n))
    aucs.sort()
    for q in (0.5, 0.9, 0.95, 1.0):
        want = aucs[max(1, int(np.ceil(q * len(aucs) - 1e-9))) - 1]
        assert audit.exact_null_quantile(m, n, q) == pytest.approx(want)


def test_null_for_one_positive_has_a_closed_form(spark):
    rows = spark.range(1, 40).select(audit.null_auc_single(F.col("id"), 0.95).alias("q"), "id").collect()
    assert all(r.q == pytest.approx(audit.exact_null_quantile(1, r.id, 0.95)) for r in rows)


def positive_recurrence(m, n):
    """Probabilities of U from positive terms only: the largest item is positive or negative."""
    row = [np.ones(1) for _ in range(n + 1)]
    for i in range(1, m + 1):
        new = [np.ones(1)]
        for j in range(1, n + 1):
            p = np.zeros(i * j + 1)
            p[j:] = row[j] * (i / (i + j))
            p[: i * (j - 1) + 1] += new[j - 1] * (j / (i + j))
            new.append(p)
        row = new
    return row[n]


@pytest.mark.parametrize("m, n", [(7, 9), (20, 60), (21, 60), (120, 100), (3, 400)])
def test_null_distribution_equals_the_positive_recurrence(m, n):
    want = np.cumsum(positive_recurrence(m, n))
    if min(m, n) <= 20:
        assert np.abs(np.cumsum(audit._null_masses(m, n)) - want).max() < 1e-13
    else:
        below = audit._null_below(m, n)
        assert max(abs(below(u) - want[u]) for u in range(0, m * n + 1, 37)) < 1e-13
    for q in (0.5, 0.9, 0.95, 0.99):
        assert audit.exact_null_quantile(m, n, q) == np.searchsorted(want, q - 1e-11) / (m * n)


def test_null_is_exact_at_ten_times_the_former_cap(spark):
    df = spark.createDataFrame([(3, 4), (400, 300), (0, 5), (20_000, 30_000)], "n_pos long, n_neg long")
    got = {(r.n_pos, r.n_neg): r for r in audit.null_auc_quantile(df, 0.95).collect()}
    assert got[3, 4].null_method == got[400, 300].null_method == "exact" and got[0, 5].null_q is None
    assert got[400, 300].null_q * 120_000 == pytest.approx(round(got[400, 300].null_q * 120_000), abs=1e-6)  # a step of the distribution
    for m, n in ((400, 300), (20_000, 30_000)):
        assert got[m, n].null_q == pytest.approx(0.5 + 1.6448536 * ((m + n + 1) / (12 * m * n)) ** 0.5, abs=1e-4)


def test_item_audit(spark):
    rows, df = scored(spark, 5)
    for r in audit.item_audit(df, ["g"], 0.9, 0.02).collect():
        own = [x[1:] for x in rows if x[0] == r.g]
        m = sum(y for _, y, _ in own)
        assert (r.n_pos, r.n_neg) == (m, len(own) - m)
        if 0 < m < len(own):
            null = np.searchsorted(np.cumsum(positive_recurrence(m, len(own) - m)), 0.9 - 1e-11) / (m * (len(own) - m))
            assert r.auc == pytest.approx(brute_auc(own)) and r.null_q == pytest.approx(null) and r.gate == pytest.approx(min(1, null + 0.02))
            assert r.slack == pytest.approx(r.auc - r.gate) and r.verdict == ("PASS" if r.slack >= 0 else "FAIL")
        else:
            assert (r.auc, r.null_q, r.verdict) == (None, None, None)


def test_null_by_enumeration_beyond_ten_rows(spark):
    rows = [("a", k, float(k % 3), k % 2) for k in range(6)] + [("b", k, float(k), k % 2) for k in range(100)] + [("c", 1, 1.0, 1)]
    got = {r.g: r for r in audit.null_by_enumeration(spark.createDataFrame(rows, "g string, k int, score double, label int"), ["g"], "k", 0.9, 30, 1).collect()}
    assert [(got[g].null_method, got[g].n_labelings) for g in "abc"] == [("enumeration", 20), ("permutation", 30), ("none", None)]
    aucs = sorted(brute_auc([(s, int(k in pos), 1.0) for _, k, s, _ in rows[:6]]) for pos in itertools.combinations(range(6), 3))
    assert got["a"].null_q == pytest.approx(aucs[17]) and 0.5 < got["b"].null_q < 0.7


@pytest.mark.parametrize("large", [False, True])
def test_labelings_of_a_group_are_no_rows(spark, monkeypatch, large):
    rng = random.Random(8)
    rows = [(g, f"{g}{k}", rng.choice([None, float("nan"), *map(float, range(5))]), int(rng.random() < 0.4)) for g, n in (("a", 4), ("b", 7), ("c", 9), ("d", 12), ("e", 30), (None, 5)) for k in range(n)]
    rows += [("f", "f1", 1.0, 1), ("f", "f2", 2.0, 0), ("g", "g1", 1.0, 1), ("h", "h1", None, 1), ("h", "h2", None, 0)]
    if large:
        monkeypatch.setattr(audit, "HELD", 8)
    else:
        monkeypatch.setattr(audit, "weighted_auc", None)
    got = {r.g: r for r in audit.null_by_enumeration(spark.createDataFrame(rows, "g string, k string, score double, label int"), ["g"], "k", 0.9, 15, 3, limit=8).collect()}
    assert set(got) == {*"abcdefgh", None}
    for g in got:
        items = [r for r in rows if r[0] == g]
        n, m = len(items), sum(r[3] for r in items)
        if 0 < m < n <= 8:
            method, drawn = "enumeration", [set(c) for c in itertools.combinations(range(n), m)]
        elif 0 < m < n:
            turns = [sorted(range(n), key=lambda k, rep=rep: hashlib.md5(f"3|{rep}|{items[k][1]}".encode()).hexdigest()) for rep in range(1, 16)]
            method, drawn = "permutation", [set(t[:m]) for t in turns]
        else:
            method, drawn = "none", []
        assert got[g].null_method == method
        aucs = [brute_auc([(s, int(k in pos), 1.0) for k, (_, _, s, _) in enumerate(items) if s is not None and s == s]) for pos in drawn]
        some = [a for a in aucs if a is not None]
        if g is None or not some:
            assert (got[g].n_labelings, got[g].null_q) == (None, None)
        elif method == "enumeration":
            want = sorted(aucs, key=lambda a: -1.0 if a is None else a)[max(1, math.ceil(len(aucs) * 0.9 - 1e-9)) - 1]
            assert got[g].n_labelings == len(aucs) and got[g].null_q == pytest.approx(want)
        else:
            assert got[g].n_labelings == 15 and got[g].null_q == pytest.approx(np.quantile(some, 0.9))


def test_contracts(spark):
    df = spark.createDataFrame([("a", "PASS", "s", "v1"), ("a", "FAIL", "s", "v1"), ("", "PASS", "s", "v1"), ("b", "MAYBE", "", "v2")], "id string, label string, source string, version string")
    got = {(r.rule, r.key, r.n) for r in contracts.check_truth_contract(df, "id", "label", "source", "version", ["PASS", "FAIL"]).collect()}
    assert got == {("empty_id", "", 1), ("duplicate_id", "a", 2), ("bad_label", "b", 1), ("empty_source", "b", 1), ("mixed_version", "v2", 1)}
    with pytest.raises(ValueError, match="x, y"):
        contracts.require_columns(df, ["id", "y", "x"])


def test_checksum_ignores_order(spark):
    rows = [("g", k, str(k % 3)) for k in range(20)]
    sums = {contracts.content_checksum(spark.createDataFrame(random.Random(s).sample(rows, 20), "g string, a int, b string").repartition(s + 1), ["g"], ["a", "b"]).first().checksum for s in range(3)}
    assert len(sums) == 1


@pytest.mark.parametrize("relative", [False, True])
def test_tolerance_join_equals_brute_force(spark, relative):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.uniform(-2, 2), rng.uniform(-500, 500)])) for k in range(150)]
    tol = 0.05
    got = {(r.k_a, r.k_b) for r in joins.tolerance_join(spark.createDataFrame(rows, "k int, x double"), "k", "x", tol, relative=relative).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and abs(x - y) <= tol * (max(1, abs(x), abs(y)) if relative else 1)}
    assert got == want


@pytest.mark.parametrize("low, high", [(0.6, 1.0), (0.6, 0.9), (0.3, 0.8)])
def test_similarity_join_equals_brute_force(spark, low, high):
    rng = random.Random(6)
    rows = [(k, rng.sample(range(12), rng.randint(1, 8))) for k in range(80)] + [(100 + k, [3, 1, 2]) for k in range(30)] + [(200, []), (201, []), (202, None)]
    df = spark.createDataFrame(rows, "k int, s array<int>")
    got = {(r.k_a, r.k_b): r.similarity for r in joins.set_similarity_join(df, "k", "s", low, high, expand=True).collect()}
    full = [(k, set(s)) for k, s in rows if s]
    want = {(a, b): len(x & y) / len(x | y) for a, x in full for b, y in full if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if low <= v <= high})
    rep = {r.k: r.rep for r in joins.equal_sets(df, "k", "s").collect()}
    assert all(rep[k] == min(b for b, y in full if y == s) for k, s in full)
    short = {(r.k_a, r.k_b) for r in joins.set_similarity_join(df, "k", "s", low, high).collect()}
    assert short == {(a, b) for a, b in got if rep[a] == a and rep[b] == b and rep[a] != rep[b]}


def test_similarity_query_pairs_every_copy(spark, tmp_path):
    from gaugeline import plans, registry

    plans.load()
    texts = {1: "a b c d", 2: "d c b a", 3: "A b c d e", 4: "a b c d e!", 5: "x", 6: "", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.k_a, r.k_b, r.similarity) for r in registry.QUERIES["C14_set_similarity_join"](spark, str(tmp_path)).collect())
    assert got == [(1, 3, 0.8), (1, 4, 0.8), (2, 3, 0.8), (2, 4, 0.8)]


def test_similar_sets_meet_in_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_LEAST", 60), ("MATCHES", 40)):
        monkeypatch.setattr(joins, name, value)
    rng = random.Random(52)
    sets = {k: rng.sample(range(30), rng.randint(0, 14)) for k in range(150)} | {200 + k: [*range(40, 49), 50 + k] for k in range(60)}
    reps = spark.createDataFrame(list(sets.items()), "rep long, s array<int>").where("size(s) > 0")
    for low, high in ((0.5, 1.0), (0.65, 0.95)):
        found = joins.similar_classes(reps, low, high)
        got = {(min(r.ka, r.kb), max(r.ka, r.kb)): r.similarity for r in found.collect()}
        want = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in sets.items() for b, y in sets.items() if a < b and (x or y)}
        want = {k: v for k, v in want.items() if low <= v <= high}
        assert got == pytest.approx(want) and found.count() == len(want) > 1770


def test_classes_with_the_same_digests_are_told_by_their_sets(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["b", "a"]), (4, []), (5, None)], "k int, s array<string>")
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(joins, "_digests", lambda tokens: {"h1": F.lit(1), "h2": F.lit(2)})
        reps, members = joins.set_classes(df, "k", "s")
        assert sorted((r.rep, r.s, r.size) for r in reps.collect()) == [(1, ["a", "b"], 2), (2, ["c"], 1), (4, [], 1)]
        assert sorted(tuple(r) for r in members.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(62)
    sets = [np.sort(rng.choice(900, rng.integers(1, 120), replace=False)) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    for words in (1, 4, 8):
        x = joins._sketches(n, np.cumsum(n) - n, np.concatenate(sets), words)
        bits = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
        apart = np.array([[len({*a} ^ {*b}) for b in sets] for a in sets])
        assert (bits <= apart).all() and bits.diagonal().max() == 0
    # With four bits for a token or more, sets without a common token are told from those that are half alike.
    assert all(bits[i, j] > (n[i] + n[j]) / 3 for i in range(60) for j in range(i) if apart[i, j] == n[i] + n[j] > 100)


def test_nearest_in_a_large_table_equals_brute_force(spark):
    rng = random.Random(21)
    points = [rng.choice([rng.uniform(-10, 10), 1e6 + rng.random()]) for _ in range(40)] + [5.0, 7.0]
    rows = [(k, rng.choice([rng.uniform(-50, 50), 6.0, 3e6, -1e9, None])) for k in range(200)]
    at = spark.createDataFrame([(p,) for p in points] + [(None,), (5.0,)], "p double")
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: (r.nearest, r.distance) for r in joins.nearest_join_large(df, "x", at, "p").collect()}
    for k, x in rows:
        best = None if x is None else min(sorted(points), key=lambda p: abs(x - p))
        assert got[k] == (best, None if x is None else x - best)
    assert all(r.nearest is None for r in joins.nearest_join_large(df, "x", at.limit(0), "p").collect())


def test_nearest_in_a_large_table_has_no_frame_to_the_last_row(spark):
    df = spark.range(9).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    plan = joins.nearest_join_large(df, "x", df.select(F.col("x").alias("p")), "p")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.lower().splitlines() if "unboundedfollowing" in line and "x_#" in line] == []


def test_crossing_pairs_equal_brute_force(spark):
    rng = random.Random(22)
    rows = [(rng.choice("abc"), rng.randint(0, 30), rng.randint(0, 30)) for _ in range(150)] + [("one", 1, 2), ("none", 3, 1)]
    rows += [("hub", k, 400 - k % 7) for k in range(300)]
    got = {r.g: r.n_crossings for r in joins.interleaved_pairs(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").collect()}
    for g in got:
        own = [r[1:] for r in rows if r[0] == g]
        assert got[g] == sum(a1 < a2 < b1 < b2 for a1, b1 in own for a2, b2 in own)


def test_vector_collisions_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, [rng.choice([1.0, 1.0000001, 100.0, 100.0005, -3.0]), float(rng.randint(0, 1))]) for k in range(60)]
    for tol in (0.0, 1e-6, 0.5):
        want = sum(all(abs(p - q) <= tol + 1e-5 * abs(q) for p, q in zip(x, y)) for a, x in rows for b, y in rows if a < b)
        assert audit.vector_collision_rate(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", tol).first().n_equal == want


def test_quantile_rules(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(1, 6)], "g string, x double")
    assert stats.ranked_quantile(df, ["g"], "x", 0.5).first().value == 2.0  # half-even of 2.5
    assert stats.ranked_quantile(df, ["g"], "x", 0.5, "ceil").first().value == 3.0
    assert stats.ranked_quantile(df, ["g"], "x", 0.0).first().value == 1.0
    rng = random.Random(23)
    values = [float(rng.randint(0, 40)) for _ in range(501)]
    whole = spark.createDataFrame([(v, "PASS" if v > 9 else "FAIL") for v in values], "x double, v string").repartition(7)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert stats.ranked_quantile(whole, [], "x", q).first().value == sorted(values)[max(1, round(501 * q)) - 1]
    r = audit.slack_stats(whole, (), "x", "v").first()
    assert (r.n_ok, r.p25, r.median, r.p75) == (501, sorted(values)[124], sorted(values)[249], sorted(values)[375])


def test_ranks_and_correlations_with_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("s", 1.0, 1.0)], "g string, x double, y double")
    assert [r.r for r in windows.average_rank(df.where("g = 'a'"), ["g"], "x").orderBy("x").collect()] == [1.5, 1.5, 3.0]
    got = {r.g: r.rho for r in ranking.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.8660254, abs=1e-6) and got["c"] is None and got["s"] is None


def test_calibration_gate_does_not_depend_on_the_order_of_sums(spark):
    # 0.1 + 0.2 is over 0.3, and 0.7 - 2 * (0.1 + 0.2) under 0.7 - 2 * 0.3, in the last digit only.
    df = spark.createDataFrame([(1, 0.7, 0.1 + 0.2), (2, 0.7, 0.3), (3, 0.6, 0.3)], "t int, auc double, other double")
    got = {r.t: (r.status, r.best) for r in ranking.calibration_gate(df, "t", [("auc", "min", 0.1 + 0.6), ("other", "max", 0.3)], "auc", ["other"], 2.0).collect()}
    assert got == {1: ("PASS", True), 2: ("PASS", False), 3: ("FAIL", False)}


def test_calibration_score_halfway_rounds_whatever_the_order_of_sums(spark):
    # The second is the double below the first, as another order of sums gives it.
    df = spark.createDataFrame([(1, 0.2356875, 0.0), (2, 0.23568749999999997, 0.0)], "t int, auc double, other double")
    got = ranking.calibration_gate(df, "t", [("auc", "min", 0.0)], "auc", ["other"], 2.0)
    assert [r.s for r in got.selectExpr("round(score, 6) AS s").collect()] == [0.235688, 0.235688]


@pytest.mark.parametrize("many", [False, True])
def test_pairwise_accuracy_is_counted_without_listing(spark, monkeypatch, many):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, *range(40)]), rng.choice([None, float("nan"), *map(float, range(6))]), rng.choice([None, *map(float, range(9))])) for g in "abc" for _ in range(30)]
    df = spark.createDataFrame([*rows, ("d", 1, 1.0, 1.0), ("d", 2, 1.0, 1.0)], "g string, k int, p double, t double")
    listed = {r.g: (r.n_correct, r.n_pairs) for r in ranking.pairwise_accuracy(df, "g", "k", "p", "t").collect()}
    want = {}
    for (g, k, p, t), (h, m, q, u) in itertools.combinations(rows, 2):
        if g == h and None not in (k, m, t, u) and k != m and t != u:
            right, n = want.get(g, (0, 0))
            want[g] = right + (None not in (p, q) and (p < q and t < u or p > q and t > u)), n + 1
    monkeypatch.setattr(ranking, "FEW", 1)
    if many:
        monkeypatch.setattr(ordered, "SMALL", 5)
    monkeypatch.setattr(ranking, "within_group_pairs", None)  # pairs are not listed
    got = {r.g: (r.n_correct, r.n_pairs) for r in ranking.pairwise_accuracy(df, "g", "k", "p", "t").collect()}
    assert got == want == listed


@pytest.mark.parametrize("nan", [False, True])
def test_metrics_of_a_group_are_counted_in_its_task(spark, monkeypatch, nan):
    """Groups that lie in several batches, keys that come twice, nulls, NaN and zeros of either sign."""
    rng = random.Random(12)
    odd = [None, float("nan"), 0.0, -0.0]
    rows = [(c, g, rng.choice([None, *range(60)]), rng.choice([*odd, *map(float, range(9))]), rng.choice([*odd[2 * (not nan) :], None, *map(float, range(20))])) for c in "xy" for g in ("a", "b", "c", None) for _ in range(35)]
    rows += [("x", "one", 1, 1.0, 1.0), ("y", "null", 1, None, 1.0), ("y", "null", 2, None, 2.0), ("y", "flat", 1, 2.0, 3.0), ("y", "flat", 1, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "c string, g string, k int, p double, t double")

    def found():
        board = ranking.sweep_leaderboard(df, "c", "g", "k", "p", "t").orderBy("c").toPandas()
        metrics = ranking.group_metrics(df.where("c = 'y'"), "g", "k", "p", "t").orderBy("g").toPandas()
        return board, metrics.astype({"n": int, "n_correct": int, "n_pairs": int})

    monkeypatch.setattr(ranking, "FEW", 1000)
    listed = found()
    monkeypatch.setattr(ranking, "FEW", 1)
    monkeypatch.setattr(ranking, "_ordered_pairs", None)  # not by rows times digits
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        counted = found()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    for module in (ranking, ordered):
        monkeypatch.setattr(module, "SMALL", 5)
    shuffled = found()
    for other in (shuffled,) if nan else (shuffled, listed):  # differences, which are listed, have no NaN truth as the greatest
        pd.testing.assert_frame_equal(counted[0], other[0], check_dtype=False)
        pd.testing.assert_frame_equal(counted[1], other[1], check_dtype=False)
    assert "null" not in set(counted[1].g)


@pytest.mark.parametrize("size", [0, 1, 500])
def test_rows_below_in_both_equal_brute_force(size):
    rng = np.random.default_rng(size)
    part, p, i = np.sort(rng.integers(0, 4, size)), rng.integers(0, 30, size), rng.integers(0, 50, size)
    want = [int(((part == part[r]) & (p < p[r]) & (i < i[r])).sum()) for r in range(size)]
    shuffled = rng.permutation(size)
    assert ranking._below(part, p, i).tolist() == want
    assert ranking._below(part[shuffled], p[shuffled], i[shuffled]).tolist() == [want[r] for r in shuffled]


def test_pairwise_accuracy_counts_prediction_ties_as_wrong(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 1.0, 2.0), ("g", 3, 3.0, 3.0)], "g string, k int, p double, t double")
    r = ranking.pairwise_accuracy(df, "g", "k", "p", "t").first()
    assert (r.n_correct, r.n_pairs) == (2, 3)


def test_left_out_fits_equal_direct_fits(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=60) * 50 + 1000, rng.normal(size=60)
    y = 2 * x - 3 * z + rng.normal(size=60)
    rows = [(f"g{k % 4}", k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "g string, k int, x double, z double, y double")
    got = {(r.fold, r.feature): r.weight for r in ranking.logo_ridge(df, "g", "y", ["x", "z"], 0.5).collect()}
    for g in range(4):
        keep = np.arange(60) % 4 != g
        a = np.stack([x[keep], z[keep]], 1)
        m, s = a.mean(0), a.std(0)
        zs, yc = (a - m) / s, y[keep] - y[keep].mean()
        w = np.linalg.solve(zs.T @ zs + 0.5 * np.eye(2), zs.T @ yc) / s
        assert [got[f"g{g}", "x"], got[f"g{g}", "z"]] == pytest.approx(list(w), rel=1e-6)
        assert got[f"g{g}", "intercept"] == pytest.approx(y[keep].mean() - w @ m, rel=1e-6)


def test_calibrated_scores_equal_direct_fits(spark):
    rng = np.random.default_rng(9)
    rows = [(f"g{k % 5}", k, float(a), float(b), round(float(a - 2 * b + rng.normal()), 1)) for k, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "g string, k int, x double, z double, y double")
    got = {r.score: r for r in ranking.calibrate_scores(df, "g", "k", "y", ["x", "z"], 40.0, "z").collect()}
    frame, rho, right, total = pd.DataFrame(rows, columns=list("gkxzy")), {"raw": [], "calibrated": []}, {"raw": 0, "calibrated": 0}, 0
    for fold, own in frame.groupby("g"):
        pairs = [(np.array([p.x - q.x, p.z - q.z]), p.y - q.y) for _, rest in frame[frame.g != fold].groupby("g") for p, q in itertools.permutations(list(rest.itertuples()), 2) if p.y != q.y]
        x, d = np.array([v for v, _ in pairs]), np.array([v for _, v in pairs])
        w = np.linalg.solve(x.T @ x + 40.0 * np.eye(2), x.T @ d)
        for name, pred in (("raw", own.z), ("calibrated", own.x * w[0] + own.z * w[1])):
            rho[name].append(pred.rank().corr(own.y.rank()))
            right[name] += sum(np.sign(a - b) == np.sign(c - e) for (a, c), (b, e) in itertools.combinations(list(zip(pred, own.y)), 2) if c != e)
        total += sum(c != e for c, e in itertools.combinations(own.y, 2))
    for name, values in rho.items():
        assert got[name].mean_rho == pytest.approx(np.mean(values), abs=1e-9) and got[name].pair_accuracy == pytest.approx(right[name] / total)
    assert got["calibrated"].mean_rho > 0.5 > got["raw"].mean_rho


def test_pair_sums_without_listing_pairs(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(g, rng.choice([None, *range(25)]), rng.choice([None, *map(float, range(7))]), rng.choice([None, 1.0, 2.5, 4.0]), rng.gauss(1e3, 1.0)) for g in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows, "g string, k int, t double, x double, z double")
    table = ranking.pair_training_table(df, "g", "k", "t", ["x", "z"])
    want = {(r.g, r.i, r.j): r.s for r in ranking.gram(table, ["g"], "delta", ["d_x", "d_z"]).collect() if "1" not in (r.i, r.j)}
    some = df.where("x IS NOT NULL").select("g", "k", "t", "x")
    counts = {}
    for r in ranking.pair_training_table(some, "g", "k", "t", ["x"]).where("label = 1").collect():
        counts[r.g, r.d_x] = counts.get((r.g, r.d_x), 0) + 1
    monkeypatch.setattr(ranking, "pair_training_table", None)
    got = {(r.g, r.i, r.j): r.s for r in ranking._pair_gram(df, "g", "k", "t", ["x", "z"]).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert {(r.g, r.d_x): r.n_ for r in ranking._difference_counts(some, "g", "k", "t", ["x"]).collect()} == counts
    ranking.evaluate_pairwise(some.where("k IS NOT NULL"), "g", "k", "t", ["x"], 0.1)
    ranking.calibrate_scores(df, "g", "k", "t", ["x", "z"], 1.0, "x")


def plain_logistic(x, y, lam):
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (q - y) / len(y) + lam * w
        w = w - np.linalg.solve((x.T * (q * (1 - q))) @ x / len(y) + lam * np.eye(len(w)), grad)
    return w


def test_logistic_folds_equal_direct_fits(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, -0.5, 2.0] + rng.logistic(size=240) > 0).astype(int)
    g = rng.choice(list("abcd"), size=240)
    df = spark.createDataFrame([(str(k), *map(float, r), int(v)) for k, r, v in zip(g, x, y)], "g string, a double, b double, c double, label int").repartition(5)
    for lam in (0.0, 0.3):
        got = {(r.fold, r.feature): r.weight for r in ranking.logo_logistic(df, "g", "label", ["a", "b", "c"], lam).collect()}
        for fold in "abcd":
            want = plain_logistic(x[g != fold], y[g != fold], lam)
            assert [got[fold, c] for c in "abc"] == pytest.approx(want, abs=1e-7)
        whole = {r.feature: r.weight for r in ranking.pairwise_logistic_fit(df, "label", ["a", "b", "c"], lam).collect()}
        assert [whole[c] for c in "abc"] == pytest.approx(plain_logistic(x, y, lam), abs=1e-7)
    apart = spark.createDataFrame([(1.0, 1), (-1.0, 0)] * 5, "a double, label int")
    assert ranking.pairwise_logistic_fit(apart, "label", ["a"], 0.01).first().weight == pytest.approx(plain_logistic(np.array([[1.0], [-1.0]]), np.array([1, 0]), 0.01)[0], abs=1e-7)


def test_evaluation_with_groups_left_out(spark):
    rng = random.Random(14)
    rows = [(g, 10 * k + n, rng.random(), rng.random()) for k, g in enumerate("abcde") for n in range(5)]
    rows = [(g, k, a, b, round(2 * a - b + rng.gauss(0, 0.3), 1)) for g, k, a, b in rows]
    df = spark.createDataFrame(rows, "g string, k int, a double, b double, t double")
    found = ranking.evaluate_pairwise(df, "g", "k", "t", ["a", "b"], 0.05)
    weights, metrics = {}, {r.g: r for r in found.metrics.collect()}
    for r in found.weights.collect():
        weights.setdefault(r.fold, {})[r.feature] = r.weight
    correct = total = 0
    for fold in "abcde":
        pairs = [(np.array([p[2] - q[2], p[3] - q[3]]), int(p[4] > q[4])) for p, q in itertools.combinations(rows, 2) if p[0] == q[0] != fold and p[4] != q[4]]
        want = plain_logistic(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]), 0.05)
        assert [weights[fold]["a"], weights[fold]["b"]] == pytest.approx(want, abs=1e-7)
        own = [(k, want[0] * a + want[1] * b, t) for g, k, a, b, t in rows if g == fold]
        good = [np.sign(p[1] - q[1]) == np.sign(p[2] - q[2]) for p, q in itertools.combinations(own, 2) if p[2] != q[2]]
        assert (metrics[fold].n_correct, metrics[fold].n_pairs) == (sum(good), len(good))
        assert metrics[fold].hit == (min(own, key=lambda r: r[1])[2] == min(r[2] for r in own))
        correct, total = correct + sum(good), total + len(good)
    report = found.report.first()
    assert report.n_groups == 5 and report.pair_accuracy == pytest.approx(correct / total)
    ridge = ranking.evaluate_ridge(df, "g", "k", "t", ["a", "b"], 0.0)
    assert ridge.weights.count() == 15 and ridge.predictions.count() == 25 and ridge.metrics.count() == 5


def test_feature_screen_finds_proxies_by_rank(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL", 0)
    rng = random.Random(15)
    items = [(k, rng.gauss(0, 1) + (k % 2), k % 2) for k in range(80)]
    values = {"same": lambda v, c: math.exp(v), "back": lambda v, c: -v, "class": lambda v, c: c + rng.random(), "noise": lambda v, c: 50 * rng.random(), "flat": lambda v, c: 1.0}
    rows = [(k, f, float(make(v, c)), c, 1.0) for k, v, c in items for f, make in values.items()]
    df = spark.createDataFrame(rows, "i int, f string, x double, c int, w double")
    base = spark.createDataFrame([(k, v) for k, v, _ in items], "i int, value double")
    got = {r.f: r for r in audit.feature_screen(df, "i", "f", "x", "c", 1, 0, "w", base).collect()}
    assert [f for f, r in got.items() if r.proxy] == [f for f in got if f in ("same", "back")] and got["flat"].rho is None
    auc = brute_auc([(v, c, 1.0) for _, v, c in items])
    assert got["back"].auc_gap == pytest.approx(0) and got["class"].auc_gap == pytest.approx(1 - max(auc, 1 - auc))
    assert [f for f, r in got.items() if r.selected] == ["class"]
    assert [f for f, r in got.items() if r.selected_default] == [max(got, key=lambda f: abs(got[f].delta))]


def test_negatives_ladder_and_shortfall(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "item_id int, s string, t string")
    pool = spark.createDataFrame([(1, "a", "x"), (4, "a", "x"), (5, "a", "q")], "cand_id int, s string, t string")
    got = sorted((r.item_id, r.cand_id, r.level_used) for r in screening.matched_negatives_ladder(items, pool, [["s", "t"], ["s"]], 5, 1).collect())
    assert got == [(1, 4, 1), (2, 1, 2), (2, 4, 2), (2, 5, 2)]
    short = {r.item_id: r.n_short for r in screening.shortfall(items, screening.matched_negatives(items, pool, ["s"], 2, 1), 2).collect()}
    assert short == {1: 0, 2: 0, 3: 2}


def test_min_distance_filter_equals_greedy(spark):
    rng = random.Random(24)
    rows = [(i, c, sorted(rng.sample(range(8), 4)), rng.random()) for i in range(4) for c in rng.sample(range(1000), 40)]
    got = sorted((r.i, r.c) for r in screening.min_distance_filter(spark.createDataFrame(rows, "i int, c int, v array<int>, d double"), "i", "c", "v", "d", 0.2, 0.5).collect())
    want = []
    for i in range(4):
        kept = []
        for c, v in sorted((c, set(v)) for j, c, v, d in rows if j == i and d >= 0.2):
            if all(1 - len(v & o) / len(v | o) >= 0.5 for o in kept):
                kept.append(v)
                want.append((i, c))
    assert got == want


def test_ridge_weights_predict(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a - b + 3)) for a, b in x], "a double, b double, y double")
    w = ranking.ridge_fit(df, "y", ["a", "b"], 0.0)
    assert {r.feature: round(r.weight, 9) for r in w.collect()} == {"a": 2.0, "b": -1.0, "intercept": 3.0}
    assert ranking.predict(df, w, ["a", "b"]).where("abs(pred - y) > 1e-9").count() == 0


def test_leaderboard(spark):
    rng = random.Random(26)
    rows = [(c, g, k, rng.random() * s + t, t) for c, s in (("bad", 9.0), ("good", 0.01), ("mid", 1.0)) for g in "xyz" for k, t in enumerate([1.0, 2.0, 3.0, 4.0])]
    got = {r.c: r for r in ranking.sweep_leaderboard(spark.createDataFrame(rows, "c string, g string, k int, p double, t double"), "c", "g", "k", "p", "t").collect()}
    assert [c for c in got if got[c].best] == ["good"] and got["good"].mean_rho == got["good"].pair_accuracy == got["good"].top1_rate == 1.0
    pairs = [(rows[i], rows[j]) for i in range(len(rows)) for j in range(i) if rows[i][:2] == rows[j][:2] and rows[i][0] == "bad"]
    assert got["bad"].pair_accuracy == pytest.approx(sum((a[3] > b[3]) == (a[4] > b[4]) for a, b in pairs) / len(pairs))


def test_maxmin_choice_equals_greedy(spark):
    rng = random.Random(11)
    rows = [(1, k, sorted(rng.sample(range(10), 4))) for k in range(12)]
    got = [r.c for r in screening.maxmin_select(spark.createDataFrame(rows, "i int, c int, v array<int>"), "i", "c", "v", 4, 3).orderBy("turn").collect()]
    import hashlib

    turn = {c: hashlib.md5(f"3|1|{c}".encode()).hexdigest() for _, c, _ in rows}
    sets = {c: set(v) for _, c, v in rows}
    chosen = [min(sets, key=turn.get)]
    while len(chosen) < 4:
        rest = [c for c in sets if c not in chosen]
        d = {c: min(1 - len(sets[c] & sets[x]) / len(sets[c] | sets[x]) for x in chosen) for c in rest}
        chosen.append(min(rest, key=lambda c: (-d[c], turn[c])))
    assert got == chosen


def test_components_and_distances(spark):
    edges = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 3, 1), ("p", 1, 2), ("p", 2, 3), ("p", 3, 4), ("d", 1, 2), ("d", 5, 6)], "graph string, u int, v int")
    nodes = edges.select("graph", F.explode(F.array("u", "v")).alias("node")).distinct().union(spark.createDataFrame([("single", 9)], "graph string, node int"))
    for small in (100_000, 4, 0):
        got = {r.graph: (r.n_components, r.cyclomatic) for r in graphs.components(nodes, edges, small=small).collect()}
        assert got == {"t": (1, 1), "p": (1, 0), "d": (2, 0), "single": (1, 0)}
    far = {r.graph: (r.diameter, r.wiener) for r in graphs.graph_distances(edges).collect()}
    assert far["p"] == (3, 10) and far["t"] == (1, 3)
    shape = {r.graph: (r.n_triangles, r.mean_clustering) for r in graphs.graph_shape(edges).collect()}
    assert shape["t"] == (1, 1.0) and shape["p"] == (0, 0.0)


def test_spectrum_traces(spark):
    edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3)], "graph string, u int, v int")
    assert [round(r.value, 9) for r in graphs.spectrum(edges).orderBy("k").collect()] == [0.0, 1.0, 3.0]
    large = graphs.spectrum(edges, max_nodes=2).collect()
    assert [(r.status, r.n_nodes, r.k, r.value, r.trace, r.trace_sq) for r in large] == [("too_large", 3, None, None, 4.0, 10.0)]
    assert graphs.spectrum(edges, weights=True).agg(F.sum("first_weight")).first()[0] == pytest.approx(1.0)
    path = spark.range(2500).select(F.lit("path").alias("graph"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    values = [r.value for r in graphs.spectrum(path).orderBy("k").collect()]
    assert np.allclose(values, 2 - 2 * np.cos(np.pi * np.arange(2501) / 2501), atol=1e-8)


def test_spectra_of_many_graphs_are_solved_together(spark, monkeypatch):
    monkeypatch.setattr(graphs, "CELLS", 60)
    rng = random.Random(53)
    rows = [(g, rng.randrange(9), rng.randrange(9)) for g in range(60) for _ in range(rng.randint(1, 12))] + [(None, 1, 2)]
    got = {}
    found = graphs.spectrum(spark.createDataFrame(rows, "graph int, u int, v int"))
    for r in found.orderBy("graph", "k").collect():
        got.setdefault(r.graph, []).append(r.value)
    for g in range(60):
        a = np.zeros((9, 9))
        for h, u, v in rows:
            if h == g and u != v:
                a[u, v] = a[v, u] = 1
        a = a[a.sum(0) > 0][:, a.sum(0) > 0]
        assert got.get(g, []) == pytest.approx(list(np.linalg.eigvalsh(np.diag(a.sum(0)) - a)) if len(a) else [], abs=1e-9)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_distances_and_components_of_long_paths(spark):
    path = spark.range(220).select(F.lit("path").alias("graph"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    r = graphs.graph_distances(path).first()
    assert (r.diameter, r.wiener, r.leaves) == (220, 220 * 221 * 222 // 6, 2)
    long = spark.range(600).select(F.lit("path").alias("graph"), (F.col("id") * 389 % 601).alias("u"), ((F.col("id") + 1) * 389 % 601).alias("v"))
    nodes = long.select("graph", F.explode(F.array("u", "v")).alias("node"))
    assert graphs.components(nodes, long).first().n_components == 1
    assert graphs.components(path.select("graph", F.explode(F.array("u", "v")).alias("node")), path, small=100).first().n_components == 1


def test_moments_and_shape_equal_dense_matrices(spark):
    rng = random.Random(28)
    rows = [(g, rng.randrange(12), rng.randrange(12)) for g in "ab" for _ in range(40)] + [("hub", 0, k) for k in range(1, 200)] + [("hub", k, k + 1) for k in range(1, 20)]
    edges = spark.createDataFrame(rows, "graph string, u int, v int")
    moments = {r.graph: (r.m2, r.m3, r.m4) for r in graphs.spectral_moments(edges).collect()}
    shape = {r.graph: r for r in graphs.graph_shape(edges).collect()}
    for g in ("a", "b", "hub"):
        a = np.zeros((201, 201))
        for h, u, v in rows:
            if h == g and u != v:
                a[u, v] = a[v, u] = 1
        d = a.sum(0)
        a, d = a[d > 0][:, d > 0], d[d > 0]
        assert moments[g] == pytest.approx([np.trace(np.linalg.matrix_power(a, k)) / len(d) for k in (2, 3, 4)])
        tri = np.diag(a @ a @ a) / 2
        assert shape[g].n_triangles == round(tri.sum() / 3)
        assert shape[g].mean_clustering == pytest.approx(np.where(d > 1, 2 * tri / np.maximum(d * (d - 1), 1), 0).mean())


@pytest.mark.parametrize("seed", range(5))
def test_pairwise_kl_equals_brute_force(spark, seed):
    """Chains over few of many keys, so that some pairs share none."""
    rng = random.Random(seed)
    own = {c: rng.sample("stuvwxyz", rng.randint(1, 3)) for c in range(6)}
    rows = [(c, rng.choice(own[c])) for c in own for _ in range(20)]
    eps, keys = 1e-3, sorted({k for _, k in rows})
    dist = {c: {k: (sum(r == (c, k) for r in rows) / 20 + eps) / (1 + len(keys) * eps) for k in keys} for c in own}
    want = [sum(dist[a][k] * np.log(dist[a][k] / dist[b][k]) for k in keys) for a in own for b in own if a != b]
    got = distributions.pairwise_kl(spark.createDataFrame(rows, "c int, k string"), "c", "k", eps).first()
    assert (got.kl_max, got.kl_mean) == (pytest.approx(max(want)), pytest.approx(np.mean(want)))


@pytest.mark.parametrize("seed", range(2))
def test_pairwise_kl_in_blocks_equals_brute_force(spark, seed, monkeypatch):
    """Keys that all chains have, and such as few have; chains of a block taken a few at a time."""
    for name, value in (("SHARED", 0), ("CHAINS", 7), ("STRIP", 2), ("TABLES", 30)):
        monkeypatch.setattr(distributions, name, value)
    seen = []
    monkeypatch.setattr(distributions, "written", lambda df, name: (seen.append(df.columns), files.written(df, name))[1])
    rng = random.Random(seed)
    own = {c: rng.sample(range(40), rng.randint(1, 3)) for c in range(30)}
    rows = [(c, k) for c in own for k in [*own[c] * rng.randint(1, 3), *[50 + rng.randint(0, 1) for _ in range(rng.randint(0, 6))]]]
    eps, keys = 1e-3, sorted({k for _, k in rows})
    size = {c: sum(r[0] == c for r in rows) for c in own}
    dist = {c: {k: (rows.count((c, k)) / size[c] + eps) / (1 + len(keys) * eps) for k in keys} for c in own}
    want = [sum(dist[a][k] * np.log(dist[a][k] / dist[b][k]) for k in keys) for a in own for b in own if a != b]
    got = distributions.pairwise_kl(spark.createDataFrame(rows, "c int, k int"), "c", "k", eps).first()
    assert (got.kl_max, got.kl_mean) == (pytest.approx(max(want)), pytest.approx(np.mean(want)))
    assert seen and ["a", "b", "s"] not in seen  # no pair is a row


def test_temperature_fit_recovers_lambda(spark):
    e = np.arange(6) * 0.4
    p = np.exp(-1.7 * e) / np.exp(-1.7 * e).sum()
    df = spark.createDataFrame([(float(a), 1.0, float(b)) for a, b in zip(p, e)], "o double, g double, e double")
    assert distributions.fit_temperature(df, "o", "g", "e").first().lam == pytest.approx(1.7, abs=1e-3)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1), ("b", 2)], "id string, n int")
    files.write_result(df, str(tmp_path / "csv"), "csv")
    assert sorted(r.id for r in files.read_items_csv(spark, str(tmp_path / "csv")).collect()) == ["a", "b"]
    assert files.read_optional(spark, str(tmp_path / "none"), "x int").count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.json").write_text('{"schema_version": "v1", "original": {"score": 0.5}, "decoys": {"h": {"weight": 2.0}}}')
    got = {(r.item_id, r.is_original, r.score, r.weight) for r in files.read_scores_json(spark, str(tmp_path / "raw"), "v1").collect()}
    assert got == {(None, True, 0.5, 1.0), ("h", False, 0.0, 2.0)}
    import hashlib

    one = files.file_manifest(spark, str(tmp_path / "raw")).first()
    assert (one.path, one.sha256) == ("s.json", hashlib.sha256((tmp_path / "raw" / "s.json").read_bytes()).hexdigest())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, score double, label int, weight double, k int")
    assert audit.item_audit(empty, ["g"]).count() == 0
    assert ranking.spearman(empty, ["g"], "score", "weight").count() == 0
    assert joins.tolerance_join(empty, "k", "score", 0.1).count() == 0
    assert stats.status_summary(empty, "g").first().n_rows == 0


def test_row_seeds(spark):
    import zlib

    rows = spark.range(50).select("id", S.row_seed(42, F.col("id").cast("string")).alias("s")).collect()
    assert all(r.s == zlib.crc32(str(r.id).encode()) ^ 42 for r in rows)


def test_running_percentile(spark):
    values = [float(k * 7919 % 1000) for k in range(1000)]
    r = stats.running_percentile(spark.createDataFrame([("g", v) for v in values], "g string, x double"), ["g"], "x", 0.9).first()
    assert r.mean == pytest.approx(np.mean(values)) and abs(r.percentile - 900) <= 1


def test_scalars(spark):
    row = spark.range(1).select(
        S.size_bin(F.lit(81)).alias("bin"),
        S.clamp01(F.lit(None).cast("double")).alias("none"),
        S.parse_number(F.lit(" x ")).alias("bad"),
        S.set_similarity(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("empty"),
        S.list_cost(F.array(F.lit(1.0)), [2.0, 3.0], 2).alias("cost"),
        S.list_cost(F.array().cast("array<double>"), [2.0], 1).alias("no_cost"),
    ).first()
    assert (row.bin, row.none, row.bad, row.empty, row.cost, row.no_cost) == ("81-200", None, None, None, 1.0, 1e9)


# Order within groups of any size


def test_running_equals_windows_in_skewed_groups(spark):
    rng = random.Random(8)
    names = ["hot"] * 900 + ["a", "b", None, "c"] * 25
    rows = [(g, rng.choice([None, 1.0, 2.5, float("nan")]) if rng.random() < 0.4 else rng.random(), rng.randrange(5), k) for k, g in enumerate(names)]
    df = spark.createDataFrame(rows, "g string, x double, n int, id int")
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"s": F.coalesce(F.sum("n").over(w), F.lit(0)), "m": F.max("id").over(w), "s_all": F.sum("n").over(Window.partitionBy("g")), "m_all": F.max("id").over(Window.partitionBy("g"))})
    for ranges in (1, 7, 40, None):
        got = ordered.running(df, ["g"], ["x", "id"], {"s": "n"}, {"m": "id"}, totals=True, ranges=ranges, sizes=None if ranges else df)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    whole = ordered.running(df, [], ["id"], {"s": "n"}, ranges=9).orderBy("id").collect()
    assert [r.s for r in whole] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
    assert ordered.running(df.limit(0), ["g"], ["x"], {"s": "n"}).count() == 0


def test_a_hot_group_is_split_over_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.rand(1).alias("x"))
    rows = ordered.ranged(df, ["g", "x"], 8)
    counts = [r["count"] for r in rows.groupBy("part_").count().collect()]
    assert len(counts) == 8 and max(counts) < 1000


@pytest.mark.parametrize("small", [0, 10**6])
def test_ranks_and_quantiles_of_skewed_groups(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    rng = random.Random(9)
    rows = [("hot" if k % 10 else rng.choice("ab"), rng.choice([1.0, 1.0, None, rng.random()]), rng.choice([2.0, rng.random()])) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    w = Window.partitionBy("g")
    mean = F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy("g", "x")) - 1) / F.lit(2.0)
    want = df.withColumn("r", mean)
    assert sorted(map(str, windows.average_rank(df, ["g"], "x").collect())) == sorted(map(str, want.collect()))
    got = {r.g: r for r in stats.ranked_quantiles(df, ["g"], "x", {"low": 0.1, "mid": 0.5, "all": 1.0}).collect()}
    for g in ("hot", "a", "b"):
        x = sorted(v for k, v, _ in rows if k == g and v is not None)
        assert [got[g].low, got[g].mid, got[g].all] == [x[max(1, round(q * len(x))) - 1] for q in (0.1, 0.5, 1.0)]
    rho = {r.g: r.rho for r in ranking.spearman(df, ["g"], "x", "y").collect()}
    for g in ("hot", "a"):
        both = pd.DataFrame([(a, b) for k, a, b in rows if k == g and a is not None], columns=["a", "b"])
        assert rho[g] == pytest.approx(both.a.rank().corr(both.b.rank()), abs=1e-10)


# Long sequences


@pytest.mark.parametrize("max_lag,block", [(3, 16), (7, 5), (60, 64), (90, 10), (5, 1 << 16)])
def test_autocorrelation_in_blocks(spark, monkeypatch, max_lag, block):
    monkeypatch.setattr(ordered, "SMALL", 0 if block < 60 else 10**6)
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(max_lag)
    chains = {"long": 400, "two": 2, "one": 1, "flat": 30, "a": 64, "b": 65, None: 40}
    rows = [(c, i, 7.0 if c == "flat" else 1e3 + rng.gauss(0, 1) + (i % 5)) for c, n in chains.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, t int, x double").repartition(5)
    got = {(r.c, r.lag): (r.n, r.rho) for r in windows.autocorrelation(df, "c", ["t"], "x", max_lag).collect()}
    want = {}
    for c, n in chains.items():
        d = np.array([x for k, _, x in sorted(r for r in rows if r[0] == c)] if c else [x for _, _, x in sorted((r for r in rows if r[0] is None), key=lambda r: r[1])])
        d = d - d.mean()
        if (d * d).sum() > 0:
            want |= {(c, k): (n, (d[:-k] * d[k:]).sum() / (d * d).sum()) for k in range(1, min(max_lag, n - 1) + 1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    one = {r.c: r.rho1 for r in windows.lag1_autocorr(df, "c", ["t"], "x").collect()}
    assert set(one) == set(chains) and one["flat"] == 0 and one["long"] == pytest.approx(want["long", 1][1], abs=1e-9)


def test_null_values_count_as_the_mean(spark):
    df = spark.createDataFrame([("a", k, None if k == 3 else float(k)) for k in range(6)], "c string, t int, x double")
    d = np.array([0, 1, 2, 2.4, 4, 5]) - 2.4
    got = windows.autocorrelation(df, "c", ["t"], "x", 1).first()
    assert (got.n, got.rho) == (6, pytest.approx((d[:-1] * d[1:]).sum() / (d * d).sum()))


# Nulls with ties and weights


def null_groups(rng):
    rows = []
    for g, n, m in (("one", 7, 1), ("last", 9, 8), ("small", 8, 3), ("ten", 10, 5), ("none", 5, 0), ("all", 4, 4), (None, 6, 2), ("big", 60, 20), ("more", 45, 43), ("even", 30, 15)):
        labels = [1] * m + [0] * (n - m)
        rng.shuffle(labels)
        rows += [(g, float(rng.randint(0, 4)), y, rng.choice([0.5, 1.0, 2.0])) for y in labels]
    return rows


def test_label_nulls_equal_brute_force(spark):
    rows = null_groups(random.Random(4))
    df = spark.createDataFrame(rows + [("one", None, 1, 1.0), ("one", 1.0, None, 1.0), ("one", float("nan"), 0, 1.0)], "g string, score double, label int, weight double")
    for weight in ("weight", None):
        got = {r.g: r for r in nulls.label_null(df, ["g"], 400, 0.9, 3, weight=weight).collect()}
        for g, r in got.items():
            items = [(s, y, w if weight else 1.0) for k, s, y, w in rows if k == g]
            m = sum(y for _, y, _ in items)
            assert (r.n_pos, r.n_neg) == (m, len(items) - m)
            if m in (0, len(items)):
                assert (r.null_method, r.null_q, r.n_draws) == ("none", None, None)
            elif r.null_method != "draws":
                assert r.null_method == ("single" if m in (1, len(items) - 1) else "enumeration")
                aucs = sorted(brute_auc([(s, int(k in pos), w) for k, (s, _, w) in enumerate(items)]) for pos in itertools.combinations(range(len(items)), m))
                assert r.n_draws == len(aucs) and r.null_mean == pytest.approx(sum(aucs) / len(aucs))
                assert r.null_q == pytest.approx(aucs[max(1, math.ceil(len(aucs) * 0.9 - 1e-9)) - 1])
            else:
                rng, labels, aucs = random.Random(1), [y for _, y, _ in items], []
                for _ in range(1500):
                    rng.shuffle(labels)
                    aucs.append(brute_auc([(s, y, w) for (s, _, w), y in zip(items, labels, strict=True)]))
                spread = np.std(aucs)
                assert r.n_draws == 400 and abs(r.null_mean - np.mean(aucs)) < 5 * spread / 400**0.5
                assert abs(r.null_q - np.quantile(aucs, 0.9)) < 0.4 * spread
        assert {r.null_method for r in got.values()} == {"none", "single", "enumeration", "draws"}


def test_draws_do_not_depend_on_partitions_or_block_counts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(g, rng.random(), rng.randint(0, 1), rng.choice([1.0, 2.0])) for g in "ab" for _ in range(300)]
    monkeypatch.setattr(nulls, "FAN", 8)  # four levels
    seen = set()
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "g string, score double, label int, weight double").repartition(parts)
        seen.add(tuple(sorted(map(tuple, nulls.label_null(df, ["g"], 50, 0.9, 3).collect()))))
    assert len(seen) == 1
    a = next(iter(seen))[0]
    assert a[:3] == ("a", sum(y for g, _, y, _ in rows if g == "a"), sum(1 - y for g, _, y, _ in rows if g == "a")) and abs(a[5] - 0.5) < 0.03


def test_positives_are_dealt_without_replacement(monkeypatch):
    rng = np.random.default_rng(0)
    sizes = np.array([5, 1, 0, 30, 14])
    m = np.full(4000, 20)
    for limit in (10**9, 1):
        monkeypatch.setattr(nulls, "EXACT", limit)
        out = nulls.deal(rng, sizes, m)
        assert (out.sum(axis=1) == 20).all() and (out <= sizes).all() and (out >= 0).all()
        assert np.abs(out.mean(axis=0) - 20 * sizes / 50).max() < 0.15


def test_item_audit_with_ties_and_weights(spark):
    rows = null_groups(random.Random(4))
    df = spark.createDataFrame(rows, "g string, score double, label int, weight double")
    null = {r.g: r.null_q for r in nulls.label_null(df, ["g"], 100, 0.8, 5).collect()}
    for r in audit.item_audit_labels(df, ["g"], 100, 0.8, 0.02, 5).collect():
        auc = brute_auc([x[1:] for x in rows if x[0] == r.g])
        assert (r.auc is None and auc is None) or r.auc == pytest.approx(auc)
        assert r.null_q == null[r.g]
        if r.null_q is None:
            assert (r.gate, r.slack, r.verdict) == (None, None, None)
        else:
            assert r.gate == min(1.0, r.null_q + 0.02) and r.verdict == ("PASS" if r.auc - r.gate >= 0 else "FAIL")


def test_keyed_draws_keep_weights(spark):
    rows = [(k, float(k % 5), int(k % 3 == 0), 1.0 + k % 4) for k in range(24)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id int, score double, label int, weight double")
    want = []
    for rep in range(1, 31):
        order = sorted(rows, key=lambda r: hashlib.md5(f"9|{rep}|{r[0]}".encode()).hexdigest())
        chosen = {r[0] for r in order[: sum(r[2] for r in rows)]}
        want.append(brute_auc([(s, int(k in chosen), w) for k, s, _, w in rows]))
    assert audit.null_by_permutation(df, ["g"], "id", 30, 0.5, 9, weight="weight").first().null_mean == pytest.approx(np.mean(want))


# Pairs that are counted and not listed


@pytest.mark.parametrize("tol", [0.0, 0.25, 1.0, 50.0])
def test_tolerance_counts_equal_all_pairs(spark, monkeypatch, tol):
    monkeypatch.setattr(ordered, "SMALL", 0 if tol < 1 else 10**6)
    rng = random.Random(int(tol * 4))
    draw = [lambda: rng.choice([0.0, 1.0, -1.0, 0.25, 2.0]), lambda: rng.uniform(-3, 3), lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-18, 3)]
    rows = [(k, rng.choice(draw)(), rng.choice(["a", "a", "b", None])) for k in range(300)] + [(901, None, "a"), (902, float("inf"), "a"), (903, float("-inf"), "b")]
    df = spark.createDataFrame(rows, "id int, x double, g string")
    pairs = [(x, y, p, q) for (_, x, p), (_, y, q) in itertools.combinations([r for r in rows if r[1] is not None], 2) if abs(x - y) <= tol]
    apart = [abs(x - y) for x, y, p, q in pairs if p and q and p != q]
    r = audit.collision_summary(df, "id", "x", "g", tol).first()
    assert (r.n_pairs, r.n_within, r.n_across) == (len(pairs), sum(p is not None and p == q for _, _, p, q in pairs), len(apart))
    assert r.max_across_gap == max(apart, default=0.0) and r.n_total == 302 * 301 // 2


def test_dense_values_are_counted_without_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL", 0)
    n = 200_000
    df = spark.range(n).select("id", (F.col("id") / n).alias("x"), (F.col("id") % 2).alias("g"))
    r = audit.collision_summary(df, "id", "x", "g", 1.0).first()
    assert (r.n_pairs, r.n_within, r.n_across) == (n * (n - 1) // 2, 2 * (n // 2) * (n // 2 - 1) // 2, (n // 2) ** 2)
    assert r.max_across_gap == (n - 1) / n


def test_vector_collisions_equal_all_pairs(spark):
    rng = random.Random(12)
    for tol, size in ((0.0, 1.0), (0.01, 1.0), (0.5, 1e4)):
        vs = [[1.0, 2.0, *(round(rng.random() * size, 2) for _ in range(rng.choice([1, 2, 3])))] for _ in range(120)]
        vs += vs[:20] + [[x * (1 + rng.choice([1e-5, 0.99e-5, 1.01e-5])) + tol for x in v] for v in vs[:40]] + [[float("nan"), 1.0], [float("inf"), 1.0], [], None, [0.0], [-0.0]]
        order = list(range(len(vs)))
        rng.shuffle(order)
        rows = list(zip(order, vs, strict=True))
        got = audit.vector_collision_rate(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", tol).first()
        some = sorted(r for r in rows if r[1])
        near = sum(len(a) == len(b) and all(abs(x - y) <= tol + 1e-5 * abs(y) for x, y in zip(a, b)) for (_, a), (_, b) in itertools.combinations(some, 2) if not any(math.isinf(x) for x in a + b))
        assert (got.n_equal, got.n_total) == (near, len(some) * (len(some) - 1) // 2)


def test_constant_leading_coordinates_cost_no_pairs(spark):
    n = 30_000
    df = spark.range(n).select("id", F.array(F.lit(1.0), F.lit(2.0), (F.col("id") % 10_000).cast("double") * 5).alias("v"))
    r = audit.vector_collision_rate(df, "id", "v", 0.5).first()
    assert r.n_equal == 10_000 * 3


def test_null_quantiles_of_few_and_many_positives():
    for m, n in ((1, 1), (1, 9), (2, 2), (2, 7), (2, 40), (3, 30), (5, 17)):
        aucs = sorted(sum(p - k for k, p in enumerate(c)) for c in itertools.combinations(range(n + m), m))
        for q in (0.05, 0.5, 0.9, 0.95, 1.0):
            want = aucs[max(1, math.ceil(len(aucs) * (q - 1e-11))) - 1] / (m * n)
            assert audit.exact_null_quantile(m, n, q) == audit.exact_null_quantile(n, m, q) == pytest.approx(want, abs=1e-12)
    # Two against a billion: the triangle of the limit; three against a million: the inversion by blocks equals the product.
    assert audit.exact_null_quantile(2, 10**9, 0.95) == pytest.approx(1 - (0.05 / 2) ** 0.5, abs=1e-6)
    masses = np.cumsum(audit._null_masses(3, 20_000))
    assert audit._null_below(3, 20_000)(40_000) == pytest.approx(masses[40_000], abs=1e-11)


def test_null_quantile_of_large_classes_in_bounded_memory():
    tracemalloc.start()
    got = audit.exact_null_quantile(200_000, 300_000, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sd = (500_001 / (12 * 200_000 * 300_000)) ** 0.5
    assert got == pytest.approx(0.5 + 1.6448536 * sd, rel=1e-6) and peak < 300 << 20


# Sets with many copies


def test_hard_negatives_of_many_copies(spark):
    rng = random.Random(31)
    rows = [(k, [1, 2, 3, 4]) for k in range(3000)] + [(5000 + k, rng.sample(range(1, 8), rng.randint(3, 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, s array<int>")
    pairs, members = screening.alike(df, "k", "s", 0.5)
    assert pairs.count() < 2000
    sets = dict((k, frozenset(s)) for k, s in rows)
    count = {s: sum(x == s for x in sets.values()) for s in set(sets.values())}
    like = {(a, b): len(a & b) / len(a | b) for a in count for b in count}
    for low, high in ((0.6, 1.0), (0.6, 0.9)):
        got = screening.hard_negatives(pairs, members, "k", low, high, 3, 7).collect()
        by = {}
        for r in got:
            by.setdefault(r.item_id, []).append(r.cand_id)
            assert r.similarity == like[sets[r.item_id], sets[r.cand_id]] and low <= r.similarity <= high
            alike = {b: n - (b == sets[r.item_id]) for b, n in count.items() if like[sets[r.item_id], b] >= 0.5}
            assert r.n_rejected == sum(n for b, n in alike.items() if not low <= like[sets[r.item_id], b] <= high)
        for k, s in sets.items():
            n = sum(c - (b == s) for b, c in count.items() if low <= like[s, b] <= high)
            found = by.get(k, [])
            assert len(found) == len(set(found)) == min(3, n) and k not in found
    n = screening.distance_summary(pairs.withColumn("d", 1 - F.col("similarity")), "item", "cand", "sb", "d", "n_cand").where("item = 0").first()
    others = [s for k, s in sets.items() if k and like[sets[0], s] >= 0.5]
    apart = [1 - like[a, b] for a, b in itertools.combinations(others[-60:], 2)]
    assert n.n == len(others) and n.min_pair_d == min(apart) == 0.0


def test_hard_negatives_are_the_lowest_digests_of_all_rows_in_the_band(spark):
    import hashlib

    rng = random.Random(61)
    sets = {k: frozenset(rng.sample(range(1, 7), rng.randint(3, 5))) for k in range(60)}
    pairs, members = screening.alike(spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "k int, s array<int>"), "k", "s", 0.5)
    got = {(r.item_id, r.cand_id) for r in screening.hard_negatives(pairs, members, "k", 0.6, 0.9, 2, 5).collect()}
    want = set()
    for a, x in sets.items():
        band = [b for b, y in sets.items() if a != b and 0.6 <= len(x & y) / len(x | y) <= 0.9]
        want |= {(a, b) for b in sorted(band, key=lambda b: hashlib.md5(f"5|{a}|{b}".encode()).hexdigest())[:2]}
    assert got == want and len(got) > 60


def test_alike_pairs_are_written_without_their_sets(spark):
    from gaugeline.functions import scalars

    rows = [(k, [1, 2, 3, 4 + k % 3]) for k in range(9)] + [(20, [1, 2, 3, 4, 5, 6])]
    pairs, _ = screening.alike(spark.createDataFrame(rows, "k int, s array<int>"), "k", "s", 0.5, sets=False)
    full, _ = screening.alike(spark.createDataFrame(rows, "k int, s array<int>"), "k", "s", 0.5)
    assert not {"sa", "sb"} & set(pairs.columns) and "array" not in dict(pairs.dtypes).values()
    both = full.select("item", "cand", "na", "nb", scalars.edge_distance(F.col("sa"), F.col("sb"), F.size("sa") + 2).alias("d"))
    want = {(r.item, r.cand, r.na, r.nb): r.d for r in both.collect()}
    of = scalars.edge_distance_of(F.col("similarity"), F.col("na"), F.col("nb"), F.col("na") + 2)
    assert {(r.item, r.cand, r.na, r.nb): r.d for r in pairs.withColumn("d", of).collect()} == want and len(want) > 6


def test_candidates_of_an_item_in_one_task_and_in_rounds_are_the_same(spark, monkeypatch):
    rng = random.Random(63)
    rows = [(i, c, sorted(rng.sample(range(9), rng.randint(0, 5))), rng.random(), rng.randint(1, 3)) for i in range(9) for c in rng.sample(range(100), 3 * i + 1)]
    df = spark.createDataFrame(rows, "i int, c int, v array<int>, d double, n long").cache()
    found, steps = [], []
    monkeypatch.setattr(screening, "written", lambda df, name: (steps.append(name), files.written(df, name))[1])
    for most, task in ((2_000_000, 4_000_000), (2_000_000, 20), (30, 20), (-1, 20)):
        monkeypatch.setattr(screening, "ITEM", most)
        monkeypatch.setattr(screening, "TASK", task)
        steps.clear()
        taken = sorted((r.i, r.c) for r in screening.min_distance_filter(df, "i", "c", "v", "d", 0.2, 0.7).collect())
        far = sorted(tuple(r) for r in screening.maxmin_select(df, "i", "c", "v", 3, 5).collect())
        told = {r.i: r[1:] for r in screening.distance_summary(df, "i", "c", "v", "d", "n").collect()}
        found.append((taken, far, told))
        assert (most > 1000) == ({*steps} == {"candidates", "sizes"})
    for taken, far, told in found:
        assert taken == found[-1][0] and far == found[-1][1] and len(taken) > 20 and len(far) > 20
        assert {i: t[:1] for i, t in told.items()} == {i: t[:1] for i, t in found[-1][2].items()}
        for i, t in told.items():
            assert [x for x in t if x is not None] == pytest.approx([x for x in found[-1][2][i] if x is not None])


def test_plan_of_maxmin_choice_does_not_grow(spark):
    df = spark.createDataFrame([(1, k, [k, k + 1, k % 3]) for k in range(12)], "i int, c int, v array<int>")
    plans = [screening.maxmin_select(df, "i", "c", "v", k, 3)._jdf.queryExecution().toString().count("Join") for k in (2, 6)]
    assert plans[0] == plans[1] == 0


# Sketches and scratch


def test_quantile_sketches_are_merged_within_their_bound(spark):
    rng = random.Random(41)
    rows = [(run, rng.expovariate(1)) for run in range(40) for _ in range(500)] + [(99, None), (99, float("nan")), (1, float("nan"))]
    runs = stats.quantile_sketches(spark.createDataFrame(rows, "run int, x double").repartition(7), ["run"], "x")
    x = sorted(v for _, v in rows if v is not None and v == v)
    whole = stats.sketch_quantiles(stats.merge_sketches(runs), {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert whole.n == len(x) and whole.mean == pytest.approx(sum(x) / len(x))
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        at = np.searchsorted(x, whole[name]) / len(x)
        assert abs(at - q) <= whole.rank_error
    assert whole.rank_error == stats.kll_rank_error(400) < 0.011
    none = stats.sketch_quantiles(runs.where("run = 99"), {"q": 0.5}).first()
    assert (none.n, none.mean, none.q) == (0, None, None)
    short = stats.sketch_quantiles(stats.quantile_sketches(spark.createDataFrame([(1, float(k)) for k in range(101)], "run int, x double"), ["run"], "x"), {"q": 0.5}).first()
    assert short.q == 50.0


def test_written_steps_go_at_the_end_of_their_scope(spark, tmp_path):
    df = spark.range(5)
    with files.step_scope():
        kept = files.written(df, "step").inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(kept)
    assert not os.path.exists(kept)
    code = f"""
import os, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from gaugeline.sources.files import written
written(s.range(3), "left")
assert [x for x in os.listdir({str(tmp_path)!r}) if x.startswith("left-")]
s.stop()
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, env=env)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("left-")]


# Streams of late rows


def test_streams_of_late_rows_give_the_batch_results(spark, tmp_path, monkeypatch):
    from gaugeline.streaming import flows, halves

    monkeypatch.setattr(halves, "BLOCK", 4)
    rng = random.Random(51)
    rows = [(c, k, rng.choice("xyz"), rng.uniform(-2, 2)) for c in "ab" for k in range(45)] + [("one", 1, "x", 2.0)]
    rng.shuffle(rows)
    for b in range(4):
        spark.createDataFrame(rows[b * 23 : (b + 1) * 23] + [("a", None, "x", 1.0)], "c string, t long, k string, x double").coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema("c string, t long, k string, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(2):  # a restarted stream finds nothing new and tells nothing else
            flows.write_changes(halves.stream_halves(stream, "c", "t", "k"), f"{tmp_path}/halves", f"{tmp_path}/h").awaitTermination()
        flows.write_changes(halves.stream_ordered_moments(stream, "c", "t", "x"), f"{tmp_path}/moments", f"{tmp_path}/m").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = {(r.c, r.k): (r.n, r.n_first, r.n_second) for r in flows.read_changes(spark, f"{tmp_path}/halves", ["c", "k"]).collect()}
    sums = {r.c: r for r in flows.read_changes(spark, f"{tmp_path}/moments", ["c"]).collect()}
    for c in ("a", "b", "one"):
        own = sorted(r[1:] for r in rows if r[0] == c)
        first = own[: len(own) // 2]
        for k in {r[1] for r in own}:
            n, m = (sum(r[1] == k for r in part) for part in (own, first))
            assert got[c, k] == (n, m, n - m)
        x = [r[2] for r in own]
        assert [sums[c].n, sums[c].sum_x, sums[c].sum_xx, sums[c].sum_lag] == pytest.approx([len(x), sum(x), sum(v * v for v in x), sum(a * b for a, b in zip(x, x[1:]))])


# Distances in large trees


def plain_distances(edges):
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    far = total = 0
    for s in near:
        seen, front = {s: 0}, [s]
        while front:
            front = [w for u in front for w in near[u] if w not in seen and not seen.update({w: seen[u] + 1})]
        far, total = max(far, *seen.values()), total + sum(seen.values())
    return far, total // 2


def test_distances_of_trees_by_tours_equal_plain_search(spark):
    rng = random.Random(61)
    graphs_ = {
        "path": [(k, k + 1) for k in range(70)],
        "star": [(0, k) for k in range(1, 60)],
        "random": [(k, rng.randrange(k)) for k in range(1, 120)],
        "twigs": [(k, max(0, k - rng.choice([1, 1, 2]))) for k in range(1, 100)],
        "forest": [(k, rng.randrange(k)) for k in range(1, 40)] + [(k, rng.randrange(1000, k)) for k in range(1001, 1060)] + [(5000, 5001)],
        "cycle": [(k, (k + 1) % 40) for k in range(40)] + [(k, k + 1) for k in range(100, 130)],
        "edge": [(1, 2), (2, 1), (2, 2)],
    }
    edges = spark.createDataFrame([(g, *e) for g, es in graphs_.items() for e in es], "graph string, u int, v int")
    want = {g: plain_distances(es) for g, es in graphs_.items()}
    for small in (2000, 10, 0):
        got = {r.graph: (r.diameter, r.wiener) for r in graphs.graph_distances(edges, small=small).collect()}
        assert got == want


def test_distances_of_small_graphs_list_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, rng.randrange(12), rng.randrange(12)) for g in [*range(40), None] for _ in range(rng.randint(1, 14))]
    edges = spark.createDataFrame([*rows, (99, 3, 3)], "graph int, u int, v int")
    want = {}
    for g in range(40):
        es = {(min(u, v), max(u, v)) for h, u, v in rows if h == g and u != v}
        if es:
            degree = [sum(n in e for e in es) for n in {n for e in es for n in e}]
            want[g] = (*plain_distances(list(es)), degree.count(1), max(degree))
    listed = {r[0]: tuple(r)[1:] for r in graphs.graph_distances(edges, tiny=6).collect()}
    monkeypatch.setattr(graphs, "_pair_distances", None)
    got = {r[0]: tuple(r)[1:] for r in graphs.graph_distances(edges).collect()}
    assert got == want == listed


def test_distances_of_a_long_path(spark):
    n = 30_000
    edges = spark.range(n).select(F.lit(1).alias("graph"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    r = graphs.graph_distances(edges).first()
    assert (r.diameter, r.wiener, r.leaves, r.max_degree) == (n, n * (n + 1) * (n + 2) // 6, 2, 2)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/out/table"
    files.write_result(spark.range(3), path)
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        files.write_result(broken, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2] and os.listdir(f"{tmp_path}/out") == ["table"]
    files.write_result(spark.read.parquet(path).select((F.col("id") * 2).alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4] and os.listdir(f"{tmp_path}/out") == ["table"]
    files.write_result(spark.range(2), path, mode="append")
    assert spark.read.parquet(path).count() == 5


def test_manifest_of_large_files_is_read_in_chunks(spark, tmp_path):
    rng = random.Random(71)
    sizes = {"a.bin": 0, "b/c d.bin": 10, "b/é.bin": 20_000_000, "z.bin": 9_000_000}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rng.randbytes(n))
    want = sorted((name, n, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()) for name, n in sizes.items())
    for large in (256 << 20, 1 << 20, 5):
        assert [tuple(r) for r in files.file_manifest(spark, str(tmp_path), large=large).collect()] == want
