"""Whole runs on small files against plain Python."""

import csv
import glob
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import audit, batch


def test_scores_of_an_owner_go_first_and_defaults_fill(spark):
    chosen = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z")], "item_id string, cand_id string")
    scores = spark.createDataFrame(
        [("a", "x", False, 0.9, 2.0), (None, "x", False, 0.1, None), (None, "y", False, 0.2, 1.0), ("b", "b", True, 0.7, 1.0), (None, "", True, 0.6, 1.0)],
        "owner string, key string, is_original boolean, score double, weight double",
    )
    got = {(r.item_id, r.cand_id): (r.pos_score, r.neg_score, r.weight) for r in batch.scored_pairs(chosen, scores).collect()}
    assert got == {("a", "x"): (0.6, 0.9, 2.0), ("a", "y"): (0.6, 0.2, 1.0), ("b", "x"): (0.7, 0.1, 1.0), ("b", "z"): (0.7, None, 1.0)}
    filled = {(r.item_id, r.cand_id): r.neg_score for r in batch.scored_pairs(chosen, scores, 0.0).collect()}
    assert filled["b", "z"] == 0.0
    none = {r.pos_score for r in batch.scored_pairs(chosen, scores.limit(0)).collect()}
    assert none == {1.0}


def test_screening_run(spark, tmp_path):
    rng = random.Random(1)
    items = [(f"i{k}", rng.choice("pq"), "" if k == 7 else "text") for k in range(40)] + [("alone", "r", "text")]
    with open(tmp_path / "items.csv", "w", newline="") as f:
        csv.writer(f).writerows([("item_id", "stratum", "body"), *items])
    weights = {f"i{k}": 2.0 if k % 5 == 0 else 1.0 for k in range(30)}
    given = {k: {"score": rng.random(), "weight": w} for k, w in weights.items()}
    (tmp_path / "scores.json").write_text(json.dumps({"schema_version": "v1", "original": {"score": 0.8}, "decoys": given}))
    similarity = spark.range(40).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id")).withColumn("cand_id", F.lit("i1")).withColumn("similarity", F.lit(0.8))
    manifest = batch.run_screen(spark, str(tmp_path / "items.csv"), str(tmp_path / "scores.json"), "v1", str(tmp_path / "out"), ["stratum"], [(F.coalesce("body", F.lit("")) == "", "empty")], 6, 3, similarity=similarity).collect()
    listed = {r.path: r.sha256 for r in manifest}
    for path, digest in listed.items():
        assert hashlib.sha256((tmp_path / "out" / path).read_bytes()).hexdigest() == digest
    assert {p.split("/")[0] for p in listed} == {"outcomes", "pairs", "missing", "metrics", "hardness", "hardness_verdict"}
    pairs = {}
    for r in spark.read.parquet(str(tmp_path / "out/pairs")).collect():
        pairs.setdefault(r.item_id, []).append(r)
        entry = given.get(r.cand_id)
        assert (r.pos_score, r.neg_score, r.weight) == (0.8, entry and entry["score"], entry["weight"] if entry else 1.0)
    rows = {r["item_id"]: r for path in glob.glob(str(tmp_path / "out/outcomes/*.csv")) for r in csv.DictReader(open(path))}
    assert len(rows) == 41 and rows["i7"]["reason"] == "empty" and rows["alone"]["reason"] == "no_negatives"
    for i, r in rows.items():
        own = [p for p in pairs.get(i, []) if p.neg_score is not None]
        assert (int(r["n_negatives"]), int(r["n_scored"]), int(r["n_missing"])) == (len(pairs.get(i, [])), len(own), len(pairs.get(i, [])) - len(own))
        if own and r["status"] == "OK":
            auc = sum(p.weight * (p.neg_score < 0.8) for p in own) / sum(p.weight for p in own)
            assert float(r["auc"]) == pytest.approx(auc)
            gate = min(1, audit.exact_null_quantile(1, len(own), 0.95) + 0.05)
            assert float(r["gate"]) == pytest.approx(gate) and r["verdict"] == ("PASS" if auc >= gate else "FAIL")
            expected = ["scores_partially_missing"] * (int(r["n_missing"]) > 0) + ["weighted_auc_vs_unweighted_null"] * any(p.weight != 1 for p in own)
            assert r["warnings"] == ",".join(expected)
    metrics = next(csv.DictReader(open(glob.glob(str(tmp_path / "out/metrics/*.csv"))[0])))
    assert int(metrics["n_items"]) == 41 and int(metrics["n_ok"]) == sum(r["status"] == "OK" for r in rows.values()) and float(metrics["items_per_second"]) > 0
    pack = [r for path in glob.glob(str(tmp_path / "out/missing/*.csv")) for r in csv.DictReader(open(path))]
    assert 0 < len(pack) <= 10 and all(r["cand_id"] not in given for r in pack)


def test_ranking_run(spark, tmp_path):
    rng = random.Random(2)
    rows = [(g, k, t + rng.random() * (9 if g == "bad" else 0.1), t) for g, n in (("a", 3), ("b", 9), ("bad", 6)) for k, t in enumerate(range(n))]
    with open(tmp_path / "rows.csv", "w", newline="") as f:
        csv.writer(f).writerows([("g", "k", "pred", "truth"), *rows])
    report = batch.run_ranking(spark, str(tmp_path / "rows.csv"), str(tmp_path / "out"), "g", "k", "pred", "truth", {"mean_rho": 0.5}, 1).first()
    assert report.n_groups == 3 and report.verdict == ("PASS" if report.mean_rho >= 0.5 else "FAIL")
    worst = next(csv.DictReader(open(glob.glob(str(tmp_path / "out/worst/*.csv"))[0])))
    assert worst["g"] == "bad" and os.path.isdir(tmp_path / "out/metrics")
