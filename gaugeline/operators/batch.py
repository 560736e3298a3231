"""Whole runs from files to files: screening with score maps, and grouped-rank evaluation."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import ranking
from gaugeline.operators.audit import audit_verdict, audit_warnings, hardness_curve, interpret_hardness, null_auc_quantile, score_request_pack, slack_stats, weighted_auc
from gaugeline.operators.screening import matched_negatives, preflight
from gaugeline.operators.windows import worst_groups
from gaugeline.sources.files import file_manifest, read_items_csv, read_scores_json, step_scope, write_result, written


def scored_pairs(chosen: DataFrame, scores: DataFrame, default: float | None = None) -> DataFrame:
    """Negatives ``chosen(item_id, cand_id)`` with pos_score, neg_score and weight from a map of scores.

    ``scores`` is (owner, key, is_original, score, weight): an owner's own entry
    goes before one without an owner. An original without an entry scores 1. A
    negative without an entry has the score ``default`` and, if that is null, is
    missing.
    """
    rows = scores.select("owner", F.col("key").cast("string").alias("key"), "is_original", F.struct("score", F.coalesce("weight", F.lit(1.0)).alias("weight")).alias("s"))
    own = rows.where("owner IS NOT NULL").groupBy(F.col("owner").alias("item_id"), "key", "is_original").agg(F.max("s").alias("own_"))
    common = rows.where("owner IS NULL").groupBy("key", "is_original").agg(F.max("s").alias("common_"))
    cand, item = F.col("cand_id").cast("string"), F.col("item_id").cast("string")
    keyed = chosen.withColumns({"c_": cand, "i_": item})
    negative = own.where("NOT is_original").select(F.col("item_id").cast("string").alias("i_"), F.col("key").alias("c_"), "own_")
    found = keyed.join(negative, ["i_", "c_"], "left").join(common.where("NOT is_original").select(F.col("key").alias("c_"), "common_"), "c_", "left")
    found = found.withColumn("s_", F.coalesce("own_", "common_")).drop("own_", "common_")
    originals = own.where("is_original").groupBy(F.col("item_id").cast("string").alias("i_")).agg(F.max("own_").alias("own_"))
    shared = common.where("is_original").agg(F.max("common_").alias("common_"))  # one row
    found = found.join(originals, "i_", "left").join(F.broadcast(shared))
    pos = F.coalesce(F.col("own_.score"), F.col("common_.score"), F.lit(1.0))
    kept = [c for c in chosen.columns]
    return found.select(*kept, pos.alias("pos_score"), F.coalesce(F.col("s_.score"), F.lit(default).cast("double")).alias("neg_score"), F.coalesce(F.col("s_.weight"), F.lit(1.0)).alias("weight"))


def screen_with_scores(items: DataFrame, pool: DataFrame, scores: DataFrame, strata: Sequence[str], checks: Sequence[tuple[Column, str]], k: int, seed: int, q: float = 0.95, margin: float = 0.05, default: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, pairs): guards, matched negatives, a map of scores, weighted AUC, exact null, gate, verdict and warnings.

    Outcomes have a row for every item: status, reason, n_negatives, n_scored,
    n_missing, auc, gate, slack, verdict and warnings. See :func:`scored_pairs`
    for the map.
    """
    checked = preflight(items, checks)
    chosen = matched_negatives(checked.where("status = 'OK'").select("item_id", *strata), pool.select("cand_id", *strata), strata, k, seed).select("item_id", "cand_id", "turn")
    pairs = written(scored_pairs(chosen, scores, default), "pairs")
    scored = F.col("neg_score").isNotNull()
    counts = pairs.groupBy("item_id").agg(F.count("*").alias("n_negatives"), F.count_if(scored).alias("n_scored"), F.bool_or(scored & (F.col("weight") != 1)).alias("weighted"), F.max("pos_score").alias("p"))
    rows = pairs.where(scored).select("item_id", F.col("neg_score").alias("score"), F.lit(0).alias("label"), "weight")
    rows = rows.unionByName(counts.where("n_scored > 0").select("item_id", F.col("p").alias("score"), F.lit(1).alias("label"), F.lit(1.0).alias("weight")))
    aucs = weighted_auc(rows, ["item_id"])
    audit = audit_verdict(aucs, null_auc_quantile(aucs, q), margin).select("item_id", "auc", "gate", "slack", "verdict")
    out = checked.select("item_id", "status", "reason").join(counts, "item_id", "left").join(audit, "item_id", "left")
    n, s = F.coalesce("n_negatives", F.lit(0)), F.coalesce("n_scored", F.lit(0))
    reason = F.when(F.col("status") != "OK", F.col("reason")).when(n == 0, "no_negatives").when(s == 0, "no_scores").when(F.col("auc").isNull(), "no_auc")
    warnings = F.array_join(audit_warnings(F.coalesce("weighted", F.lit(False)), n - s, s), ",")
    out = out.select("item_id", F.when(reason.isNull(), "OK").otherwise("SKIP").alias("status"), reason.alias("reason"), n.alias("n_negatives"), s.alias("n_scored"), (n - s).alias("n_missing"), "auc", "gate", "slack", "verdict", warnings.alias("warnings"))
    return out, pairs


@step_scope()
def run_screen(spark: SparkSession, items_csv: str, scores_json: str, version: str, out: str, strata: Sequence[str], checks: Sequence[tuple[Column, str]], k: int, seed: int, default: float | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """A screening run: items as CSV and nested scores as JSON to tables below ``out``; returns the manifest.

    The tables are outcomes (CSV), pairs, metrics, missing (the score request
    pack) and, with ``similarity(item_id, cand_id, similarity)``, the hardness
    curve and its verdict. The manifest lists their files with SHA-256 and is
    written last, as ``manifest``. Every item is also a candidate.
    """
    began = time.time()
    items = read_items_csv(spark, items_csv)
    long = read_scores_json(spark, scores_json, version)
    scores = long.select(F.lit(None).cast("string").alias("owner"), F.coalesce("item_id", F.lit("")).alias("key"), "is_original", "score", "weight")
    outcomes, pairs = screen_with_scores(items, items.withColumnRenamed("item_id", "cand_id"), scores, strata, checks, k, seed, default=default)
    outcomes = written(outcomes, "outcomes")
    write_result(outcomes, f"{out}/outcomes", "csv")
    write_result(pairs, f"{out}/pairs")
    missing = pairs.where("neg_score IS NULL").withColumn("key", F.col("cand_id"))
    write_result(score_request_pack(missing, "item_id", "cand_id", "key"), f"{out}/missing", "csv")
    if similarity is not None:
        curve = written(hardness_curve(pairs.join(similarity, ["item_id", "cand_id"], "left")), "curve")
        write_result(curve, f"{out}/hardness", "csv")
        write_result(interpret_hardness(curve), f"{out}/hardness_verdict", "csv")
    counts = outcomes.agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "OK").alias("n_ok"), F.sum("n_missing").alias("n_missing"))
    seconds = F.lit(time.time() - began)
    metrics = counts.join(F.broadcast(slack_stats(outcomes).drop("n_ok"))).withColumns({"seconds": seconds, "items_per_second": F.col("n_items") / seconds})
    write_result(metrics, f"{out}/metrics", "csv")
    manifest = file_manifest(spark, out).where("NOT startswith(path, 'manifest/')")
    write_result(written(manifest, "manifest"), f"{out}/manifest", "csv")
    return spark.read.option("header", True).csv(f"{out}/manifest")


@step_scope()
def run_ranking(spark: SparkSession, rows_csv: str, out: str, group: str, key: str, pred: str, truth: str, least: Mapping[str, float], worst: int = 10) -> DataFrame:
    """A grouped-rank evaluation: CSV rows to tables below ``out``; returns the report with its verdict.

    Groups may be of any size. The tables are metrics (a row per group), report
    and worst (the groups of lowest correlation), all as CSV.
    """
    rows = read_items_csv(spark, rows_csv).select(group, key, *(F.col(c).try_cast("double").alias(c) for c in (pred, truth)))
    metrics = written(ranking.group_metrics(rows, group, key, pred, truth), "metrics")
    write_result(metrics, f"{out}/metrics", "csv")
    write_result(worst_groups(metrics, worst, "rho", group), f"{out}/worst", "csv")
    write_result(ranking.kpi_gate(ranking.rank_report(metrics), least), f"{out}/report", "csv")
    return spark.read.option("header", True).csv(f"{out}/report", inferSchema=True)
