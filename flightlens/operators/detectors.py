"""Scores of detectors and check suites against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detector_quality(found: DataFrame, keys: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """Precision, recall, F1 and accuracy per key of 0/1 columns; undefined ratios are 0."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    counted = found.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*keys).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    ratio = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(*keys, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def suite_score(checks: DataFrame) -> DataFrame:
    """Per suite, and over all suites where suite is null: checks run and passed, percentage, whether all passed."""
    passed = F.count_if("passed")
    per = checks.rollup("suite").agg(F.count("*").alias("checks"), passed.alias("passed"), F.round(passed / F.count("*") * 100.0, 1).alias("score_pct"), F.bool_and("passed").alias("all_passed"))
    return per


def suites_overview(checks: DataFrame) -> DataFrame:
    """One row over all suites: suites run and passed, and the mean of their scores; a suite without a name is one."""
    per = checks.groupBy("suite").agg(F.round(F.count_if("passed") / F.count("*") * 100.0, 1).alias("score_pct"), F.bool_and("passed").alias("all_passed"))
    return per.agg(F.count("*").alias("suites"), F.count_if("all_passed").alias("suites_passed"), F.round(F.coalesce(F.avg("score_pct"), F.lit(0.0)), 1).alias("mean_score_pct"))


def kinds_found(anomalies: DataFrame) -> DataFrame:
    """Per case the different severities and types."""
    return anomalies.groupBy("case_id").agg(F.array_sort(F.collect_set("severity")).alias("severities"), F.array_sort(F.collect_set("anomaly_type")).alias("types"))
