"""Feedback joined to detections, confusion counts and the decisions that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.metrics import accuracy, f1, precision, ratio, recall
from flowlens.operators.scale import salted_join

# Identity fields that are not features.
NOT_FEATURES = ["session_id", "protocol", "timestamp", "src_ip", "dst_ip"]


def attach(feedback: DataFrame, detections: DataFrame, feedback_id: str = "feedback_id") -> tuple[DataFrame, DataFrame]:
    """Feedback with its detection, and the feedback without one.

    One anomaly may collect any share of the feedback, so the join is salted.
    """
    joined = salted_join(feedback, detections.withColumn("__hit", F.lit(True)), ["anomaly_id"], feedback_id, "left")
    found = joined.where("__hit").drop("__hit")
    return found, joined.where("__hit IS NULL").select(*feedback.columns)


def outcome() -> Column:
    """tp, fp, tn or fn of a judged detection: a wrong verdict turns the prediction around."""
    predicted, correct = F.coalesce("is_anomaly", F.lit(False)), F.col("is_correct")
    return (
        F.when(predicted & correct, "tp").when(predicted, "fp").when(correct, "tn").otherwise("fn")
    )


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "tn", "fn")]


def protocol_counts(judged: DataFrame) -> DataFrame:
    rows = judged.withColumn("protocol", F.coalesce(F.col("protocol").cast("string"), F.lit("unknown")))
    return rows.withColumn("outcome", outcome()).groupBy("protocol").agg(*_counts())


def feature_counts(judged: DataFrame) -> DataFrame:
    """Every feature present in the map of a judged detection counts once."""
    named = judged.select(outcome().alias("outcome"), F.explode(F.map_keys("features")).alias("feature"))
    return named.where(~F.col("feature").isin(NOT_FEATURES)).groupBy("feature").agg(*_counts())


def _total() -> Column:
    return F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")


def feature_metrics(judged: DataFrame) -> DataFrame:
    fpr = ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    return feature_counts(judged).select(
        "feature", "tp", "fp", "tn", "fn", precision().alias("precision"), recall().alias("recall"),
        f1().alias("f1"), fpr.alias("fpr"), _total().alias("total"),
    )


def low_features(metrics: DataFrame, threshold: float = 0.5, more_than: int = 10) -> DataFrame:
    return metrics.where((F.col("f1") < threshold) & (F.col("total") > more_than))


def protocol_metrics(judged: DataFrame) -> DataFrame:
    return protocol_counts(judged).select(
        "protocol", "tp", "fp", "tn", "fn", precision().alias("precision"), recall().alias("recall"),
        f1().alias("f1"), accuracy().alias("accuracy"), _total().alias("total"),
    )


def overall_metrics(judged: DataFrame) -> DataFrame:
    """Per protocol and for all protocols together (protocol ``all``)."""
    rolled = protocol_counts(judged).rollup("protocol").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")], F.grouping("protocol").alias("g")
    )
    return rolled.select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("protocol")).alias("protocol"),
        "tp", "fp", "tn", "fn", precision().alias("precision"), recall().alias("recall"),
        f1().alias("f1"), accuracy().alias("accuracy"),
    )


def switch_by_performance(metrics: DataFrame, disabled: list[str]) -> DataFrame:
    """Disable on a high false-positive rate, enable a disabled feature that does well."""
    off = (F.col("fpr") > 0.8) & (F.col("total") > 50)
    on = (F.col("fpr") < 0.2) & (F.col("f1") > 0.7) & F.col("feature").isin(disabled)
    return metrics.withColumn("decision", F.when(off, "disable").when(on, "enable").otherwise("keep"))


def switch_by_importance(importances: DataFrame, disabled: list[str]) -> DataFrame:
    is_off = F.col("feature").isin(disabled)
    off = (F.col("importance") < 0.001) & ~is_off
    on = (F.col("importance") > 0.05) & is_off
    return importances.withColumn("decision", F.when(off, "disable").when(on, "enable").otherwise("keep"))


def latest_feedback(feedback: DataFrame, days: int = 10, per_day: int = 5) -> DataFrame:
    """The last entries of each of the newest days."""
    newest = feedback.select("dt").distinct().orderBy(F.desc("dt")).limit(days)
    last = Window.partitionBy("dt").orderBy(F.desc("ts_us"), F.desc("feedback_id"))
    ranked = feedback.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= per_day)
    return ranked.join(newest, "dt", "left_semi")
