"""Model selection and retraining decisions: metric tables in, decision rows out.

All tables hold one row per training run or model, not per packet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import RetrainConfig
from flowlens.functions.scalars import spec_row

CFG = RetrainConfig()


def new_data_trigger(rows: DataFrame, since_us: int, minimum: int = CFG.min_samples) -> DataFrame:
    """New rows per protocol and for all together (``general``), and whether they suffice to train."""
    fresh = rows.where((F.col("ts_us") > since_us) & F.col("protocol").isNotNull())
    counted = fresh.rollup("protocol").agg(F.count(F.lit(1)).alias("n"), F.grouping("protocol").alias("g"))
    return counted.select(
        F.when(F.col("g") == 1, "general").otherwise(F.col("protocol").cast("string")).alias("scope"),
        "n", (F.col("n") >= minimum).alias("train"),
    )


def training_window(rows: DataFrame, now_us: int, days: int = CFG.max_history_days) -> DataFrame:
    return rows.where(F.col("ts_us").between(now_us - days * 86_400_000_000, now_us))


def latest_performance(history: DataFrame) -> DataFrame:
    """Newest record per protocol and model; the protocol name is lower-cased, empty is ``unknown``."""
    name = F.lower(F.coalesce(F.nullif(F.trim("protocol"), F.lit("")), F.lit("unknown")))
    w = Window.partitionBy("protocol", "model_type").orderBy(F.desc("ts_us"))
    return history.withColumn("protocol", name).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def select_models(protocols: DataFrame, history: DataFrame) -> DataFrame:
    """Best candidate per protocol by f1 * min(n / 1000, 1); the first one wins ties.

    ``protocols`` has one row per protocol number and ``history`` the latest record per
    protocol name and model. A score under 0.1 falls back to the first preference.
    """
    wanted = protocols.select(
        F.col("protocol").alias("number"), spec_row("protocol", "name").alias("protocol"),
        F.posexplode(spec_row("protocol", "model_preference")).alias("pos", "model_type"),
    )
    score = F.col("f1") * F.least(F.coalesce("sample_count", F.lit(0)) / 1000, F.lit(1.0))
    scored = wanted.join(history.select("protocol", "model_type", "f1", "sample_count"), ["protocol", "model_type"], "left")
    best = scored.withColumn("score", score).groupBy("number", "protocol").agg(
        F.max(F.when(F.col("score").isNotNull(), F.struct("score", -F.col("pos"), "model_type"))).alias("b"),
        F.min(F.struct("pos", "model_type")).alias("first"),
    )
    good = F.coalesce(F.col("b.score") >= 0.1, F.lit(False))
    return best.select(
        "number", "protocol", F.when(good, F.col("b.model_type")).otherwise(F.col("first.model_type")).alias("model_type"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"),
    )


def full_retrain(increments: DataFrame, now_us: int, cfg: RetrainConfig = CFG) -> DataFrame:
    """Full retrain per protocol and model: the interval is over, or two of its last three drops are large.

    Runs of a model that is not kept per protocol have no protocol column.
    """
    keys = [k for k in ("protocol", "model_type") if k in increments.columns]
    w = Window.partitionBy(*keys).orderBy(F.desc("ts_us"))
    recent = increments.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    state = recent.groupBy(*keys).agg(
        F.count_if(F.col("performance_drop") > cfg.drop_threshold).alias("large_drops"),
        F.max("last_full_us").alias("last_full_us"),
    )
    overdue = now_us - F.col("last_full_us") >= cfg.retrain_full_interval_s * 1_000_000
    return state.withColumn("retrain", (F.col("large_drops") >= 2) | F.coalesce(overdue, F.lit(False)))


def performance_drops(increments: DataFrame, limit: float = CFG.drop_threshold) -> DataFrame:
    drop = F.col("initial_f1") - F.col("final_f1")
    return increments.withColumn("performance_drop", drop).withColumn("dropped", drop > limit)


def importance_summary(importances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Low (<.01) and high (>.1) features and the top five, each list ordered by importance."""
    item = F.struct((-F.col("importance")).alias("o"), F.col("feature").alias("f"))
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["f"])
    low, high = F.col("importance") < 0.01, F.col("importance") > 0.1
    return importances.groupBy(*keys).agg(
        names(F.collect_list(F.when(low, item))).alias("low_features"),
        names(F.collect_list(F.when(high, item))).alias("high_features"),
        F.slice(names(F.collect_list(item)), 1, 5).alias("top_features"),
        F.count(F.lit(1)).alias("features"),
    )


def recommendations(metrics: DataFrame, cfg: RetrainConfig = CFG) -> DataFrame:
    """Changes advised for a model.

    ``metrics`` has model_type, better_model, threshold, f1, precision and recall, and may
    have the lists of ``importance_summary``.
    """
    f1, p, r = F.col("f1"), F.col("precision"), F.col("recall")
    swap = (f1 < cfg.f1_model_change) & F.col("better_model").isNotNull() & (F.col("better_model") != F.col("model_type"))
    ensemble = (f1 < cfg.f1_ensemble) & F.col("model_type").isin("xgboost", "random_forest", "mlp", "lstm")
    step = (
        F.when(p - r > 0.1, F.greatest(F.lit(0.1), F.col("threshold") - 0.05))
        .when(r - p > 0.1, F.least(F.lit(0.9), F.col("threshold") + 0.05))
    )
    out = metrics.withColumns(
        {
            "change_model_to": F.when(swap, F.col("better_model")).when(ensemble, "ensemble"),
            "new_threshold": step,
            "balance": F.when(p - r > 0.1, "conservative").when(r - p > 0.1, "aggressive"),
            "complexity": F.when((f1 < 0.3) & F.col("model_type").isin("mlp", "lstm"), "double_units")
            .when((f1 > 0.7) & (F.col("model_type") == "mlp"), "drop_last_layer"),
        }
    )
    if "low_features" in metrics.columns:
        many = F.size("low_features") > F.col("features") * 0.5
        out = out.withColumns(
            {"keep_features": F.when(many, F.col("top_features")), "remove_features": F.when(many, F.col("low_features"))}
        )
    return out


def low_metrics(metrics: DataFrame, keys: Sequence[str], limit: float = CFG.performance_threshold) -> DataFrame:
    """One row per metric under the limit, marked very low under 70 % of it."""
    long = metrics.unpivot(list(keys), ["f1", "precision", "recall"], "metric", "value")
    return long.where(F.col("value") < limit).withColumn("very_low", F.col("value") < limit * 0.7)


def training_progress(iterations: DataFrame, keys: Sequence[str], cfg: RetrainConfig = CFG) -> DataFrame:
    """Per iteration: retrain wish, stop condition, and whether it is the first stop of its run."""
    w = Window.partitionBy(*keys).orderBy("iteration")
    gain = F.col("f1") - F.lag("f1").over(w)
    stop = (F.col("f1") >= cfg.target_f1) | F.coalesce(gain < cfg.min_gain, F.lit(False))
    marked = iterations.withColumns({"gain": gain, "stop": stop, "retrain": F.col("f1") < cfg.evaluation_threshold})
    earlier = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return marked.withColumn("first_stop", F.col("stop") & ~earlier)


def mcnemar(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic of paired disagreements."""
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c)).otherwise(0.0)


def champion_challenger(pairs: DataFrame, keys: Sequence[str] = (), critical: float = 3.841) -> DataFrame:
    """Promotes the challenger if it is right significantly more often than the champion."""
    champion, challenger = F.col("champion") == F.col("label"), F.col("challenger") == F.col("label")
    counted = pairs.groupBy(*keys).agg(
        F.count_if(champion & ~challenger).alias("champion_only"),
        F.count_if(~champion & challenger).alias("challenger_only"),
    )
    b, c = F.col("champion_only"), F.col("challenger_only")
    stat = mcnemar(b, c)
    return counted.withColumns({"statistic": stat, "promote": (stat > critical) & (c > b)})
