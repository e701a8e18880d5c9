"""Report datasets over detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def in_range(detections: DataFrame, start_us: int, end_us: int, ts: str = "ts_us") -> DataFrame:
    return detections.where(F.col(ts).between(start_us, end_us))


def last_hours(detections: DataFrame, hours: int, now_us: int | None = None, ts: str = "ts_us") -> DataFrame:
    """Rows of the last hours before ``now_us``, or before the newest row."""
    end = F.lit(now_us) if now_us is not None else detections.agg(F.max(ts)).scalar()
    return detections.where((F.col(ts) >= end - hours * HOUR_US) & (F.col(ts) <= end))


def summary(detections: DataFrame, packets: str = "packet_count") -> DataFrame:
    n, hits = F.count(F.lit(1)), F.count_if("is_anomaly")
    return detections.agg(
        F.coalesce(F.sum(packets), F.lit(0)).cast("bigint").alias("total_packets"),
        n.alias("total_sessions"),
        hits.alias("anomalies_detected"),
        F.when(n > 0, 100.0 * hits / n).otherwise(0.0).alias("anomaly_rate"),
    )


def counts_over_time(detections: DataFrame, interval_us: int = HOUR_US) -> DataFrame:
    """Anomalies and normals per interval; empty intervals between the first and last count 0."""
    slot = F.expr(f"(ts_us - pmod(ts_us, {interval_us})) DIV {interval_us}")
    counted = detections.where("ts_us IS NOT NULL").groupBy(slot.alias("slot")).agg(
        F.count_if("is_anomaly").alias("anomalies"), F.count_if(~F.col("is_anomaly")).alias("normals")
    )
    calendar = counted.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("slot")
    )
    return calendar.join(counted, "slot", "left").fillna(0, ["anomalies", "normals"]).select(
        (F.col("slot") * interval_us).alias("interval_start_us"), "anomalies", "normals"
    )


def protocol_distribution(detections: DataFrame) -> DataFrame:
    counted = detections.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.withColumn("percent", 100.0 * F.col("n") / total)


def score_histogram(detections: DataFrame, bins: int = 50, score: str = "anomaly_score") -> DataFrame:
    """Equal-width bins per class over the class's own range; the last bin is closed.

    The range is two values per class, taken as a scalar; rows are then counted in one pass.
    """
    rows = detections.where(F.col(score).isNotNull()).select("is_anomaly", F.col(score).alias("s"))
    pick = lambda flag, fn: fn(F.when(F.col("is_anomaly") == flag, F.col("s")))
    borders = rows.agg(
        F.struct(
            pick(True, F.min).alias("lo_t"), pick(True, F.max).alias("hi_t"),
            pick(False, F.min).alias("lo_f"), pick(False, F.max).alias("hi_f"),
        )
    ).scalar()
    b = F.col("__b")
    side = lambda n: F.when(F.col("is_anomaly"), b[f"{n}_t"]).otherwise(b[f"{n}_f"])
    # A constant class gets a unit range around its value.
    flat = side("lo") == side("hi")
    lo = F.when(flat, side("lo") - 0.5).otherwise(side("lo"))
    hi = F.when(flat, side("hi") + 0.5).otherwise(side("hi"))
    ranged = rows.withColumn("__b", borders).select("is_anomaly", "s", lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("s") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = ranged.groupBy("is_anomaly", index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")
    )
    return counted.select(
        "is_anomaly", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"), "n"
    )


def top_anomalies(detections: DataFrame, n: int = 10) -> DataFrame:
    return detections.where("is_anomaly").orderBy(F.desc("anomaly_score"), "ts_us", "session_id").limit(n)


def top_addresses(detections: DataFrame, n: int = 10) -> DataFrame:
    """Addresses most often found on either side of an anomaly."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")),
            F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")),
        )
    )
    counted = detections.where("is_anomaly").select(sides.alias("x")).groupBy("x.side", "x.ip").agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("side").orderBy(F.desc("n"), "ip")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def severity(score: str | Column, cuts: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Grade of the first cut-off the score reaches; cut-offs are tried from the highest."""
    s = F.col(score) if isinstance(score, str) else score
    ordered = sorted(cuts, key=lambda c: -c[0])
    return F.coalesce(*[F.when(s >= limit, F.lit(name)) for limit, name in ordered], F.lit(lowest))


def evaluation_report(metrics: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The newest metric row of a range with its matrix cells; empty if there is none."""
    rows = metrics.where(F.col("ts_us").between(start_us, end_us))
    newest = rows.orderBy(F.desc("ts_us"), "model_type").limit(1)
    cell = lambda i, j: F.col("confusion")[i][j]
    return newest.select(
        "model_type", "ts_us", "accuracy", "precision", "recall", F.col("f1").alias("f1_score"),
        cell(0, 0).alias("true_negative"), cell(0, 1).alias("false_positive"),
        cell(1, 0).alias("false_negative"), cell(1, 1).alias("true_positive"),
    )
