"""Time-partitioned storage, reports, feedback files and the model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from flowlens.functions.scalars import timestamp_text
from flowlens.operators.alerts import with_anomaly_id
from flowlens.operators.prep import clean

DAY_US = 86_400_000_000


def read_data(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet by extension; a directory is read as Parquet unless it ends in ``.csv``."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", "true").csv(path)
    return reader.parquet(path)


def read_csv_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files below a directory as one table."""
    return (
        spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").csv(path)
    )


def training_directory(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[str]]:
    """All CSV files of a directory as cleaned numbers with ``label`` and ``protocol_label``, and the names of the features.

    Columns that are no numbers are dropped, a value that is none becomes NULL. The protocol comes from
    ``protocol``, else from ``protocol_num``, else it is NULL.
    """
    rows = clean(read_csv_directory(spark, path, schema))
    if "label" not in rows.columns:
        raise ValueError("training data needs a label column")
    names = [c for c in rows.columns if c != "label"]
    source = next((c for c in ("protocol", "protocol_num") if c in names), None)
    protocol = F.col(source).cast("int") if source else F.lit(None).cast("int")
    numbers = [F.col(c).cast("double").alias(c) for c in names]
    return rows.select(*numbers, "label", protocol.alias("protocol_label")), names


def month_of(ts_us: str | Column) -> Column:
    return timestamp_text(ts_us, "yyyyMM")


def write_partitioned(df: DataFrame, path: str, ts: str = "ts_us", fmt: str = "parquet", mode: str = "append") -> None:
    """Appends rows under their month (``ym``).

    Rows are spread by range of time, so a busy month takes as many tasks as it needs and
    every file covers a short span of time, which a range read can skip.
    """
    rows = df.withColumn("ym", month_of(ts)).repartitionByRange("ym", ts)
    rows.write.mode(mode).partitionBy("ym").format(fmt).save(path)


def load_range(
    spark: SparkSession, path: str, start_us: int, end_us: int, ts: str = "ts_us", fmt: str = "parquet"
) -> DataFrame:
    """Rows of a closed time range. Month bounds follow from it, so partitions are pruned."""
    months = spark.range(1).select(month_of(F.lit(start_us)).alias("a"), month_of(F.lit(end_us)).alias("b")).first()
    # The partition column keeps its text form, and text order is month order.
    rows = spark.read.format(fmt).option("basePath", path).load(path).withColumn("ym", F.col("ym").cast("string"))
    return rows.where(F.col("ym").between(months["a"], months["b"]) & F.col(ts).between(start_us, end_us))


def count_since(df: DataFrame, since_us: int, protocol: int | None = None, ts: str = "ts_us") -> DataFrame:
    rows = df.where(F.col(ts) > since_us)
    if protocol is not None:
        rows = rows.where(F.col("protocol") == protocol)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def save_test_data(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    path = f"{base}/test_data.{fmt}"
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def load_test_data(spark: SparkSession, bases: Sequence[str], schema: str, formats=("parquet", "csv")) -> DataFrame:
    """The first test table found, trying every format in every directory."""
    for base in bases:
        for fmt in formats:
            try:
                return read_data(spark, f"{base}/test_data.{fmt}", schema)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
    raise FileNotFoundError(f"no test data in {list(bases)}")


def retained(df: DataFrame, now_us: int, days: int) -> DataFrame:
    """Rows whose month is not wholly older than the retention; drops whole months only."""
    return df.where(F.col("ym").cast("string") >= month_of(F.lit(now_us - days * DAY_US)))


def expired_months(df: DataFrame, now_us: int, days: int) -> DataFrame:
    return df.select("ym").distinct().where(F.col("ym").cast("string") < month_of(F.lit(now_us - days * DAY_US)))


def retained_days(df: DataFrame, now_us: int, days: int, dt: str = "dt") -> DataFrame:
    """Rows of day partitions (``yyyyMMdd``) inside the retention."""
    return df.where(F.col(dt).cast("string") >= timestamp_text(F.lit(now_us - days * DAY_US), "yyyyMMdd"))


def format_size(size: str | Column) -> Column:
    """Bytes as text with two decimals and a unit up to TB."""
    s = (F.col(size) if isinstance(size, str) else size).cast("double")
    # Ties go to the even digit, which bround does and the Java format does not.
    text = lambda power, unit: F.format_string(f"%.2f {unit}", F.bround(s / 1024.0**power, 2))
    out = text(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(s < 1024.0 ** (power + 1), text(power, unit)).otherwise(out)
    return out


def storage_stats(spark: SparkSession, areas: Mapping[str, str]) -> DataFrame:
    """Files and bytes per area and in total; only the listing is read."""
    parts = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.lit(area).alias("area"), "length")
        for area, path in areas.items()
    ]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    stats = files.rollup("area").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"),
        F.grouping("area").alias("g"),
    )
    return stats.select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("area")).alias("area"),
        "file_count", "size_bytes", format_size("size_bytes").alias("size_human"),
    )


def append_detections(df: DataFrame, path: str) -> None:
    valid = df.where(F.col("session_id").isNotNull() & F.col("ts_us").isNotNull())
    valid.withColumn("dt", timestamp_text("ts_us", "yyyyMMdd")).write.mode("append").partitionBy("dt").parquet(path)


def latest_rows(df: DataFrame, n: int = 10_000, ts: str = "ts_us", tie: str = "session_id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def write_reports(detections: DataFrame, features: Sequence[str], path: str) -> None:
    """One JSON row per anomaly under its day: the detection and its feature map."""
    rows = with_anomaly_id(detections).where("is_anomaly")
    info = F.struct(*[c for c in rows.columns if c not in features])
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    rows.select(
        timestamp_text("ts_us", "yyyyMMdd").alias("dt"), info.alias("anomaly_info"),
        F.create_map(*pairs).alias("features"),
    ).write.mode("append").partitionBy("dt").json(path)


def recent_reports(reports: DataFrame, now_us: int, hours: int = 24, limit: int = 100) -> DataFrame:
    """Newest reports of the last hours; the day partitions are pruned first."""
    since = now_us - hours * 3_600_000_000
    days = reports.where(F.col("dt").cast("string") >= timestamp_text(F.lit(since), "yyyyMMdd"))
    ts = F.col("anomaly_info.ts_us")
    return days.where((ts >= since) & (ts <= now_us)).orderBy(ts.desc(), F.desc("anomaly_info.anomaly_id")).limit(limit)


def write_feedback(feedback: DataFrame, path: str) -> None:
    day = timestamp_text((F.col("timestamp") * 1e6).cast("bigint"), "yyyyMMdd")
    feedback.withColumn("dt", day).write.mode("append").partitionBy("dt").json(path)


def read_feedback(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Feedback rows, and the texts that are not valid JSON or lack a required field."""
    rows = (
        spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )
    whole = F.col("anomaly_id").isNotNull() & F.col("is_correct").isNotNull() & F.col("_corrupt").isNull()
    good = rows.where(whole).drop("_corrupt")
    bad = rows.where(~whole).select(
        F.coalesce("_corrupt", F.to_json(F.struct("anomaly_id", "session_id", "timestamp"))).alias("record")
    )
    return good, bad


def pcap_to_tables(spark: SparkSession, path: str, out: str, cfg=None, windows=None) -> None:
    """Writes the features of all sessions in the pcap files under a path: all 52 and the 15 of the models.

    The files are read and decoded once, into ``packets``. Sessions with any non-zero feature are kept, with label 0.
    """
    from flowlens.config import SessionConfig, WindowConfig
    from flowlens.operators.temporal import flow_features
    from flowlens.schemas import ALL_FEATURES, MODEL_FEATURES
    from flowlens.sources.pcap import pcap_packets

    pcap_packets(spark, path).write.mode("overwrite").parquet(f"{out}/packets")
    rows = flow_features(spark.read.parquet(f"{out}/packets"), cfg or SessionConfig(), windows or WindowConfig())
    kept = rows.where(F.greatest(*[F.abs(F.col(c)) for c in ALL_FEATURES]) > 0)
    kept.select(*ALL_FEATURES, F.lit(0).alias("label")).write.mode("overwrite").parquet(f"{out}/features")
    full = spark.read.parquet(f"{out}/features")
    full.select(*MODEL_FEATURES, "label").write.mode("overwrite").option("header", "true").csv(f"{out}/model.csv")


def newest_report(metrics: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return metrics.where(F.col("ts_us").between(start_us, end_us)).orderBy(F.desc("ts_us"), "model_type").limit(1)


def latest_models(registry: DataFrame) -> DataFrame:
    """Path of the newest version of each model type that was not deleted."""
    live = registry if "deleted" not in registry.columns else registry.where(~F.coalesce("deleted", F.lit(False)))
    return live.groupBy("model_type").agg(
        F.max_by("path", F.struct("ts_us", "version")).alias("path"),
        F.max_by("version", F.struct("ts_us", "version")).alias("version"),
    )


def list_models(registry: DataFrame, model_type: str | None = None) -> DataFrame:
    rows = registry if model_type is None else registry.where(F.col("model_type") == model_type)
    return rows.orderBy(F.desc("ts_us"), F.desc("version"))


def delete_version(registry: DataFrame, model_type: str, version: int) -> DataFrame:
    hit = (F.col("model_type") == model_type) & (F.col("version") == version)
    return registry.where(~hit)


def save_model(model, path: str, registry_path: str, model_type: str, version: int, f1: float, ts_us: int) -> None:
    """Writes a fitted pipeline and appends its registry row."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(
        F.lit(model_type).alias("model_type"), F.lit(version).alias("version"), F.lit(path).alias("path"),
        F.lit(float(f1)).alias("f1"), F.lit(ts_us).cast("bigint").alias("ts_us"),
    )
    row.write.mode("append").parquet(registry_path)


def load_latest_model(spark: SparkSession, registry_path: str, model_type: str):
    from pyspark.ml import PipelineModel

    row = latest_models(spark.read.parquet(registry_path)).where(F.col("model_type") == model_type).first()
    if row is None:
        raise LookupError(f"no model of type {model_type}")
    return PipelineModel.load(row["path"])
