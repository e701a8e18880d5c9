"""Structured Streaming forms of the session, window, detection and alert operators."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.config import AlertConfig, DetectionConfig
from flowlens.functions.entropy import blocks_of_bytes
from flowlens.functions.scalars import has_flag, protocol_name
from flowlens.functions.specs import ACK, FIN, RST, SYN
from flowlens.operators.detect import detect
from flowlens.operators.feedback import outcome
from flowlens.operators.sessions import session_key, stable_id
from flowlens.operators.stat import pop_std


def packet_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 100, glob: str | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("event_time", F.timestamp_micros("ts_us"))


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def stream_sessions(packets: DataFrame, timeout: str = "300 seconds", delay: str = "10 minutes", mode: str = "compat") -> DataFrame:
    """Closed sessions in append mode: a session is emitted when the watermark passes its end plus the timeout.

    Sessions of one key are merged inside each map task before the shuffle if the session sets
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition, which keeps a flooded key small.
    """
    length = F.col("length").cast("bigint")
    tcp, flags = F.col("protocol") == 6, F.col("flags")
    keyed = with_event_time(packets).withWatermark("event_time", delay).withColumn("session_key", session_key(mode))
    return keyed.groupBy("session_key", F.session_window("event_time", timeout).alias("w")).agg(
        F.min("protocol").alias("protocol"),
        F.count(F.lit(1)).alias("total_packets"), F.sum(length).alias("total_bytes"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.min(length).alias("min_len"), F.max(length).alias("max_len"),
        F.avg(length).alias("avg_packet_size"), F.stddev_pop(length).alias("std_packet_size"),
        _count(tcp & has_flag(flags, SYN)).alias("tcp_syn_count"), _count(tcp & has_flag(flags, ACK)).alias("tcp_ack_count"),
        _count(tcp & has_flag(flags, FIN)).alias("tcp_fin_count"), _count(tcp & has_flag(flags, RST)).alias("tcp_rst_count"),
    ).select(
        stable_id().alias("session_id"),
        "session_key", protocol_name("protocol").alias("protocol_name"), "protocol", "total_packets", "total_bytes",
        "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"),
        F.col("total_packets").cast("double").alias("packet_count"), "avg_packet_size", "std_packet_size",
        "tcp_syn_count", "tcp_ack_count", "tcp_fin_count", "tcp_rst_count",
    )


CONTROL = "\0control"  # the key of the rows that only move the watermark
COUNTED = ("n", "bytes", "sumsq", "syn", "ack", "fin", "rst")
FOLDED = (
    "session_key string, protocol int, first_us long, last_us long, min_len long, max_len long, "
    + ", ".join(f"{c} long" for c in COUNTED) + ", bins array<long>"
)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets of one key and time slice become one row with their moments and counts of payload bytes."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).drop_columns(["payload"]).append_column("__i", pa.array(np.arange(batch.num_rows)))
        sums = [(c, "sum") for c in COUNTED]
        told = table.group_by(["session_key", "slice"], use_threads=False).aggregate([
            ("protocol", "min"), ("ts_us", "min"), ("ts_us", "max"), ("length", "min"), ("length", "max"), *sums, ("__i", "list"),
        ])
        lists = told["__i_list"].combine_chunks()
        code = np.empty(batch.num_rows, np.int64)
        code[lists.flatten().to_numpy()] = np.repeat(np.arange(told.num_rows), np.diff(lists.offsets.to_numpy()))
        bins = np.zeros(told.num_rows * 256, np.int64)
        for lo, sizes, data in blocks_of_bytes(batch.column("payload").to_pylist()):
            cells, counts = np.unique(np.repeat(code[lo : lo + len(sizes)], sizes) * 256 + data, return_counts=True)
            bins[cells] += counts
        names = [f.split()[0] for f in FOLDED.split(", ")]
        sources = ["session_key", "protocol_min", "ts_us_min", "ts_us_max", "length_min", "length_max", *[f"{c}_sum" for c in COUNTED]]
        columns = [told[c].combine_chunks() for c in sources]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(told.num_rows + 1, dtype=np.int32) * 256), pa.array(bins))], names=names)


def stream_flows(
    packets: DataFrame, timeout_us: int = 300_000_000, delay: str = "10 minutes", mode: str = "compat",
    control: DataFrame | None = None, slice_us: int | None = None,
) -> DataFrame:
    """Closed sessions with all that the rules need, payload entropy included; they are those of the batch operators.

    Packets of a key and slice are folded before they are shuffled. The window of such a row lasts from its first packet
    to the timeout after its last one; Spark merges windows that overlap or touch, adding up moments and the 256 counts of
    payload bytes, so the state of a session has a fixed width however long it lasts. ``control`` is
    a stream of rows with ``ts_us`` that hold no packet and only move the watermark: ``close_open`` writes
    one at the end of a feed, and every session still open is emitted.
    """
    length = F.coalesce(F.col("length"), F.lit(0)).cast("bigint")
    tcp, flags = F.col("protocol") == 6, F.col("flags")
    flag = lambda mask: F.when(tcp & has_flag(flags, mask), 1).otherwise(0).cast("bigint")
    width = slice_us or max(1, timeout_us // 30)
    rows = packets.where("protocol IS NOT NULL AND ts_us IS NOT NULL").select(
        session_key(mode).alias("session_key"), F.expr(f"(ts_us - pmod(ts_us, {width})) DIV {width}").alias("slice"), "ts_us", F.col("protocol").cast("int").alias("protocol"),
        length.alias("length"), F.lit(1).cast("bigint").alias("n"), length.alias("bytes"), (length * length).alias("sumsq"),
        flag(SYN).alias("syn"), flag(ACK).alias("ack"), flag(FIN).alias("fin"), flag(RST).alias("rst"), F.col("payload").cast("binary").alias("payload"),
    )
    folded = rows.mapInArrow(fold, FOLDED)
    if control is not None:
        nothing = {"session_key": F.lit(CONTROL), "first_us": F.col("ts_us"), "last_us": F.col("ts_us")}
        typed = [f.split(" ", 1) for f in FOLDED.split(", ")]
        folded = folded.unionByName(control.select(*[nothing.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in typed]))
    lasting = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, CAST((last_us - first_us + {timeout_us}) / 1000000 AS DECIMAL(18, 6)))")
    timed = folded.withColumn("event_time", F.timestamp_micros("first_us")).withWatermark("event_time", delay)
    total = lambda c: F.sum(c).alias(c)
    merged = timed.groupBy("session_key", F.session_window("event_time", lasting).alias("w")).agg(
        F.min("protocol").alias("protocol"), F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"),
        F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), *[total(c) for c in COUNTED],
        *[F.sum(F.col("bins")[i]).alias(f"b{i}") for i in range(256)],
    ).where(F.col("n") > 0)  # a condition on the key would drop control rows before they move the watermark
    symbols = F.array(*[F.col(f"b{i}") for i in range(256)])
    size = F.aggregate("symbols", F.lit(0).cast("bigint"), lambda a, c: a + c)
    spread = F.aggregate("symbols", F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    entropy = F.when(size > 0, F.greatest(F.log2(size.cast("double")) - spread / size, F.lit(0.0))).otherwise(0.0)
    return merged.withColumn("symbols", symbols).select(
        stable_id().alias("session_id"), "session_key", protocol_name("protocol").alias("protocol_name"), "protocol",
        F.col("n").alias("total_packets"), F.col("bytes").alias("total_bytes"), "start_us", "end_us",
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration"), F.col("n").cast("double").alias("packet_count"),
        (F.col("bytes") / F.col("n")).alias("avg_packet_size"), pop_std(F.col("n"), F.col("bytes"), F.col("sumsq")).alias("std_packet_size"),
        *[F.col(c).alias(f"tcp_{c}_count") for c in ("syn", "ack", "fin", "rst")], entropy.alias("payload_entropy"),
    )


def control_stream(spark: SparkSession, path: str) -> DataFrame:
    """The control rows under ``path``, which is made if it is new."""
    spark.createDataFrame([], "ts_us long").write.mode("append").parquet(path)
    return spark.readStream.schema("ts_us long").parquet(path)


def close_open(spark: SparkSession, path: str, at_us: int) -> None:
    """Tells the stream that reads ``path`` that its feed has ended before ``at_us``: its next run emits what is open."""
    spark.range(1).select(F.lit(at_us).cast("bigint").alias("ts_us")).write.mode("append").parquet(path)


def stream_windows(packets: DataFrame, size: str, step: str | None = None, delay: str = "10 minutes", key: str = "src_ip") -> DataFrame:
    """Tumbling (no step) or sliding window measures per key."""
    length = F.col("length").cast("bigint")
    window = F.window("event_time", size, step) if step else F.window("event_time", size)
    grouped = with_event_time(packets).withWatermark("event_time", delay).groupBy(key, window.alias("w"))
    return grouped.agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum(length).alias("byte_count"),
        F.size(F.collect_set("dst_port")).cast("bigint").alias("unique_dest_ports"),  # at most 65,536 numbers
        _count((F.col("protocol") == 6) & has_flag(F.col("flags"), SYN)).alias("syn_count"),
    ).select(key, F.unix_micros("w.start").alias("window_start_us"), "packet_count", "byte_count", "unique_dest_ports", "syn_count")


def stream_detections(sessions: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The batch decision applied to streamed sessions (those of ``stream_flows``); stateless."""
    return detect(sessions, cfg)


def stream_throttle(alerts: DataFrame, interval_us: int = AlertConfig().interval_us) -> DataFrame:
    """Sent alerts (append): one goes out iff ``interval_us`` passed since the last one sent of its type.

    The state of a type is the time of its last sent alert. Of alerts with one time the lowest id is sent;
    alerts of a micro-batch are taken in the order of time, and those that arrive behind the last sent one of
    their type, like those without type or time, are silenced.
    """

    def send(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Of each part one row per time is kept, so what is held is bounded by the trigger.
        rows = pd.concat([p.groupby("ts_us", as_index=False)["anomaly_id"].min() for p in parts]).groupby("ts_us")["anomaly_id"].min()
        times, ids = rows.index.to_numpy(), rows.to_numpy()
        at = int(np.searchsorted(times, state.get[0] + interval_us)) if state.exists else 0
        sent = []
        while at < len(times):
            sent.append(at)
            at = int(np.searchsorted(times, times[at] + interval_us))
        if sent:
            state.update((int(times[sent[-1]]),))
        yield pd.DataFrame({"anomaly_type": [key[0]] * len(sent), "ts_us": times[sent], "anomaly_id": ids[sent]})

    known = alerts.where("anomaly_type IS NOT NULL AND ts_us IS NOT NULL").select("anomaly_type", "ts_us", "anomaly_id")
    return known.groupBy("anomaly_type").applyInPandasWithState(
        send, "anomaly_type string, ts_us long, anomaly_id string", "last_us long", "append", GroupStateTimeout.NoTimeout
    )


def stream_rates(samples: DataFrame, key: str, counters: Sequence[str], order: str = "sample_id") -> DataFrame:
    """Per-second rate of each counter against the key's sample before (append): (key, order, ts_us, rates).

    The state of a key is its last sample, by time and ``order``. The first sample of a key has null rates, as
    has one that arrives behind the last: it is passed on, but nothing is measured from it. A time step of 0
    counts as 0.1 s. Keys and times that are null are left out; a null counter gives null rates.
    """
    fields = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    names = [f"{c}_rate" for c in counters]

    def rate(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts_us", order], kind="stable", ignore_index=True)
        place = list(zip(rows["ts_us"], rows[order]))
        last = tuple(state.get[:2]) if state.exists else None
        late = sum(p <= last for p in place) if last else 0
        held = pd.DataFrame([state.get], columns=["ts_us", order, *counters]) if state.exists else rows.iloc[:0][["ts_us", order, *counters]]
        chain = pd.concat([held, rows.iloc[late:][["ts_us", order, *counters]]], ignore_index=True) if len(held) else rows.iloc[late:][["ts_us", order, *counters]]
        step = chain["ts_us"].diff() / 1e6
        step = step.where(step > 0, 0.1)
        out = rows[[order, "ts_us"]].copy()
        for c, name in zip(counters, names):
            change = (pd.to_numeric(chain[c]).astype("float64").diff() / step).to_numpy()[len(held):]
            out[name] = np.concatenate([np.full(late, np.nan), change])
        if late < len(rows):
            end = rows.iloc[-1]
            state.update((int(end["ts_us"]), int(end[order]), *[None if pd.isna(end[c]) else float(end[c]) for c in counters]))
        out.insert(0, key, group[0])
        yield out[[key, order, "ts_us", *names]]

    out = f"`{key}` {fields[key]}, `{order}` long, ts_us long, " + ", ".join(f"`{n}` double" for n in names)
    state = "ts_us long, place long, " + ", ".join(f"`{c}` double" for c in counters)
    known = samples.where(F.col(key).isNotNull() & F.col("ts_us").isNotNull()).select(
        key, F.col(order).cast("long").alias(order), "ts_us", *[F.col(c).cast("double").alias(c) for c in counters]
    )
    rated = known.groupBy(key).applyInPandasWithState(rate, out, state, "append", GroupStateTimeout.NoTimeout)
    return rated.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def run_counters(counters: DataFrame, path: str, checkpoint: str) -> None:
    """Running counters as they stand: a few rows, written anew after each batch from Spark's own state."""
    query = (
        counters.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_feedback_counts(judged: DataFrame, delay: str = "1 hour", event_time: str = "event_time") -> DataFrame:
    """Running confusion counts per protocol; a repeated verdict on an anomaly counts once."""
    once = judged.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["anomaly_id"])
    counted = once.withColumn("outcome", outcome()).groupBy("protocol")
    return counted.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "tn", "fn")])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes everything available and stops. The file sink and checkpoint make it exactly-once."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


class LateRows(StreamingQueryListener):
    """Counts rows that arrived behind the watermark, per query and over all of its batches.

    What an aggregation drops is counted after its rows were combined, so late rows of one group and batch
    count once there; a query that drops duplicates counts each row.

    Add it with ``spark.streams.addListener`` before the query starts. A query itself remembers only its
    last batches. ``count`` waits until the end of the query has been reported.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event):
        self.dropped.setdefault(str(event.id), 0)
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event):
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def count(self, query, timeout: float = 60.0) -> int:
        """Late rows of a finished query."""
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(timeout):
            raise TimeoutError("the end of the query has not been reported")
        return self.dropped.get(str(query.id), 0)
