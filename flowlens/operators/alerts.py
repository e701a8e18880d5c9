"""Alert candidates and the per-type throttle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import AlertConfig


def with_anomaly_id(detections: DataFrame) -> DataFrame:
    """``session_epoch`` in whole seconds."""
    seconds = F.expr("cast(ts_us DIV 1000000 AS string)")
    return detections.withColumn("anomaly_id", F.concat_ws("_", "session_id", seconds))


def alert_candidates(detections: DataFrame, threshold: float = AlertConfig().threshold) -> DataFrame:
    return with_anomaly_id(detections).where(F.col("anomaly_score") >= threshold)


FAN = 16  # intervals in a block, and blocks in a block of the next level
LONG_AGO = -(1 << 62)
LEVELS = 3  # a top block spans 16**4 intervals: 45 days of minutes


def _follow(enter: np.ndarray, leave: np.ndarray, due: np.ndarray, interval: int) -> np.ndarray:
    """The next due time after a block, for each due time before it."""
    at = np.searchsorted(enter, due, side="left")
    return np.where(at < len(enter), leave[np.minimum(at, len(enter) - 1)] + interval, due)


def _compress(enter: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
    """Of entries with the same last alert the latest is kept: lookups ask for the first one not before a time."""
    out = pd.DataFrame({"enter": enter, "leave": leave})
    return out[out["leave"] != out["leave"].shift(-1)]


def _block_summary(times: np.ndarray, start: int, interval: int) -> pd.DataFrame:
    """(enter, leave): the last alert of the block if its first one is ``enter``.

    An alert before the block silences at most its first interval, so only the times in that
    interval, and the first one after it, can be the first alert of the block.
    """
    nxt = np.searchsorted(times, times + interval, side="left")
    jump = np.where(nxt < len(times), nxt, np.arange(len(times)))
    while True:  # doubling: all paths are followed at once
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    entries = min(len(times), int(np.searchsorted(times, start + interval, side="left")) + 1)
    return _compress(times[:entries], times[jump[:entries]])


def _children(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = pdf.sort_values(["block", "enter"])
    return [
        (int(b), part["enter"].to_numpy(), part["leave"].to_numpy())
        for b, part in rows.groupby("block", sort=True)
    ]


def throttle(
    alerts: DataFrame, type_col: str = "anomaly_type", interval_us: int = AlertConfig().interval_us
) -> DataFrame:
    """Sent times (type, ts_us): an alert goes out iff ``interval_us`` passed since the last one sent.

    The rule is sequential per type, so one busy type must not become one task:

    1. alerts of one type and time are one row;
    2. each block of time works out with which alert it ends, for every alert it may begin with;
    3. blocks are merged sixteen at a time, which keeps only the entries of the first of them;
    4. the few top blocks are chained, and the start of every block is handed down again;
    5. each block sends its alerts from its known start.

    A task sees the distinct alert times of sixteen intervals at most, in every step.
    """
    block_us = FAN * interval_us
    times = (
        alerts.where(F.col(type_col).isNotNull() & F.col("ts_us").isNotNull())
        .select(F.col(type_col).alias("type"), "ts_us")
        .groupBy("type", F.expr(f"(ts_us - pmod(ts_us, {block_us})) DIV {block_us}").alias("block"), "ts_us")
        .agg(F.lit(1).alias("one"))
        .drop("one")
    )
    parent = F.expr(f"(block - pmod(block, {FAN})) DIV {FAN}").alias("parent")
    summary_schema = "type string, block bigint, enter bigint, leave bigint"
    due_schema = "type string, block bigint, due bigint"

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _block_summary(np.sort(pdf["ts_us"].to_numpy()), int(key[1]) * block_us, interval_us)
        return out.assign(type=key[0], block=key[1])[["type", "block", "enter", "leave"]]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _children(pdf)
        entries = parts[0][1]
        if len(parts) > 1:
            entries = np.append(entries, parts[1][1][0])
        due = entries
        for _, enter, leave in parts:
            due = _follow(enter, leave, due, interval_us)
        out = _compress(entries, due - interval_us)
        return out.assign(type=key[0], block=key[1])[["type", "block", "enter", "leave"]]

    def hand_down(kind: str, pdf: pd.DataFrame, due: np.ndarray) -> pd.DataFrame:
        blocks, dues = [], []
        for block, enter, leave in _children(pdf):
            blocks.append(block)
            dues.append(int(due[0]))
            due = _follow(enter, leave, due, interval_us)
        return pd.DataFrame({"type": kind, "block": blocks, "due": dues})

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return hand_down(key[0], pdf, np.array([LONG_AGO]))

    def expand(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return hand_down(key[0], left, right["due"].to_numpy()[:1])

    def send(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        t, sent = np.sort(left["ts_us"].to_numpy()), []
        at = int(np.searchsorted(t, int(right["due"].iloc[0]), side="left"))
        while at < len(t):
            sent.append(t[at])
            at = int(np.searchsorted(t, t[at] + interval_us, side="left"))
        return pd.DataFrame({"type": key[0], "ts_us": np.array(sent, dtype=np.int64)})

    tables = [times.groupBy("type", "block").applyInPandas(summarise, summary_schema)]
    for _ in range(LEVELS - 1):
        tables.append(tables[-1].groupBy("type", parent).applyInPandas(merge, summary_schema))
    due = tables[-1].groupBy("type").applyInPandas(chain, due_schema)
    for level in reversed(tables[:-1]):
        above = due.withColumnRenamed("block", "parent")
        due = (
            level.withColumn("parent", parent)
            .groupBy("type", "parent")
            .cogroup(above.groupBy("type", "parent"))
            .applyInPandas(expand, due_schema)
        )
    sent = (
        times.groupBy("type", "block").cogroup(due.groupBy("type", "block")).applyInPandas(
            send, "type string, ts_us bigint"
        )
    )
    return sent.select(F.col("type").alias(type_col), "ts_us")


def sent_alerts(
    alerts: DataFrame, type_col: str = "anomaly_type", interval_us: int = AlertConfig().interval_us
) -> DataFrame:
    """The alert rows that go out; of equal times the lowest id is the one sent."""
    slots = throttle(alerts, type_col, interval_us)
    first = alerts.groupBy(type_col, "ts_us").agg(F.min("anomaly_id").alias("anomaly_id"))
    return first.join(slots, [type_col, "ts_us"])
