"""Everything that is counted below a session, folded in one scan of the packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import SessionConfig
from flowlens.functions.entropy import blocks_of_bytes
from flowlens.operators import sessions as S

# What a row counts: packets of one time; and what a symbol is: a byte or a port.
INSTANT, BYTE, SRC_PORT, DST_PORT = range(4)
PORTS = {SRC_PORT: "src_port", DST_PORT: "dst_port"}
CHUNK = ["session_key", "chunk"]
SYMBOLS = pa.list_(pa.struct([("kind", pa.int32()), ("at", pa.int64()), ("n", pa.int64())]))
FOLDED = (
    "session_key string, chunk bigint, ts_us bigint, batch bigint, n bigint, bytes bigint, sumsq bigint, "
    "symbols array<struct<kind:int,at:bigint,n:bigint>>"
)


def _rows(chunks: pa.Table, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FOLDED.split(", ")]
    empty = lambda name: pa.nulls(chunks.num_rows, SYMBOLS if name == "symbols" else pa.int64())
    yield from pa.table([chunks[c] if c in CHUNK else columns.get(c, empty(c)) for c in names], names=names).to_batches()


def _symbols(table: pa.Table, batch: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk of a batch: its bytes and ports with how often each occurs."""
    groups = table.select(CHUNK).append_column("i", pa.array(np.arange(table.num_rows))).group_by(CHUNK, use_threads=False).aggregate([("i", "list")])
    members = groups["i_list"].combine_chunks()
    code = np.empty(table.num_rows, np.int64)
    code[members.flatten().to_numpy()] = np.repeat(np.arange(groups.num_rows), np.diff(members.offsets.to_numpy()))
    seen = []
    for lo, sizes, data in blocks_of_bytes(table["payload"].to_pylist()):
        seen.append((BYTE, *np.unique(np.repeat(code[lo : lo + len(sizes)], sizes) << 32 | data, return_counts=True)))
    for kind, name in PORTS.items():
        known = pc.is_valid(table[name]).to_numpy()
        ports = table[name].drop_null().to_numpy()
        seen.append((kind, *np.unique(code[known] << 32 | ports, return_counts=True)))
    owner = np.concatenate([cells >> 32 for _, cells, _ in seen])
    order = np.argsort(owner, kind="stable")
    values = [
        np.concatenate([np.full(len(cells), kind, np.int32) for kind, cells, _ in seen]),
        np.concatenate([cells & 0xFFFFFFFF for _, cells, _ in seen]), np.concatenate([n.astype(np.int64) for *_, n in seen]),
    ]
    offsets = np.searchsorted(owner[order], np.arange(groups.num_rows + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(v[order]) for v in values], fields=list(SYMBOLS.value_type))
    yield from _rows(groups, batch=pa.array(np.full(groups.num_rows, batch)), symbols=pa.ListArray.from_arrays(pa.array(offsets), items))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for i, batch in enumerate(batches):
        table = pa.Table.from_batches([batch])
        told = table.group_by([*CHUNK, "ts_us"], use_threads=False).aggregate([([], "count_all"), ("length", "sum"), ("square", "sum")])
        yield from _rows(told, ts_us=told["ts_us"], n=told["count_all"], bytes=told["length_sum"], sumsq=told["square_sum"])
        yield from _symbols(table, first + i)


def fold_packets(packets: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Distinct times of each chunk (ts_us, n, bytes, sumsq), and its symbols (batch, symbols): one or the other in a row.

    Packets of one Arrow batch that share a chunk and time are one row before the shuffle by chunk and are merged
    after it; symbols stay one row for each chunk and batch, whose number tells the rows apart. Payloads are not shuffled.
    Packets without a time belong to no chunk and are left out.
    """
    length = F.col("length").cast("bigint")
    narrow = S.keyed(packets, cfg).where("ts_us IS NOT NULL").select(
        *CHUNK, F.col("ts_us").cast("bigint").alias("ts_us"), *[F.col(c).cast("bigint").alias(c) for c in PORTS.values()],
        length.alias("length"), (length * length).alias("square"), "payload",
    )
    partial = narrow.mapInArrow(_fold, FOLDED).repartition(*CHUNK)
    return partial.groupBy(*CHUNK, "batch", "ts_us").agg(
        *[F.sum(c).alias(c) for c in ("n", "bytes", "sumsq")], F.first("symbols").alias("symbols")
    )
