"""Byte histograms and entropy of BINARY columns, in Arrow batches.

Exploding a payload costs one row per byte; counting a whole batch with numpy costs a
few nanoseconds per byte, so this is one of the few places where Python runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BLOCK = 1 << 20  # bytes counted at a time, to bound the scratch memory


def blocks_of_bytes(values: Sequence[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lengths, bytes) of consecutive rows with about BLOCK bytes in all."""
    sizes = np.fromiter((0 if v is None else len(v) for v in values), dtype=np.int64, count=len(values))
    # Empty rows count too, because each row of a block has 256 counters.
    group = np.cumsum(sizes + 256) // BLOCK
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(values) else []
    for i, lo in enumerate(starts):
        hi = starts[i + 1] if i + 1 < len(starts) else len(values)
        joined = b"".join(v for v in values[lo:hi] if v)
        yield lo, sizes[lo:hi], np.frombuffer(joined, dtype=np.uint8)


def _entropies(values: Sequence[bytes | None]) -> np.ndarray:
    out = np.zeros(len(values))
    for lo, sizes, data in blocks_of_bytes(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(row * 256 + data, minlength=len(sizes) * 256).reshape(-1, 256)
        share = counts / np.maximum(sizes, 1)[:, None]
        logs = np.log2(share, where=share > 0, out=np.zeros_like(share))
        out[lo : lo + len(sizes)] = np.abs((share * logs).sum(axis=1))
    return out


@F.pandas_udf(DoubleType())
def _byte_entropy(values: pd.Series) -> pd.Series:
    return pd.Series(_entropies(values.tolist()))


def byte_entropy(payload: str | Column) -> Column:
    """Shannon entropy (base 2) of the bytes of a value; 0 when empty or null."""
    return _byte_entropy(F.col(payload) if isinstance(payload, str) else payload)


def byte_counts(df: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Partial byte counts: (keys, symbols, counts), at most one row per key and Arrow batch.

    A key may occur in several rows, so the counts are summed after exploding the two arrays.
    """
    names = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            groups = table.append_column("__i", pa.array(np.arange(len(batch)))).group_by(names).aggregate(
                [("__i", "min"), ("__i", "list")]
            )
            code = np.empty(len(batch), dtype=np.int64)
            members = groups["__i_list"].combine_chunks()
            code[members.flatten().to_numpy()] = np.repeat(
                np.arange(len(groups)), np.diff(members.offsets.to_numpy())
            )
            first = groups["__i_min"].to_numpy()
            for lo, sizes, data in blocks_of_bytes(batch[payload].to_pylist()):
                if len(data) == 0:
                    continue
                cell, c = np.unique(np.repeat(code[lo : lo + len(sizes)], sizes) * 256 + data, return_counts=True)
                group = cell // 256
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                offsets = pa.array(np.r_[starts, len(cell)].astype(np.int32))
                owners = table.take(pa.array(first[group[starts]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[owners[n].combine_chunks() for n in names],
                        pa.ListArray.from_arrays(offsets, pa.array((cell % 256).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int64))),
                    ],
                    names=[*names, "symbols", "counts"],
                )

    return df.select(*names, payload).where(F.octet_length(payload) > 0).mapInArrow(
        count, f"{key_schema}, symbols array<int>, counts array<bigint>"
    )
