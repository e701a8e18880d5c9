"""Reading pcap and pcapng files as a distributed table of frames.

A file is cut into splits at any byte. Neither format marks where records begin, so a split looks for
the first place, some way ahead of its border, from which sound headers follow each other for longer than a
frame can be; from there on it walks real records, as its neighbours do, and each record belongs to the split in
which it begins. The same search finds the way back behind a damaged record. No step
holds more than a buffer in memory. What is left out, files or stretches, is listed by ``pcap_rejects``.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.schemas import RAW_FRAME

# Magic number -> (byte order, fraction units per second).
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
FILE_HEADER = 24
RECORD_HEADER = 16
# Fixed values of the block format: block types, and options of an interface.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
TIME_UNITS, TIME_OFFSET = 9, 14
BATCH_BYTES = 4 << 20
LONGEST = 262_144  # bytes of a frame, unless the file allows more
MANY, FEW = 8, 3  # records that make a chain, and one that the end of the file cuts off
YEAR_US = 31_536_000_000_000
SEARCHED = 1 << 20  # bytes searched at a time for a chain of records

# File systems that Spark names differently from Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_file(path: str):
    """Seekable input of a local path or of any file system URI that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    scheme, rest = path.split("://", 1)
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return system.open_input_file(inner)


class _Bytes:
    """Any stretch of a file, through a sliding buffer."""

    def __init__(self, source, size: int):
        self.source, self.size, self.base, self.buffer = source, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.buffer)):
            self.source.seek(at)
            self.base, self.buffer = at, self.source.read(max(n, min(BATCH_BYTES, self.size - at)))
        return self.buffer[at - self.base : at - self.base + n]


def _layout(data: _Bytes) -> tuple[dict, int] | None:
    """How to read a file, and where its records start. The layout grows as interfaces are met."""
    start = data.get(0, 4)
    if start in MAGIC and data.size >= FILE_HEADER:
        order, units = MAGIC[start]
        snap = struct.unpack(order + "I", data.get(16, 4))[0]
        return {"order": order, "units": units, "snap": snap if snap < 1 << 26 else 0}, FILE_HEADER
    if start == SECTION.to_bytes(4, "big") and data.size >= 28:
        return {"order": "<", "faces": []}, 0
    return None


def _interface(data: _Bytes, at: int, total: int, order: str) -> list[int]:
    """Time units per second and offset in seconds of an interface, and its longest capture."""
    units, offset, place = 1_000_000, 0, at + 16
    snap = struct.unpack(order + "I", data.get(at + 12, 4))[0]
    while place + 4 <= at + total - 4:
        code, size = struct.unpack(order + "HH", data.get(place, 4))
        if code == 0:
            break
        value = data.get(place + 4, size)
        if code == TIME_UNITS and size == 1:
            units = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        elif code == TIME_OFFSET and size == 8:
            offset = struct.unpack(order + "q", value)[0]
        place += 4 + (size + 3) // 4 * 4
    return [units, offset, snap]


@dataclass
class Record:
    """A whole record or block: where it starts and ends, and its frame if it holds one."""

    at: int
    end: int
    ts_us: int | None = None
    wire: int = 0
    place: int = -1
    size: int = 0


def _limit(layout: dict) -> int:
    return max(layout.get("snap", 0), LONGEST)


def _parse(data: _Bytes, at: int, layout: dict) -> Record | None:
    """The record at a place, None if no whole and sound one is there. A layout grows as sections and interfaces are met."""
    order = layout["order"]
    if "units" in layout:
        if at + RECORD_HEADER > data.size:
            return None
        seconds, fraction, size, wire = struct.unpack(order + "IIII", data.get(at, RECORD_HEADER))
        end = at + RECORD_HEADER + size
        if fraction >= layout["units"] or size > _limit(layout) or wire == 0 or end > data.size:
            return None
        return Record(at, end, seconds * 1_000_000 + fraction * 1_000_000 // layout["units"], wire, at + RECORD_HEADER, size)
    if at + 12 > data.size:
        return None
    head = data.get(at, 12)
    section = head[:4] == SECTION.to_bytes(4, "big")
    if section:
        order = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
    kind, total = struct.unpack(order + "II", head[:8])
    if total < 12 or total % 4 or total > _limit(layout) * 64 or at + total > data.size or data.get(at + total - 4, 4) != head[4:8]:
        return None
    out = Record(at, at + total)
    if section:
        layout.update(order=order, faces=[])
    elif kind == INTERFACE and total >= 20:
        layout["faces"].append(_interface(data, at, total, order))
    elif kind in (PACKET, OLD_PACKET) and total >= 32:
        face, high, low, size, wire = struct.unpack(order + "IIIII", data.get(at + 8, 20))
        if kind == OLD_PACKET:
            face = struct.unpack(order + "H", data.get(at + 8, 2))[0]
        units, offset, _ = layout["faces"][face] if face < len(layout["faces"]) else (1_000_000, 0, 0)
        out.ts_us, out.wire = offset * 1_000_000 + ((high << 32) | low) * 1_000_000 // units, wire
        out.place, out.size = at + 28, min(size, total - 32)
    elif kind == SIMPLE_PACKET and total >= 16:
        out.wire = struct.unpack(order + "I", data.get(at + 8, 4))[0]
        snap = layout["faces"][0][2] if layout["faces"] else 0
        out.place, out.size = at + 12, min(out.wire, total - 16, snap or out.wire)  # such blocks have no time
    return out


def _believable(data: _Bytes, at: int, layout: dict, length: int) -> bool:
    """Whether MANY records, over ``length`` bytes at least, follow each other from here, or some up to the end of the file.

    Neighbours are at most a year apart. Before the end of a file a few records are enough, and fewer yet if
    they end exactly there.
    """
    trial, start, n, near_us = json.loads(json.dumps(layout)), at, 0, None
    while at - start <= length or n < MANY:
        record = _parse(data, at, trial)
        if record is None:
            rest = data.size - at
            return n > 0 and rest == 0 or n >= FEW and (rest < RECORD_HEADER or _cut_off(data, at, trial))
        if record.size > record.wire:  # a chain shifted by four bytes reads the wire length as size
            return False
        if record.ts_us is not None:
            if near_us is not None and abs(record.ts_us - near_us) > YEAR_US:
                return False
            near_us = record.ts_us
        at, n = record.end, n + 1
    return True


def _cut_off(data: _Bytes, at: int, layout: dict) -> bool:
    """Whether a sound header announces more than the file holds."""
    order, head = layout["order"], data.get(at, RECORD_HEADER)
    if "units" in layout:
        _, fraction, size, wire = struct.unpack(order + "IIII", head)
        return fraction < layout["units"] and 0 < size <= min(wire, _limit(layout)) and at + RECORD_HEADER + size > data.size
    total = struct.unpack(order + "I", head[4:8])[0]
    return total >= 12 and total % 4 == 0 and total <= _limit(layout) and at + total > data.size


def _found(data: _Bytes, at: int, layout: dict, stop: int | None = None, length: int = 0) -> int | None:
    """The first place from ``at`` on, and before ``stop``, where a chain of records begins."""
    while at + 12 <= data.size and (stop is None or at < stop):
        raw = np.frombuffer(data.get(at, min(SEARCHED, data.size - at)), np.uint8).astype(np.uint32)
        n = len(raw) - (RECORD_HEADER if "units" in layout else 12) + 1
        if n <= 0:
            return None
        steps = (0, 8, 16, 24) if layout["order"] == "<" else (24, 16, 8, 0)
        word = lambda k: sum(raw[k + j : k + j + n] << np.uint32(s) for j, s in enumerate(steps))
        if "units" in layout:
            size, wire = word(8), word(12)
            mask = (word(4) < layout["units"]) & (size > 0) & (size <= wire) & (size <= _limit(layout))
        else:
            total = word(4)
            mask = (total >= 12) & (total % 4 == 0) & (total <= _limit(layout) * 64)
        for c in np.flatnonzero(mask):
            if stop is not None and at + c >= stop:
                return None
            if _believable(data, at + int(c), layout, length):
                return at + int(c)
        at += n
    return None


def _walk(data: _Bytes, at: int, stop: int, layout: dict, damaged: list[tuple[int, int]]) -> Iterator[Record]:
    """Sound records that start before ``stop``. Stretches that hold none go to ``damaged`` as (start, end).

    A record is put out when a sound one follows it, or the end of the file: a wrong length shows only there.
    After a break the search begins inside the record before, so no more than the damaged one is lost.
    """
    held: Record | None = None
    while True:
        record = _parse(data, at, layout) if at < data.size else None
        if record is None and at < data.size:
            again = _found(data, (held.at if held else at) + 1, layout)
            begin = at
            # A frame shorter than it was on the wire, without reaching the longest one allowed, is not to be believed either.
            short = held and held.place >= 0 and held.size < held.wire and held.size != layout.get("snap")
            if held and (again is not None and again < held.end or short and "units" in layout):
                begin = held.at
            elif held:
                yield held
            held = None
            damaged.append((begin, data.size if again is None else again))
            if again is None or again >= stop:
                return
            at = again
            continue
        if held:
            yield held
        if record is None or at >= stop:
            return
        held, at = record, record.end


def _entered(data: _Bytes, low: int, layout: dict, first: int) -> int | None:
    """A record at or shortly before ``low`` from which its split is walked.

    A chain that begins inside a frame, because that holds a capture itself, leaves it within the length of a
    frame and goes on only if it then meets real records. So chains longer than that are looked for, far enough
    ahead of ``low`` to be real ones there; only where damage leaves none, shorter ones.
    """
    longest = _limit(layout)
    early = low - 4 * longest
    if early <= first:
        return first
    orders = [layout["order"]] if "units" in layout else [layout["order"], ">" if layout["order"] == "<" else "<"]
    for stop, length in ((low - longest, longest), (None, 0)):
        for order in orders:  # a later section may be written in the other order
            layout["order"] = order
            at = _found(data, early, layout, stop, length)
            if at is not None:
                return at
    return None


def _opened(split: dict, source) -> tuple[_Bytes, dict, int] | None:
    """The file of a split, the layout that holds where it begins, and a record to begin at."""
    data = _Bytes(source, split["size"])
    known = _layout(data)
    if known is None:
        return None
    layout, first = known
    if "faces" in layout and split["low"]:
        for place, order, face in () if split["faces"] is None else split["faces"]:  # those of sections and interfaces before this split, in order
            if int(place) < split["low"] - 4 * _limit(layout):
                layout["order"] = order
                layout["faces"] = [] if face is None else [*layout["faces"], json.loads(face)]
    at = _entered(data, split["low"], layout, first)
    return None if at is None else (data, layout, at)


def _interfaces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sections and interfaces that begin in each split of files in the block format: a section has no face."""
    for splits in batches:
        rows = []
        for split in splits.to_dict("records"):
            try:
                with open_file(split["path"]) as source:
                    known = _opened({**split, "faces": None}, source)
                    if known is None or "faces" not in known[1]:
                        continue
                    data, layout, at = known
                    for record in _walk(data, at, split["high"], layout, []):
                        kind = data.get(record.at, 4)
                        if record.at < split["low"]:
                            continue
                        if kind == SECTION.to_bytes(4, "big"):
                            rows.append((split["path"], record.at, layout["order"], None))
                        elif struct.unpack(layout["order"] + "I", kind)[0] == INTERFACE:
                            rows.append((split["path"], record.at, layout["order"], json.dumps(_interface(data, record.at, record.end - record.at, layout["order"]))))
            except OSError:
                continue  # listed by pcap_rejects
        yield pd.DataFrame(rows, columns=["path", "at", "order", "face"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["packet_id", "source", "record_offset", "ts_us", "wire_length", "frame"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for splits in batches:
        for split in splits.to_pylist():
            rows, held = [], 0
            try:
                source = open_file(split["path"])
            except OSError:
                continue  # listed by pcap_rejects
            with source:
                known = _opened(split, source)
                if known is None:
                    continue
                data, layout, at = known
                for r in _walk(data, at, split["high"], layout, []):
                    if r.at < split["low"] or r.place < 0:
                        continue
                    rows.append((split["base"] + r.at, split["path"], r.at, r.ts_us, min(r.wire, (1 << 31) - 1), data.get(r.place, r.size)))
                    held += r.size
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for splits in batches:
        rows = []
        for split in splits.to_dict("records"):
            name, size, low, high = (split[c] for c in ("path", "size", "low", "high"))
            try:
                with open_file(name) as source:
                    if _layout(_Bytes(source, size)) is None:
                        if low == 0:
                            rows.append((name, size, "unknown format", 0))
                        continue
                    known = _opened(split, source)
                    if known is None:
                        if low == 0 or high == size:
                            rows.append((name, size - low, "no records", low))
                        continue
                    data, layout, at = known
                    damaged: list[tuple[int, int]] = []
                    for _ in _walk(data, at, high, layout, damaged):
                        pass
                    rows += [(name, b - a, "cut off" if b == size else "damaged", a) for a, b in damaged if low <= a < high]
            except OSError as e:
                if low == 0:
                    rows.append((name, size, f"cannot be opened: {e}", 0))
        yield pd.DataFrame(rows, columns=["path", "length", "reason", "start"])


def _splits(spark: SparkSession, path: str, split_bytes: int, parallelism: int | None) -> DataFrame:
    """Stretches of all files under a path: path, size, base, low, high and the interfaces of files in the block format."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    earlier = Window.partitionBy().orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    files = listed.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("bigint"))
    spread = parallelism or spark.sparkContext.defaultParallelism * 4
    cuts = files.withColumn("low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint"))))
    cuts = cuts.withColumn("high", F.least(F.col("low") + split_bytes, "size")).repartition(spread, "path", "low")
    # Interfaces of the block format may stand anywhere before the packets that name them; other files are not read here.
    found = cuts.mapInPandas(_interfaces, "path string, at bigint, order string, face string")
    faces = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "order", "face"))).alias("f")).select(
        "path", F.transform("f", lambda x: F.array(x["at"].cast("string"), x["order"], x["face"])).alias("faces")
    )
    return cuts.join(faces, "path", "left").repartition(spread, "path", "low")


def read_pcap(
    spark: SparkSession, path: str, split_bytes: int = 64 << 20, parallelism: int | None = None
) -> DataFrame:
    """Frames of all pcap and pcapng files under a path: packet_id, source, record_offset, ts_us, wire_length, frame.

    ``packet_id`` is the record's offset in all files laid end to end by name: it keeps the order of
    files and of records, and fits 64 bits up to eight exabytes. Blocks without a time have a null ``ts_us``.
    Files are cut into splits wherever they are; a damaged record costs no other one. ``pcap_rejects``
    lists what is left out.
    """
    splits = _splits(spark, path, split_bytes, parallelism)
    return splits.mapInArrow(_read, f"packet_id BIGINT, {RAW_FRAME}")


def pcap_rejects(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """What ``read_pcap`` leaves out: (path, length, reason, start).

    Files in no known format, that cannot be opened or hold no record are listed whole; damaged stretches and a
    record cut off at the end by their start and length in bytes. Spark does not list empty files.
    """
    return _splits(spark, path, split_bytes, None).mapInPandas(_judge, "path string, length bigint, reason string, start bigint")


def pcap_packets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decoded IPv4 packets of all pcap files under a path."""
    from flowlens.functions.frames import decode

    return decode(read_pcap(spark, path, **options))
