"""Removal of repeated strings by a distributed, common-prefix-aware merge sort of suffixes.

Every stretch of ``LENGTH`` bytes has an anchor: the ``GRAM`` bytes inside it whose hash is least, the
leftmost if several are. Equal stretches have equal anchors at equal places, so only stretches whose
anchor stands at the same place of equal grams can be equal, and grams that occur once need no further
look. The suffixes that start at the remaining anchors are sorted:

* each task sorts its own suffixes, folds equal ones into one with a count, and writes *runs* that are
  front-coded (length of the prefix shared with the suffix before, then the rest);
* runs are exchanged by ranges of the gram's hash, the first eight bytes of the sort key;
* a loser tree merges the runs of a range. Each waiting suffix carries the length of the prefix it shares
  with the one that beat it, so prefixes known to be equal are never compared again.

Neighbours in the merged order show how far suffixes agree to the right of the anchor; the bytes on its
left are compared the same way. Both together tell which stretches occur twice, exactly.

A gram that occurs more than ``HOT`` times would put all its suffixes into one range. Its stretches are
compared by hashes in two steps instead (blocks of stretches, then single ones where a block cannot
decide), with counts that are added up before the exchange, so no group is ever gathered anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.arrays import flat, mix, prefix_hashes, window
from flowlens.llm.tables import saved, slices

GRAM = 100
HOT = 400  # occurrences of a gram beyond which it is spread by hashes
STEP = 16  # stretches in a block of the hashed comparison
RUN_BYTES = 6 << 20  # suffix bytes sorted at a time
RANGE_ANCHORS = 8_000  # anchors aimed at per range of the exchange

ANCHORS = "id long, h long, gram long, x int, first int, last int"


def anchors_of(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, gram hash, place, first and last stretch of each anchor; places count from the row's start."""
    width = length - GRAM + 1
    n = len(data) - GRAM + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 5
    sums = prefix_hashes(data)
    places = np.arange(n)
    hashes = window(sums, places, places + GRAM)
    # Least hash first, then leftmost: both in one number.
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = packed
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)
    sizes = np.maximum(np.diff(borders) - length + 1, 0)  # stretches of each row
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + borders[rows]
    x = least[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (rows[1:] != rows[:-1])])) if len(x) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(x)]])[: len(new)] - 1
    base = borders[rows[new]]
    # Anchors have small hashes: mixed once more, their grams spread evenly over the ranges.
    return rows[new], mix(hashes[x[new]]).view(np.int64), x[new] - base, starts[new] - base, starts[last] - base


def shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n, at = min(len(a), len(b)), start
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    if at >= n:
        return n
    for at in range(at, min(at + 32, n)):
        if a[at] != b[at]:
            return at
    return n


class Run:
    """A front-coded sorted run, read one suffix at a time."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        heads = np.frombuffer(blob, np.uint32, 5 * n, 4).reshape(5, n)
        self.prefix, self.size, self.left_prefix, self.left_size, self.copies = heads.tolist()
        self.blob, self.at, self.n, self.i = blob, 4 + 20 * n, n, -1
        self.key = self.left = b""
        self.lcp = 0  # with whatever beat this run's suffix last

    def step(self) -> bool:
        self.i = i = self.i + 1
        if i >= self.n:
            return False
        blob, at = self.blob, self.at
        mid, end = at + self.size[i], at + self.size[i] + self.left_size[i]
        self.key = self.key[: self.prefix[i]] + blob[at:mid]
        self.left = self.left[: self.left_prefix[i]] + blob[mid:end]
        self.at, self.lcp = end, self.prefix[i]
        return True


def front_coded(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """A run of sorted (key, left, copies)."""
    heads, parts = np.zeros((5, len(entries)), np.uint32), []
    key = left = b""
    for i, (k, before, copies) in enumerate(entries):
        p, q = shared(key, k, 0), shared(left, before, 0)
        heads[:, i] = p, len(k) - p, q, len(before) - q, copies
        parts += [k[p:], before[q:]]
        key, left = k, before
    return b"".join([len(entries).to_bytes(4, "little"), heads.tobytes(), *parts])


def merged(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """Run number of each suffix in sorted order and the length of the prefix it shares with the one before.

    The caller reads the suffix from the run before asking for the next.
    """
    size = 1
    while size < len(runs):
        size *= 2
    alive = [r.step() for r in runs] + [False] * (size - len(runs))

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the loser's shared length is set to that with the winner."""
        if not (alive[a] and alive[b]):
            return alive[a]
        x, y = runs[a], runs[b]
        if x.lcp != y.lcp:  # both follow the last suffix put out: the one that shares more with it comes first
            return x.lcp > y.lcp
        n = shared(x.key, y.key, x.lcp)
        first = n == len(x.key) or n < len(y.key) and x.key[n] < y.key[n]
        (y if first else x).lcp = n
        return first

    losers = [0] * size
    winners = [*[0] * size, *range(size)]
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1]
    while alive[best]:
        yield best, runs[best].lcp
        alive[best] = runs[best].step()
        node = (best + size) // 2
        while node:
            if beats(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def reach(rights: list[bytes], lcps: list[int], lefts: list[bytes], copies: list[int], length: int) -> list[tuple[int, int]]:
    """For suffixes of one gram, in order: bytes left and right of the anchor that repeated stretches cover.

    ``lcps[i]`` is shared with suffix i - 1. A stretch that starts ``a`` bytes left of the anchor is
    repeated if another suffix agrees for ``a`` bytes on the left and ``length - a`` on the right.
    """
    n = len(rights)
    if n == 2:
        r, left = lcps[1], shared(lefts[0], lefts[1], 0)
        both = (left, r) if left + r >= length else (0, 0)
        found = [both, both]
    elif n > 2:
        order = sorted(range(n), key=lefts.__getitem__)
        left_lcps = [0, *[shared(lefts[order[i - 1]], lefts[order[i]], 0) for i in range(1, n)]]
        a = np.arange(max(0, length - max(map(len, rights))), max(map(len, lefts)) + 1)
        class_r = np.cumsum(np.array(lcps)[:, None] < length - a[None, :], axis=0)
        class_l = np.empty_like(class_r)
        class_l[order] = np.cumsum(np.array(left_lcps)[:, None] < a[None, :], axis=0)
        valid = (np.array([len(r) for r in rights])[:, None] >= length - a) & (np.array([len(x) for x in lefts])[:, None] >= a)
        code = (np.arange(len(a))[None, :] * (n + 1) + class_r) * (n + 1) + class_l
        _, back, count = np.unique(code[valid], return_inverse=True, return_counts=True)
        twice = np.zeros(code.shape, bool)
        twice[valid] = count[back] > 1
        any_a = twice.any(axis=1)
        most = a[len(a) - 1 - np.argmax(twice[:, ::-1], axis=1)]
        least = a[np.argmax(twice, axis=1)]
        found = [(int(m), int(length - q)) if ok else (0, 0) for ok, m, q in zip(any_a, most, least)]
    else:
        found = [(0, 0)]
    return [(len(x), len(r)) if c > 1 else f for x, r, c, f in zip(lefts, rights, copies, found)]


def merge_range(group: pa.Table, length: int) -> pa.Table:
    """Merges the runs of a range and gives, per run, the reach of its suffixes that hold repeated stretches."""
    numbers = group.column("run").to_pylist()
    runs = [Run(b.as_py()) for b in group.column("blob")]
    told: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in runs]
    rights: list[bytes] = []
    lefts: list[bytes] = []
    lcps: list[int] = []
    copies: list[int] = []
    seats: list[list[tuple[int, int]]] = []
    place: dict[bytes, int] = {}

    def close() -> None:
        for (left, right), who in zip(reach(rights, lcps, lefts, copies, length), seats):
            if right:
                for run, seq in who:
                    for out, v in zip(told[run], (seq, left, right)):
                        out.append(v)

    for run, lcp in merged(runs):
        r = runs[run]
        if lcp < 8 and rights:
            close()
            for values in (rights, lefts, lcps, copies, seats):
                values.clear()
            place.clear()
        if not (rights and lcp - 8 == len(r.key) - 8 == len(rights[-1])):
            place.clear()  # of lefts that stand beside an equal right
        at = place.get(r.left)
        if at is None:
            place[r.left] = len(rights)
            lcps.append(max(0, lcp - 8))
            rights.append(r.key[8:])
            lefts.append(r.left)
            copies.append(r.copies[r.i])
            seats.append([(run, r.i)])
        else:
            copies[at] += r.copies[r.i]
            seats[at].append((run, r.i))
    if rights:
        close()
    full = [i for i, t in enumerate(told) if t[0]]
    ints = pa.list_(pa.int32())
    return pa.table({
        "run": pa.array([numbers[i] for i in full], pa.int64()),
        "seqs": pa.array([told[i][0] for i in full], ints),
        "lefts": pa.array([told[i][1] for i in full], ints),
        "rights": pa.array([told[i][2] for i in full], ints),
    })


RUNS = "bucket int, run long, blob binary, seqs array<int>, ids array<long>, hs array<long>, xs array<int>"


def sorted_runs(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes at the anchors of a task's texts, RUN_BYTES at a time, and cuts runs by ranges."""
    held: list[tuple[bytes, bytes, int, int, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        held.sort()
        rows: dict[int, tuple[list, list]] = {}
        for key, left, i, h, x in held:
            bucket = int.from_bytes(key[:4], "big") * buckets >> 32
            entries, seats = rows.setdefault(bucket, ([], []))
            if entries and entries[-1][0] == key and entries[-1][1] == left:
                entries[-1][2] += 1
            else:
                entries.append([key, left, 1])
            seats.append((len(entries) - 1, i, h, x))
        held.clear()
        seats = [s for _, s in rows.values()]
        column = lambda j, kind: pa.array([[s[j] for s in row] for row in seats], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(rows), pa.int32()), pa.array([uuid.uuid4().int >> 65 for _ in rows], pa.int64()),
                pa.array([front_coded(e) for e, _ in rows.values()], pa.binary()),
                column(0, pa.int32()), column(1, pa.int64()), column(2, pa.int64()), column(3, pa.int32()),
            ],
            names=["bucket", "run", "blob", "seqs", "ids", "hs", "xs"],
        )

    for batch in slices(batches, 256, 1 << 20):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        ids, hs, marks = (batch.column(c).to_pylist() for c in ("id", "h", "marks"))
        for text, i, h, places in zip(texts, ids, hs, marks):
            for m in places:
                x = m["x"]
                key = (m["gram"] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + text[x : m["last"] + length]
                left = text[m["first"] : x][::-1]
                held.append((key, left, i, h, x))
                size += len(key) + len(left) + 200
            if size >= RUN_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


HASHED = "id long, h long, start int, n int, wide long, core long, hashes array<long>"


def hashed_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to STEP stretches around the anchors of hot grams.

    ``core`` hashes the bytes that all stretches of the block hold, whether they exist in this text or
    not; ``wide`` hashes all bytes of the block (null if it is cut off); ``hashes`` has each stretch.
    """
    for batch in slices(batches, 256, 1 << 19):
        data, borders = flat(batch.column("text"))
        sums = prefix_hashes(data)
        marks = batch.column("marks")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(marks.offsets.to_numpy()))
        told = marks.flatten()
        x, first, last = (told.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "first", "last"))
        base = borders[rows]
        least, most = x - last, x - first  # bytes before the anchor at which stretches start
        count = most // STEP - least // STEP + 1
        who = np.repeat(np.arange(len(x)), count)
        block = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + (least // STEP)[who]
        place = (base + x)[who]
        low, high = np.maximum(block * STEP, least[who]), np.minimum(block * STEP + STEP - 1, most[who])
        core = window(sums, place - block * STEP, place - block * STEP - STEP + 1 + length)
        wide = window(sums, place - high, place - low + length)
        whole = high - low == STEP - 1
        n = high - low + 1
        offsets = np.concatenate([[0], np.cumsum(n)])
        each = np.repeat(place - high, n) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        hashes = window(sums, each, each + length)
        ids, hs = batch.column("id").to_numpy(zero_copy_only=False), batch.column("h").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[rows[who]], pa.int64()), pa.array(hs[rows[who]], pa.int64()),
                pa.array((place - high - base[who]).astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array(wide.view(np.int64), mask=~whole), pa.array(core.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64))),
            ],
            names=["id", "h", "start", "n", "wide", "core", "hashes"],
        )


def often(values: DataFrame, name: str, label: str) -> DataFrame:
    """Values of the only column that occur more than once, written down so that joins with them can split hot ones."""
    return saved(values.groupBy(name).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col(name), F.lit(True).alias(label)), f"often-{name}")


def hashed_spans(texts: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """Covered ranges (id, h, start, stop) around the anchors of hot grams."""
    blocks = saved(
        texts.join(marked, ["id", "h"]).select("id", "h", "text", "marks")
        .mapInArrow(lambda b: hashed_blocks(b, length), HASHED),
        "stretch-blocks",
    )
    wide = often(blocks.where("wide IS NOT NULL").select("wide"), "wide", "wide_twice")
    core = often(blocks.select("core"), "core", "core_twice")
    told = saved(blocks.join(core, "core").join(wide, "wide", "left"), "stretch-told")
    sure = told.where("wide_twice").select("id", "h", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    # What repeats as a whole block is represented once among the single stretches.
    once = told.where("wide_twice").groupBy("wide").agg(F.first("hashes").alias("hashes")).select(F.explode("hashes").alias("stretch"))
    open_ = told.where("wide_twice IS NULL").select("id", "h", "start", F.posexplode("hashes").alias("p", "stretch"))
    twice = often(open_.select("stretch").unionByName(once), "stretch", "twice")
    single = open_.join(twice, "stretch").select(
        "id", "h", (F.col("start") + F.col("p")).alias("start"), (F.col("start") + F.col("p") + length).alias("stop")
    )
    return sure.unionByName(single)


SPANS = "id long, h long, start int, stop int"


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered range of each place whose suffix holds a repeated stretch."""
    for batch in slices(batches, 64, 1 << 19):
        out: tuple[list, ...] = ([], [], [], [])
        for row in batch.to_pylist():
            reached = dict(zip(row["told"], zip(row["lefts"], row["rights"])))
            for seq, i, h, x in zip(row["seqs"], row["ids"], row["hs"], row["xs"]):
                if (lr := reached.get(seq)) is not None:
                    for column, v in zip(out, (i, h, x - lr[0], x + lr[1])):
                        column.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
            names=["id", "h", "start", "stop"],
        )


KEPT = "id long, n_bytes long, kept binary, spans array<struct<start:int,stop:int>>"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the covered ranges of each text and takes them out."""
    for batch in slices(batches, 512, 1 << 20):
        kept, spans, sizes = [], [], []
        for text, covered in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("covered").to_pylist()):
            runs: list[dict[str, int]] = []
            for c in sorted(covered or (), key=lambda c: c["start"]):
                if runs and c["start"] <= runs[-1]["stop"]:
                    runs[-1]["stop"] = max(runs[-1]["stop"], c["stop"])
                else:
                    runs.append(dict(c))
            edges = [0, *[e for r in runs for e in (r["start"], r["stop"])], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append(runs)
            sizes.append(len(text))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
            names=["id", "n_bytes", "kept", "spans"],
        )


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per input row: id, n_bytes, the kept bytes and the removed ranges (UTF-8 bytes, ``stop`` exclusive).

    Every byte covered by a string of ``length`` bytes that starts anywhere else too, in the same text or
    another, is removed; overlapping occurrences count. Null counts as empty; texts shorter than
    ``length`` stay whole; rows that repeat an id are texts of their own, and equal rows repeat each
    other. Ids must be whole numbers; a null id is allowed.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("id", "text"))
    safe = texts.withColumn("id", F.coalesce("id", F.lit(-(1 << 63))))  # joins leave null out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 1 << 19):
            rows, gram, x, first, last = anchors_of(*flat(batch.column("text")), length)
            ids, hs = (batch.column(c).to_numpy() for c in ("id", "h"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows], pa.int64()), pa.array(hs[rows], pa.int64()), pa.array(gram, pa.int64()),
                 *[pa.array(v.astype(np.int32)) for v in (x, first, last)]],
                names=["id", "h", "gram", "x", "first", "last"],
            )

    anchors = saved(safe.where(F.octet_length("text") >= length).select("id", "h", "text").mapInArrow(find, ANCHORS), "anchors")
    grams = saved(
        anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", (F.col("c") > HOT).alias("hot")),
        "anchor-grams",
    )
    repeated = saved(anchors.join(grams, "gram"), "anchors-repeated")
    listed = lambda rows: rows.groupBy("id", "h").agg(
        F.collect_set(F.struct("gram", "x", "first", "last")).alias("marks")
    )
    cold = repeated.where("NOT hot")
    buckets = max(1, -(-cold.count() // RANGE_ANCHORS))
    runs = saved(
        safe.join(listed(cold), ["id", "h"]).select("id", "h", "text", "marks")
        .mapInArrow(lambda b: sorted_runs(b, length, buckets), RUNS),
        "suffix-runs",
    )
    reached = saved(
        runs.select("bucket", "run", "blob").groupBy("bucket").applyInArrow(
            lambda g: merge_range(g, length), "run long, seqs array<int>, lefts array<int>, rights array<int>"
        ),
        "suffix-reach",
    ).withColumnRenamed("seqs", "told")
    spans = runs.drop("blob", "bucket").join(reached, "run").mapInArrow(expand, SPANS)
    hot = repeated.where("hot")
    if not hot.isEmpty():
        spans = spans.unionByName(hashed_spans(safe, listed(hot), length))
    covered = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("covered"))
    out = safe.join(covered, ["id", "h"], "left").select("id", "text", "covered").mapInArrow(cut, KEPT)
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id"))).withColumnRenamed("id", id_col)
