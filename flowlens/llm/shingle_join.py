"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its word 5-grams, as hashes. Two sets of similarity 0.75 or more must share one
of the first quarter of their grams in any common order, so only those *prefixes* are compared to find
candidates; grams that are frequent come last in that order, so that boilerplate seldom matters.

All links come through a matrix of groups and grams: classes of similar documents form a group, which stores
the union of its grams; a class counts its own grams in the union, and only if that bound reaches what
similarity 0.75 needs is the group opened and its members compared one by one.

1. Equal sets become one class. Classes that share a prefix gram are dealt to keys by minimum hashes; the
   first classes of a key are its group, and all classes of the key ask it. That links most copies, however
   many, with few comparisons each.
2. Classes that share a prefix gram but are not connected yet ask the groups that hold it: now all classes
   are partitioned into groups. Nothing is capped: whatever may link is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.arrays import NOT_SPACE, flat, mix, word_hashes, words
from flowlens.llm.tables import components, lean, saved, slices

WORDS = 5
HOT_BITS = 23  # frequent grams are kept in a bit map of fixed size; clashes only change the order
HOT_HERE, HOT = 2, 32  # a gram counts as frequent from so many documents per chunk of a task, and in total
CHUNK = 1_500_000  # prefix grams that a task holds at a time
COUNTED = 4_000_000  # grams among which a task looks for frequent ones at a time
BUCKET = 1_000_000  # prefix grams per bucket aimed at
KEYS = 2  # groups that a class is dealt into in the first step
HEADS = 8  # classes per group of a key, in the first step
GROUP = 64  # classes per group of the matrix, in the second
QUERIES = 256  # queries per task and group

FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text. With fewer words the whole sequence is one gram."""
    data, borders = flat(column)
    starts, ends, rows = words(data, borders, NOT_SPACE)
    w = word_hashes(data, starts, ends)
    n = np.bincount(rows, minlength=len(column))
    first = np.cumsum(n) - n
    grams, owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= WORDS:
        m = len(w) - WORDS + 1
        total = w[:m] * FACTORS[0]
        for j in range(1, WORDS):
            total += w[j : m + j] * FACTORS[j]
        whole = rows[WORDS - 1 :] == rows[:m]
        grams, owners = mix(total[whole]), rows[:m][whole]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        total = n[few].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(WORDS - 1):
            at = few[n[few] > j]
            total[n[few] > j] += w[first[at] + j] * FACTORS[j]
        grams, owners = np.concatenate([grams, mix(total)]), np.concatenate([owners, few])
        order = np.argsort(owners, kind="stable")
        grams, owners = grams[order], owners[order]
    cuts = np.searchsorted(owners, np.arange(len(column) + 1))
    return [distinct(grams[a:b]) for a, b in zip(cuts, cuts[1:])]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values: by one sort, where ``np.unique`` of numbers goes through a hash table first."""
    found = np.sort(values)
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found if new.all() else found[new]


def class_names(sets: list[np.ndarray]) -> list[int | None]:
    """64-bit name of each set, the same for equal sets; none for empty ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = sizes > 0
    if not some.any():
        return [None] * len(sets)
    grams, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
    a = np.add.reduceat(mix(grams ^ np.uint64(0x94D049BB133111EB)), first)
    b = np.add.reduceat(mix(grams + np.uint64(0xD6E8FEB86659FD93)), first)
    names = iter(mix(a ^ (b << np.uint64(29)) ^ (b >> np.uint64(35)) ^ sizes[some].astype(np.uint64)).view(np.int64).tolist())
    return [next(names) if x else None for x in some]


def similar(common, a, b):
    """Whether two sets of sizes a and b with so much in common have a similarity of 0.75 or more."""
    return 7 * common >= 3 * (a + b)


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


SIGNED = "id long, key long, n int, h long, gram long, c int"


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and size of each document, and the grams that are frequent among a task's classes."""

    def rows(ids: pa.Array, keys: pa.Array, n: list[int], h: list[int], gram: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        m, k = len(n), len(gram)
        return pa.RecordBatch.from_arrays(
            [
                *[pa.concat_arrays([x.cast(pa.int64()), pa.nulls(k, pa.int64())]) for x in (ids, keys)], pa.array([*n, *[None] * k], pa.int32()),
                pa.array([*h, *[None] * k], pa.int64()), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(gram.view(np.int64))]),
                pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(c.astype(np.int32))]),
            ],
            names=["id", "key", "n", "h", "gram", "c"],
        )

    none = np.zeros(0, np.uint64)
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def frequent() -> pa.RecordBatch:
        grams, c = np.unique(np.concatenate([none, *held]), return_counts=True)
        keep = c >= HOT_HERE
        held.clear()
        seen.clear()
        return rows(pa.array([], pa.int64()), pa.array([], pa.int64()), [], [], grams[keep], c[keep])

    for batch in slices(batches, 2048, 1 << 19):
        sets = gram_sets(batch.column("text"))
        names = class_names(sets)
        for s, h in zip(sets, names):
            if len(s) and h not in seen:
                seen.add(h)
                held.append(s)
                size += len(s)
        yield rows(batch.column("id"), batch.column("key"), [len(s) for s in sets], names, none, np.zeros(0))
        if size >= COUNTED:
            yield frequent()
            size = 0
    if held:
        yield frequent()


PREFIXES = "bucket int, frequent boolean, grams binary, owner binary, classes binary"


def prefixes(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Prefix grams of a task's classes, cut into buckets by their value; packed arrays keep the exchange small."""
    grams: list[np.ndarray] = []
    names: list[int] = []
    seen: set[int] = set()
    size = 0

    def flush() -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(grams), dtype=np.uint32), [len(g) for g in grams])
        g, h = np.concatenate(grams), np.array(names, np.int64)
        often = np.bitwise_and(hot[g >> np.uint64(64 - HOT_BITS + 3)], np.uint8(1) << ((g >> np.uint64(64 - HOT_BITS)) & np.uint64(7)).astype(np.uint8)) > 0
        # Prefixes hold the least grams of sorted sets: mixed, they spread evenly over the buckets.
        bucket = ((mix(g) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        # Frequent grams need not meet to be known as shared: they are spread by class.
        bucket[often] = (mix(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[owner[often]]
        code = bucket * 2 + often
        order = np.argsort(code, kind="stable")
        code, g, owner = code[order], g[order], owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:]):
            used, local = np.unique(owner[a:b], return_inverse=True)
            out.append((int(code[a]) // 2, bool(code[a] % 2), g[a:b].tobytes(), local.astype(np.uint32).tobytes(), h[used].tobytes()))
        for x in (grams, names, seen):
            x.clear()
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "frequent", "grams", "owner", "classes"]
        )

    for batch in slices(batches, 2048, 1 << 19):
        sets = gram_sets(batch.column("text"))
        for s, h in zip(sets, class_names(sets)):
            if h is None or h in seen:
                continue
            seen.add(h)
            often = np.bitwise_and(hot[s >> np.uint64(64 - HOT_BITS + 3)], np.uint8(1) << ((s >> np.uint64(64 - HOT_BITS)) & np.uint64(7)).astype(np.uint8)) > 0
            p = prefix_size(len(s))
            names.append(h)
            grams.append(np.concatenate([s[~often], s[often]])[:p].copy())  # a view would keep the whole set
            size += p
        if size >= CHUNK:
            yield flush()
            size = 0
    if grams:
        yield flush()


def shared_grams(group: pa.Table) -> pa.Table:
    """Prefix grams of a bucket that more than one class has, with these classes."""
    parts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    sure: tuple[list[np.ndarray], list[np.ndarray]] = ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
    for row in range(group.num_rows):
        often, g, owner, h = (group.column(c)[row].as_py() for c in ("frequent", "grams", "owner", "classes"))
        into = sure if often else parts
        into[0].append(np.frombuffer(g, np.uint64))
        into[1].append(np.frombuffer(h, np.int64)[np.frombuffer(owner, np.uint32)])
    if parts[0]:
        g, h = np.concatenate(parts[0]), np.concatenate(parts[1])
        order = np.argsort(g, kind="stable")
        g, h = g[order], h[order]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        many = np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts)
        keep = np.repeat(many, np.diff(np.append(starts, len(g))))
        sure[0].append(g[keep])
        sure[1].append(h[keep])
    g, h = np.concatenate(sure[0]), np.concatenate(sure[1])
    order = np.lexsort((h, g))
    g, h = g[order], h[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])[: len(g)]
    return pa.table({"gram": pa.array(g[new].view(np.int64)), "h": pa.array(h[new])})


def full_sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All grams of the texts whose id falls into a wanted slot, with their class."""
    for whole in batches:
        slot = whole.column("slot").to_numpy()
        kept = whole.filter(pa.array((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0))
        for batch in slices(iter([kept]), 2048, 1 << 19):
            sets = gram_sets(batch.column("text"))
            told = [(h, len(s), s.tobytes()) for s, h in zip(sets, class_names(sets)) if h is not None]
            columns = [*zip(*told)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], names=["h", "n", "grams"]
            )


def open_groups(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Links of queries into a group: the union's bound first, the members only if it is reached."""
    out: tuple[list[int], list[int]] = ([], [])
    if members.num_rows and queries.num_rows:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in members.column("grams")]
        sizes = np.array([len(s) for s in sets])
        names, parts = members.column("h").to_pylist(), members.column("part").to_numpy()
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        union, first, count = np.unique(grams[order], return_index=True, return_counts=True)
        for row in range(queries.num_rows):
            q = np.frombuffer(queries.column("grams")[row].as_py(), np.uint64)
            h, part = queries.column("h")[row].as_py(), queries.column("part")[row].as_py()
            at = np.searchsorted(union, q)
            at[at == len(union)] = 0
            at = at[union[at] == q]
            if 4 * len(at) < 3 * len(q) or not similar(len(at), len(q), sizes.min()):
                continue
            hits = np.repeat(first[at] - np.cumsum(count[at]) + count[at], count[at]) + np.arange(count[at].sum())
            common = np.bincount(owner[hits], minlength=len(sets))
            linked = np.flatnonzero(similar(common, len(q), sizes) & (parts != part))
            for part_seen in np.unique(parts[linked]):  # one link into each component is enough
                out[0].append(h)
                out[1].append(names[linked[np.argmax(parts[linked] == part_seen)]])
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def hot_map(slots: list[int]) -> np.ndarray:
    bits = np.zeros(1 << HOT_BITS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def join_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links), key and root.

    ``key`` is the row's ``row_key`` and ``root`` names its component (null without shingles).

    A-Z is lowered and words are cut at ASCII white space. Null texts and texts without words have no
    shingles and are linked with nothing, so they are their own component. Rows that repeat an id are
    documents of their own; equal texts are linked. Ids must be whole numbers; a row with null as id gets the smallest
    id of its component, or null. Other columns are ignored. The set names are 64-bit hashes, as the grams are.
    """
    spark = df.sparkSession
    texts = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("key")
    )
    told = saved(texts.mapInArrow(lean(signed), SIGNED), "grams-signed")
    documents = told.where("n IS NOT NULL").select("id", "key", "n", "h")
    classes = saved(documents.where("n > 0").groupBy("h").agg(F.min("id").alias("id"), F.max("n").alias("n")), "gram-classes")
    slot = F.shiftrightunsigned("gram", 64 - HOT_BITS).cast("int")
    frequent = (
        told.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT).select(slot.alias("slot")).distinct()
    )
    # At most 2^HOT_BITS small numbers, whatever the input.
    hot = spark.sparkContext.broadcast(hot_map(frequent.toArrow().column("slot").to_pylist()))
    total = classes.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    postings = saved(
        texts.mapInArrow(lean(lambda b: prefixes(b, hot.value, buckets)), PREFIXES)
        .groupBy("bucket").applyInArrow(shared_grams, "gram long, h long").distinct(),
        "gram-postings",
    )
    edges = linked(texts, classes, postings)
    roots = components(edges, "grams")
    named = classes.select("h", F.col("id").alias("least")).join(roots.withColumnRenamed("id", "h"), "h", "left").withColumn(
        "root", F.coalesce("component_id", "h")
    )
    smallest = saved(named.groupBy("root").agg(F.min("least").alias("component_id")), "gram-components")
    of_class = saved(named.select("h", "root").join(smallest, "root").select("h", "root", F.col("component_id").alias("found")), "gram-roots")
    return documents.join(of_class, "h", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id")).alias("component_id"), "key", "root",
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when one document of each component does: the one with the smallest id.

    Texts without shingles stay, repeated ones too. Of other rows with equal id and text one stays.
    """
    found = join_similar(df, id_col, text_col)
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), "key")).alias("b")).select("b.key")
    keys = saved(best.distinct(), "gram-kept")
    name = "__row_key"
    worded = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = df.where(worded).withColumn(name, row_key(id_col, text_col)).join(keys.withColumnRenamed("key", name), name, "left_semi")
    # The join has dealt rows by their key already, so this moves nothing.
    return rows.dropDuplicates([name]).drop(name).unionByName(df.where(~worded))


def likely(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share so many prefix grams can be similar.

    The set whose prefix ends first shares nothing else before that end, so at most what it has behind
    its prefix comes on top; that is three quarters of the larger set at most.
    """
    behind = F.floor((3 * F.greatest(a, b) + 3) / 4) - 1
    return (7 * (common + behind) >= 3 * (a + b)) & (4 * F.least(a, b) >= 3 * F.greatest(a, b))


def grams_of(texts: DataFrame, classes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """All grams of the classes in ``wanted`` (h), read again from the texts that stand for them.

    Slots of the ids go to all tasks as a bit map of fixed size, so that few texts but the wanted ones are
    cut into grams; what else falls into a slot is left out by the join.
    """
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - HOT_BITS).cast("int").alias("slot")
    wanted = wanted.distinct()
    # At most 2^HOT_BITS small numbers, whatever the input.
    slots = classes.join(wanted, "h").select(slot).distinct().toArrow().column("slot").to_pylist()
    bits = texts.sparkSession.sparkContext.broadcast(hot_map(slots))
    found = texts.select(slot, "text").mapInArrow(lean(lambda b: full_sets(b, bits.value)), "h long, n int, grams binary")
    return saved(found.join(wanted, "h", "left_semi").groupBy("h").agg(F.max("n").alias("n"), F.max("grams").alias("grams")), name)


def within_reach(common: Column, n: Column) -> Column:
    """Whether a set of size n that shares so many prefix grams with a group's union may be similar to a set of ``least`` to ``most`` grams."""
    low, high = F.greatest("least", F.ceil(3 * n / 4)), F.least("most", F.floor(4 * n / 3))
    # What is needed grows with the partner's size up to n and then falls, but for steps of one: least at the ends.
    reached = likely(common, n, low) | likely(common, n, high) | likely(common, n, F.greatest(low, high - 1))
    return (low <= high) & reached


def opened(texts: DataFrame, classes: DataFrame, queries: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Links between the classes of ``queries`` and the groups that they ask, both with (h, part, into), by the union's bound and then the members.

    Whole sets meet where a group's members and its queries do; queries of one group are salted.
    """
    salts = saved(queries.groupBy("into").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts")), f"{name}-salts")
    asked = queries.join(salts, "into").withColumn("salt", F.pmod(F.xxhash64("h"), F.col("salts")).cast("int")).drop("salts")
    answering = saved(members.join(salts, "into"), f"{name}-answering").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sets = grams_of(texts, classes, queries.select("h").unionByName(answering.select("h")), name)
    with_sets = lambda rows: rows.join(sets.select("h", "grams"), "h").select(
        *[F.col(c).alias(c) for c in ("into", "salt", "h", "part", "grams")]  # new names, as the tables stand on both sides
    )
    return with_sets(answering).groupBy("into", "salt").cogroup(with_sets(asked).groupBy("into", "salt")).applyInArrow(
        open_groups, "a long, b long"
    )


def linked(texts: DataFrame, classes: DataFrame, postings: DataFrame) -> DataFrame:
    """Links between classes that connect whatever is connected by similar sets (not all links)."""
    keys = saved(
        postings.groupBy("h").agg(
            *[F.min(F.xxhash64("gram", F.lit(i))).alias(f"k{i}") for i in range(KEYS)], F.collect_list("gram").alias("shared")
        ).join(classes, "h"),
        "gram-keys",
    )
    # First step: everyone asks the groups of like size of its keys.
    sized = lambda i: F.floor(F.log("n") / math.log(4 / 3) + i / KEYS).cast("int")
    dealt = keys.withColumn("g", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k"), sized(i).alias("size")) for i in range(KEYS)
    ]))).select("h", "n", "shared", "g.*")
    into = F.xxhash64("i", "k", "size").alias("into")
    # The group of a key: its first classes. Tasks keep so many of each before anything moves.
    first_of = Window.partitionBy("i", "k", "size").orderBy("h")
    chosen = dealt.select("h", "i", "k", "size").withColumn("rank", F.row_number().over(first_of))
    heads = saved(chosen.where(F.col("rank") <= HEADS).join(keys, "h").select(into, "h", "n", "shared"), "gram-heads")
    unions = saved(
        heads.groupBy("into").agg(
            F.array_distinct(F.flatten(F.collect_list("shared"))).alias("union"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("members"),
        ).where("members > 1"),
        "gram-unions",
    )
    asking = dealt.select(into, "h", "n", "shared").join(unions, "into")
    # Half of the bound needs no whole set: what a class shares with the union by its prefix.
    common = F.size(F.array_intersect("shared", "union"))
    own = F.col("h").alias("part")
    asked_first = saved(asking.where(common > 0).where(within_reach(common, F.col("n"))).select("h", own, "into"), "gram-near")
    first = saved(opened(texts, classes, asked_first, heads.select("into", "h", own), "gram-sets"), "gram-links")
    parts = components(first, "gram-first")
    # Second step: grams that still stand between components, with the groups of the matrix.
    placed = keys.select("h", "n", "k0").join(parts.select(F.col("id").alias("h"), "component_id"), "h", "left").withColumn(
        "part", F.coalesce("component_id", "h")
    )
    weight = saved(placed.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "gram-weights")
    grouped = saved(
        placed.join(weight, "part").withColumn("key", F.when(F.col("size") > 1, F.col("part")).otherwise(F.col("k0")))
        .select("h", "n", "part", "size", "key", (F.col("size") > 1).alias("joined"), F.floor(F.log("n") / math.log(8 / 7)).alias("step")),
        "gram-grouped",
    )
    alike = ["joined", "key", "step"]  # classes of a group are of like size, which sharpens the bound
    blocks = saved(grouped.groupBy(*alike).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("blocks")), "gram-blocks")
    members = saved(
        grouped.join(blocks, alike).select(
            "h", "n", "part", F.struct("size", "part").alias("rank"), F.xxhash64(*alike, F.pmod(F.xxhash64("h"), F.col("blocks"))).alias("g"),
        ),
        "gram-members",
    )
    sizes = saved(members.groupBy(F.col("g").alias("into")).agg(F.min("n").alias("least"), F.max("n").alias("most")), "gram-sizes")
    # Only grams that stand in more than one component need a look.
    known = saved(postings.join(members, "h"), "gram-known")
    open_ = saved(
        known.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("gram"), "gram-open"
    )
    contested = saved(known.join(open_, "gram"), "gram-contested")
    matrix = saved(
        contested.groupBy("gram", F.col("g").alias("into")).agg(F.max("rank").alias("top"), F.min("n").alias("from"), F.max("n").alias("to")),
        "gram-matrix",
    )
    # The first bound counts the prefix grams that a class shares with a group's union.
    counted = (
        contested.select("gram", "h", "n", "part", "rank").join(matrix, "gram")
        .where((F.col("rank") < F.col("top")) & (4 * F.col("n") >= 3 * F.col("from")) & (4 * F.col("to") >= 3 * F.col("n")))
        .groupBy("h", "n", "part", "into").agg(F.count(F.lit(1)).alias("common"))
    )
    queries = saved(counted.join(sizes, "into").where(within_reach(F.col("common"), F.col("n"))).select("h", "part", "into"), "gram-queries")
    second = opened(texts, classes, queries, members.select(F.col("g").alias("into"), "h", "part"), "gram-opened")
    return first.unionByName(second)
