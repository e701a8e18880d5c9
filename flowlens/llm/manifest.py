"""Merkle manifest of a table, with the upper proofs built by a butterfly exchange.

Every row is a leaf. The leaves of a group, in order, are the bottom of a tree in which each run of
``FANOUT`` neighbours becomes their hash, until one digest is left; the groups' digests are the leaves of
one more tree, which ends in the root of the table.

1. Leaves are sorted by ranges and numbered from counts per range, then dealt into blocks of ``BLOCK``
   neighbours, which begin at multiples of it. A block hashes its own lowest levels.
2. Butterfly: in round r the blocks that differ in nothing but digit r of their number (base ``FANOUT``)
   form a group of ``FANOUT`` at most and swap the digests of their subtrees. Each then knows all
   children of the next ancestor, hashes it itself, and adds what it was given to its proof. After the
   last round every block has the group's digest and its whole upper proof, and nothing has to be handed
   down again. At the ragged end, blocks of the last subtree stand in for partners that do not exist,
   in turn.
3. Each block puts its own levels below its upper proof, leaf by leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import saved

FANOUT = 16
LEVELS = 2  # levels that a block hashes on its own
BLOCK = FANOUT**LEVELS
PATH = "array<struct<before:string,after:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(leaves: list[str], n: int) -> list[list[str]]:
    """The levels of a block of a tree of ``n`` leaves, up to the block's digest or the tree's."""
    depth = LEVELS if n > BLOCK else next(k for k in range(LEVELS + 1) if FANOUT**k >= n)
    levels = [leaves]
    for _ in range(depth):
        below = levels[-1]
        levels.append([joined_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


PACKED = "tree string, block long, blocks long, n long, root string, labels array<string>, leaves binary, changed array<string>"


def pack(group: pa.Table) -> pa.Table:
    """One row for a block: its leaves in order and the digest of its subtree."""
    group = group.sort_by("pos")
    n, first = group.column("n")[0].as_py(), group.column("pos")[0].as_py()
    leaves = group.column("leaf").to_pylist()
    return pa.table({
        "tree": group.column("tree").slice(0, 1), "block": pa.array([first // BLOCK], pa.int64()), "blocks": pa.array([-(-n // BLOCK)], pa.int64()),
        "n": pa.array([n], pa.int64()),
        "root": pa.array([levels_of(leaves, n)[-1][0]]), "labels": pa.array([group.column("label").to_pylist()], pa.list_(pa.string())),
        "leaves": pa.array([bytes.fromhex("".join(leaves))], pa.binary()),
        "changed": pa.array([group.column("changed").to_pylist()], pa.list_(pa.string())),
    })


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds the place ``pos`` of each leaf in its tree and the tree's size ``n``; nothing is ordered in one task.

    Rows that are equal in every column are interchangeable: the last sort key spreads them.
    """
    order = ["tree", "at", "leaf", "salt"]
    # Written first: finding the ranges reads the rows twice, and texts should be hashed once.
    ranged = saved(leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "manifest-hashed")
    run = saved(
        ranged.repartitionByRange(*order).sortWithinPartitions(*order).drop("at", "salt")
        .withColumn("mid", F.monotonically_increasing_id()).withColumn("range", F.shiftright("mid", 33)),
        "manifest-leaves",
    )
    counts = run.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("c"), F.min("mid").alias("least"))
    whole = Window.partitionBy("tree")
    places = counts.select(
        "tree", "range", "least", F.sum("c").over(whole).alias("n"),
        (F.sum("c").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
    )
    return run.join(places, ["tree", "range"]).withColumn("pos", F.col("before") + F.col("mid") - F.col("least")).drop("mid", "range", "least", "before")


def exchanged(state: DataFrame, width: int) -> DataFrame:
    """One round of the butterfly: the blocks of ``state`` learn the next ancestor of their subtrees of ``width`` blocks."""
    node = (F.col("block") / width).cast("long")  # of whole numbers below 2^53
    last = ((F.col("blocks") - 1) / width).cast("long")
    sent = state.withColumn("node", node).withColumn("last", last).withColumn("low", F.col("block") % width)
    own = F.array(F.struct(F.col("low"), F.col("block").alias("block")))
    missing = F.col("blocks") % width  # blocks of an incomplete last subtree
    stands_in = (F.col("node") == F.col("last")) & (missing > 0) & (F.col("low") + missing < width) & (F.col("last") % FANOUT > 0)
    extra = F.transform(
        F.sequence(F.col("low") + missing, F.lit(width - 1).cast("long"), missing), lambda x: F.struct(x.alias("low"), F.lit(None).cast("long").alias("block"))
    )
    to = F.when(stands_in, F.concat(own, extra)).otherwise(own)
    part = F.struct((F.col("node") % FANOUT).alias("digit"), "root", F.col("m.block").alias("block"), F.when(F.col("m.block").isNotNull(), F.col("path")).alias("path"))
    met = (
        sent.withColumn("up", (F.col("node") / FANOUT).cast("long")).withColumn("m", F.explode(to))
        .groupBy("tree", "blocks", "up", F.col("m.low").alias("low")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    )
    roots = lambda keep: F.array_join(F.transform(F.filter("parts", keep), lambda p: p["root"]), "")
    members = met.withColumn("above", F.sha2(roots(lambda p: F.lit(True)), 256)).withColumn("own", F.explode(F.filter("parts", lambda p: p["block"].isNotNull())))
    step = F.struct(roots(lambda p: p["digit"] < F.col("own.digit")).alias("before"), roots(lambda p: p["digit"] > F.col("own.digit")).alias("after"))
    return members.select("tree", F.col("own.block").alias("block"), "blocks", F.col("above").alias("root"), F.concat(F.col("own.path"), F.array(step)).alias("path"))


def butterfly(state: DataFrame) -> DataFrame:
    """All rounds: every block (tree, block, blocks, root) gets its tree's digest as ``root`` and its upper ``path``."""
    state = state.withColumn("path", F.array().cast(PATH))
    most = state.agg(F.max("blocks")).first()[0] or 1
    width = 1
    while width < most:
        done = state.where(F.col("blocks") <= width)
        state = saved(exchanged(state.where(F.col("blocks") > width), width).unionByName(done), "manifest-round")
        width *= FANOUT
    return state


PROOFS = f"label string, leaf string, changed string, subroot string, root string, path {PATH}"


def proofs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf of each block: its path through the block's own levels, then the block's upper path."""
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        for block in batch.to_pylist():
            leaves = [block["leaves"][i : i + 32].hex() for i in range(0, len(block["leaves"]), 32)]
            levels = levels_of(leaves, block["n"])
            steps: list[list[tuple[str, str]]] = []  # of each digest of each level that has one above it
            for level in levels[:-1]:
                texts = ["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
                steps.append([(texts[i // FANOUT][: i % FANOUT * 64], texts[i // FANOUT][i % FANOUT * 64 + 64 :]) for i in range(len(level))])
            upper = [(p["before"], p["after"]) for p in block["path"]]
            size = len(steps) + len(upper)
            flat = [s for i in range(len(leaves)) for s in [*[step[i // FANOUT**k] for k, step in enumerate(steps)], *upper]]
            told = pa.StructArray.from_arrays([pa.array([b for b, _ in flat], pa.string()), pa.array([a for _, a in flat], pa.string())], names=["before", "after"])
            m = len(leaves)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block["labels"], pa.string()), pa.array(leaves), pa.array(block["changed"], pa.string()),
                    pa.array([block["subroot"]] * m), pa.array([block["top"]] * m),
                    pa.ListArray.from_arrays(pa.array(range(0, size * m + 1, size) if size else [0] * (m + 1), pa.int32()), told).cast(kind),
                ],
                names=["label", "leaf", "changed", "subroot", "root", "path"],
            )


def blocks_of(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed blocks of the trees of ``leaves`` (tree, at, label, leaf, changed), and the blocks' state after the butterfly."""
    placed = numbered(leaves).withColumn("block", (F.col("pos") / BLOCK).cast("long"))
    packed = saved(placed.groupBy("tree", "block").applyInArrow(pack, PACKED), "manifest-blocks")
    return packed, butterfly(packed.select("tree", "block", "blocks", "root"))


def proofs(packed: DataFrame, state: DataFrame) -> DataFrame:
    """A row per leaf; ``state`` has the group's digest, the one at the ``top`` and the upper path of each block."""
    upper = state.select("tree", "block", F.col("root").alias("subroot"), "top", "path")
    return packed.drop("root", "blocks").join(upper, ["tree", "block"]).mapInArrow(proofs_of, PROOFS)


def manifest(
    df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", altered: list[Column] | None = None,
    is_altered: Column | None = None,
) -> DataFrame:
    """One row per input row: id, leaf, changed, subroot, root and the path from the leaf to the root.

    The leaf is the hash of ``columns``. Leaves of a group ascend by id (null first; rows that share an id by their
    leaf), groups by name (null first, then by UTF-8 bytes). ``path`` has, level by level, the digests ``before``
    and ``after`` the row's own among those hashed with it, hexadecimal and joined; both are empty for a run of one. ``changed`` is the leaf that
    ``altered`` columns would give where ``is_altered`` holds, else null. Nulls in any column are hashed as
    such; repeated rows are leaves of their own; an empty table has no rows. Other columns are ignored.
    """
    text = F.col(group_col).cast("string")
    changed = F.when(F.coalesce(is_altered, F.lit(False)), digest(altered)) if altered else F.lit(None).cast("string")
    leaves = df.select(
        F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), text)).alias("tree"), F.col(id_col).alias("at"),
        F.col(id_col).cast("string").alias("label"), digest([F.col(c) for c in columns]).alias("leaf"), changed.alias("changed"),
    )
    packed, state = blocks_of(leaves)
    groups = state.where("block = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("at"), F.col("tree").alias("label"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("changed")
    )
    few, group_state = blocks_of(groups)
    tops = saved(
        proofs(few, group_state.withColumn("top", F.col("root"))).select(F.col("label").alias("tree"), F.col("root").alias("top"), F.col("path").alias("above")),
        "manifest-groups",
    )
    # Paths meet block by block, before there is a row per leaf, so a large group is met once per block.
    whole = state.join(tops, "tree").withColumn("path", F.concat("path", "above"))
    return proofs(packed, whole).select(F.col("label").cast(df.schema[id_col].dataType).alias(id_col), "leaf", "changed", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Hash of all siblings on the path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
