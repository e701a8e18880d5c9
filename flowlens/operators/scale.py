"""Skew-safe building blocks.

A window over a whole key puts that key into one task. The helpers here cut a key
into *chunks* that follow the order (a time slice, a hash prefix, a score cell), run
the ordered work inside ``(key, chunk)`` and carry only one small row per chunk
across the key. A key holding a third of the table is thus spread over its chunks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HASH_PREFIX = 4  # hex digits: 65,536 evenly filled chunks per key


def chunk_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    sums: Mapping[str, Column],
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Totals (and maxima) of all *earlier* chunks of the key, one row per ``(keys, chunk)``."""
    tops = maxima or {}
    per_chunk = df.groupBy(*keys, chunk).agg(
        *[F.sum(v).alias(n) for n, v in sums.items()], *[F.max(v).alias(n) for n, v in tops.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_chunk.select(
        *keys, chunk,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
        *[F.max(n).over(earlier).alias(n) for n in tops],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    maxima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums (and maxima) per key along ``(chunk, order)``.

    ``chunk`` must not decrease along ``order``. Rows with null in a key form a group of their own.
    """
    tops = maxima or {}
    inside = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = chunk_totals(
        df, keys, chunk, {f"__before_{n}": v for n, v in sums.items()}, {f"__before_{n}": v for n, v in tops.items()}
    )
    local = df.withColumns(
        {f"__in_{n}": F.sum(v).over(inside) for n, v in sums.items()}
        | {f"__in_{n}": F.max(v).over(inside) for n, v in tops.items()}
    )
    both = lambda n: (F.col(f"__in_{n}"), F.col(f"__before_{n}"))
    named = carried.select(*[F.col(k).alias(f"__key_{k}") for k in (*keys, chunk)], *[f"__before_{n}" for n in (*sums, *tops)])
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in (*keys, chunk)]
    joined = local.join(named, same).drop(*[f"__key_{k}" for k in (*keys, chunk)]).withColumns(
        {n: both(n)[0] + both(n)[1] for n in sums} | {n: F.greatest(*both(n)) for n in tops}
    )
    names = [*sums, *tops]
    return joined.drop(*[f"__in_{n}" for n in names], *[f"__before_{n}" for n in names])


def hash_order(id_col: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of ``seed:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col) if isinstance(id_col, str) else id_col))


def hashed_row_number(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int, name: str = "rn"
) -> DataFrame:
    """Row number per key in md5 order. Hash prefixes are the chunks, so they are even."""
    ranked = df.withColumn("__h", hash_order(id_col, seed)).withColumn(
        "__c", F.substring("__h", 1, HASH_PREFIX)
    )
    return running_totals(ranked, keys, "__c", ["__h", id_col], {name: F.lit(1)}).drop("__h", "__c")


def hashed_head(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int, quotas: DataFrame, name: str = "taken"
) -> DataFrame:
    """Marks the first ``quota`` rows of each key in md5 order.

    Counts per hash prefix tell where the quota ends, so only the rows of that one prefix
    are ranked; all others are decided by comparing prefixes and are never shuffled.
    ``quotas`` holds (keys, quota); without keys it has one row.
    """
    hashed = df.withColumn("__h", hash_order(id_col, seed)).withColumn(
        "__c", F.substring("__h", 1, HASH_PREFIX)
    )
    upto = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = hashed.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__upto", F.sum("__n").over(upto)
    )
    limited = per_chunk.join(quotas, list(keys)) if keys else per_chunk.withColumn("quota", quotas.scalar())
    ends = limited.where(
        (F.col("__upto") - F.col("__n") < F.col("quota")) & (F.col("quota") <= F.col("__upto"))
    ).select(*keys, F.col("__c").alias("__cut"), (F.col("quota") - F.col("__upto") + F.col("__n")).alias("__need"))
    if keys:
        joined = join_small(hashed, ends, list(keys), "left")
    else:
        end = ends.agg(F.first(F.struct("__cut", "__need")).alias("e")).scalar()
        joined = hashed.withColumn("__e", end).select("*", "__e.__cut", "__e.__need").drop("__e")
    border = F.coalesce(F.col("__c") == F.col("__cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*keys, "__c").orderBy("__h", id_col))
    ranked = joined.where(border).withColumn(name, rank <= F.col("__need"))
    decided = joined.where(~border).withColumn(
        name, F.coalesce(F.col("__c") < F.col("__cut"), F.lit(False))
    )
    return ranked.unionByName(decided).drop("__h", "__c", "__cut", "__need")


def join_small(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = 100_000
) -> DataFrame:
    """Broadcast join behind a size check.

    At most ``max_rows + 1`` rows of the small side are fetched. If it is larger, the join is
    left to shuffle, where adaptive execution splits skewed keys.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return big.join(small, list(keys), how)
    local = big.sparkSession.createDataFrame(rows, small.schema)
    return big.join(F.broadcast(local), list(keys), how)


PIECES = 256  # a salted key's pieces hold about one of so many parts of all facts
TRACKED = 10_000  # keys that the sketch follows: counts are off by some 0.02 % of all rows at most


def salts_of(facts: DataFrame, keys: Sequence[str]) -> Column:
    """Number of pieces for the key of a row: 1 but for keys that hold more than one of PIECES parts of ``facts``.

    A sketch of frequent items names those keys: it is merged from the map tasks without a shuffle of keys, and
    at most PIECES keys leave it. Keys are followed by their hash; two that share one only get the same number.
    """
    told = facts.select(F.xxhash64(*keys).alias("k")).agg(
        F.expr(f"approx_top_k(k, {PIECES}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    pieces = lambda x: F.ceil(x["count"] * F.lit(float(PIECES)) / F.col("n")).cast("int")
    hot = F.transform(F.filter("top", lambda x: pieces(x) > 1), lambda x: F.struct(x["item"], pieces(x)))
    return F.coalesce(F.try_element_at(told.select(F.map_from_entries(hot)).scalar(), F.xxhash64(*keys)), F.lit(1))


def salted_join(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], salt_by: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) in which each hot key of ``facts`` is spread over as many tasks as its share of the rows asks for.

    Only rows of ``dimension`` with a hot key are copied; ``salt_by`` identifies a fact.
    """
    salts = salts_of(facts, keys)
    copies = (
        dimension.withColumn("__salts", salts).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    )
    salted = facts.withColumn("__salts", salts).withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.col("__salts")).cast("int")).drop("__salts")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def with_ordered_bits(df: DataFrame, value: str | Column, name: str = "bits") -> DataFrame:
    """Adds the 64-bit image of a double in the same order; equal only for equal values. NaN comes last, null stays null.

    Three projections, because each step is used several times by the next: one logarithm and one power a row.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    size, guess, ratio = F.abs("__v"), F.col("__guess"), F.col("__ratio")
    low = F.lit(-1022).cast("bigint")
    unit = float(1 << 52)
    # The logarithm may miss by one beside a power of two; the quotient by a power of two is exact.
    fraction = (
        F.when(ratio >= 2, (ratio * (unit / 2)).cast("bigint") + (1 << 52))
        .when((ratio < 1) & (guess > low), (ratio * (unit * 2)).cast("bigint") - (1 << 52))
        .otherwise((ratio * unit).cast("bigint"))
    )
    image = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise((guess + 1022) * F.lit(1 << 52) + fraction)
    return (
        df.withColumn("__v", v)
        .withColumn("__guess", F.least(F.greatest(F.coalesce(F.floor(F.log2(size)), low), low), F.lit(1023).cast("bigint")))
        .withColumn("__ratio", size / F.pow(F.lit(2.0), guess))
        .withColumn(name, F.when(F.isnan("__v"), F.lit((1 << 63) - 1)).when(F.col("__v").isNotNull(), image * F.signum("__v").cast("bigint")))
        .drop("__v", "__guess", "__ratio")
    )


RADIX = (22, 21, 21)  # bits of the coarse, middle and fine digit of an ordered image


def radix_cells(bits: Column) -> tuple[Column, Column]:
    """Coarse and middle digit of an image.

    A middle cell holds at most 2^21 distinct values, a coarse one 2^21 middle cells, and there are 2^22
    coarse ones, so a window over any of them is bounded whatever the distribution.
    """
    middle = F.shiftright(bits, RADIX[2]).bitwiseAND(F.lit((1 << RADIX[1]) - 1))
    return F.shiftright(bits, RADIX[1] + RADIX[2]), middle


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a private folder only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="flowlens-"), "checkpoints")
