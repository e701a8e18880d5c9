"""Cleaning, imputation, scaling, encoding, balancing and splitting of training rows.

All random choices are made by md5 order of ``seed:id``, so they repeat on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.scale import RADIX, hashed_head, hashed_row_number, join_small, with_ordered_bits
from flowlens.schemas import ADDRESS_COLUMNS, MODEL_FEATURES, NON_NEGATIVE

SEED = 42


def numeric_strings(df: DataFrame) -> list[str]:
    """String columns in which every non-null value is a number; one aggregate decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    texts = [c for c in texts if c not in ADDRESS_COLUMNS]
    if not texts:
        return []
    bad = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts
    ]
    counts = df.agg(*bad).first()
    return [c for c in texts if counts[c] == 0]


def clean(df: DataFrame, numeric: Sequence[str] | None = None) -> DataFrame:
    """Drops addresses and texts, turns numeric texts into numbers, clips sizes at 0."""
    numbers = set(numeric_strings(df) if numeric is None else numeric)
    out = []
    for f in df.schema.fields:
        text = isinstance(f.dataType, T.StringType)
        if f.name in ADDRESS_COLUMNS or (text and f.name not in numbers):
            continue
        c = F.col(f.name).try_cast("double") if text else F.col(f.name)
        if f.name in NON_NEGATIVE:
            c = F.when(c.isNotNull(), F.greatest(c, F.lit(0).cast(c_type(f))))
        if f.name == "label":
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def c_type(field: T.StructField) -> T.DataType:
    return T.DoubleType() if isinstance(field.dataType, T.StringType) else field.dataType


def require_label(df: DataFrame) -> DataFrame:
    """Training rows: the 15 model columns and the label."""
    if "label" not in df.columns:
        raise ValueError("training data needs a label column")
    names = [c for c in MODEL_FEATURES if c in df.columns]
    return df.select(*names, F.col("label").cast("int").alias("label"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians (feature, median), nulls ignored.

    The two middle values are found digit by digit in the ordered images of the values: each pass counts
    the next digit among the rows that agree in all digits before, so a task holds at most the cells of
    one digit and no value list is ever sorted, whatever the distribution. Between passes at most two
    cells per feature reach the driver.
    """
    spark = df.sparkSession
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    values = with_ordered_bits(df.select(pairs.alias("p")).select("p.feature", "p.v").where("v IS NOT NULL"), "v")
    wanted, left, digits = None, sum(RADIX), iter(RADIX)
    whole = Window.partitionBy("feature", "prefix")
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    while left:
        above = left
        few = wanted is not None and max((r["n"] for r in rows), default=0) <= 1 << min(RADIX)
        left = 0 if few else left - next(digits)
        cell = F.shiftright("bits", left)
        if wanted is None:
            near = values.select("feature", F.lit(0).cast("bigint").alias("prefix"), cell.alias("cell"), "v")
        else:
            # Two cells per feature at most.
            cells = F.broadcast(wanted.select("feature", "prefix").distinct())
            near = values.withColumn("prefix", F.shiftright("bits", above)).join(cells, ["feature", "prefix"]).select(
                "feature", "prefix", cell.alias("cell"), "v"
            )
        # In the last pass a cell is one value.
        counted = near.groupBy("feature", "prefix", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).select(
            "*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total")
        )
        if wanted is None:
            # The two middle ranks, 1-based; equal for an odd count.
            ranked = counted.withColumn("rank", F.explode(F.array(F.expr("(total + 1) DIV 2"), F.expr("total DIV 2 + 1"))))
        else:
            ranked = counted.join(F.broadcast(wanted), ["feature", "prefix"])
        hit = ranked.where((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
        if left:
            rows = hit.select("feature", F.col("cell").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n").collect()
            wanted = spark.createDataFrame([r[:3] for r in rows], "feature string, prefix bigint, rank bigint")
    # Both ranks may fall on one value: two rows then.
    return hit.groupBy("feature").agg(F.avg("v").alias("median"))


def _as_row(long: DataFrame, columns: Sequence[str], value: str) -> Column:
    """One struct with a field per feature, as a scalar subquery."""
    picks = [F.max(F.when(F.col("feature") == c, F.col(value))).alias(c) for c in columns]
    return long.agg(*picks).select(F.struct(*columns).alias("s")).scalar()


def impute_median(df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    row = _as_row(fitted if fitted is not None else exact_medians(df, columns), columns, "median")
    filled = df.withColumn("__m", row)
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col("__m")[c]) for c in columns}
    ).drop("__m")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of struct columns (mean, std, min, max) per feature."""
    return df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"),
            ).alias(c)
            for c in columns
        ]
    )


def _with_fit(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("__f", fitted.select(F.struct(*columns).alias("s")).scalar())


def standardize(df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """Mean 0 and population deviation 1; a constant column is only centred."""
    rows = _with_fit(df, fitted if fitted is not None else fit_scaler(df, columns), columns)
    def scaled(c: str) -> Column:
        f = F.col("__f")[c]
        return (F.col(c) - f["mean"]) / F.when(f["std"] > 0, f["std"]).otherwise(1.0)
    return rows.withColumns({c: scaled(c) for c in columns}).drop("__f")


def normalize(
    df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Min-max to [lo, hi] of the fitted data; a constant column becomes ``lo``."""
    rows = _with_fit(df, fitted if fitted is not None else fit_scaler(df, columns), columns)
    def scaled(c: str) -> Column:
        f = F.col("__f")[c]
        span = f["hi"] - f["lo"]
        return (F.col(c) - f["lo"]) / F.when(span > 0, span).otherwise(1.0) * (hi - lo) + lo
    return rows.withColumns({c: scaled(c) for c in columns}).drop("__f")


def preprocess(df: DataFrame, columns: Sequence[str], fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Fits on first use, transforms with the fit afterwards; model-shaped rows pass unchanged."""
    if set(df.columns) - {"label", "id"} == set(MODEL_FEATURES) and fitted is None:
        return df, None
    fit = fitted if fitted is not None else fit_scaler(df, columns)
    return standardize(df, columns, fit), fit


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # Most frequent first, then the smallest value; one candidate per task survives.
    best = counts.orderBy(F.desc("n"), column).limit(1).select(column).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), best))


def one_hot(df: DataFrame, column: str, categories: Sequence) -> DataFrame:
    """One indicator per known category; unknown values are all zero."""
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in categories}
    ).drop(column)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class. Rows without a label are no class."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _taken(df: DataFrame, label: str, id_col: str, seed: int, quota: Column) -> DataFrame:
    whole = Window.partitionBy()
    counts = class_counts(df, label).withColumns(
        {
            "lo": F.min("n").over(whole), "hi": F.max("n").over(whole), "k": F.count(F.lit(1)).over(whole),
            "lo_class": F.min(F.struct("n", label)).over(whole)[label],
            "hi_class": F.max(F.struct(F.col("n"), F.col(label))).over(whole)[label],
        }
    )
    quotas = counts.select(label, quota.cast("bigint").alias("quota"))
    return hashed_head(df, [label], id_col, seed, quotas).where("taken").drop("taken")


def downsample_majority(
    df: DataFrame, id_col: str, label: str = "label", ratio: float = 5.0, seed: int = SEED
) -> DataFrame:
    """Cuts the largest class to the smallest class's size if it is over ``ratio`` times larger.

    Like all sampling here it looks at labelled rows only and returns only these; see ``unlabelled``.
    """
    cut = (F.col("k") > 1) & (F.col("hi") / F.col("lo") > ratio) & (F.col(label) == F.col("hi_class"))
    return _taken(df, label, id_col, seed, F.when(cut, F.col("lo")).otherwise(F.col("n")))


def unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    """The rows that sampling leaves aside because they have no label."""
    return df.where(F.col(label).isNull())


def undersample(df: DataFrame, id_col: str, label: str = "label", seed: int = SEED) -> DataFrame:
    return _taken(df, label, id_col, seed, F.col("lo"))


def oversample(df: DataFrame, id_col: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """Repeats every class up to the largest: whole copies plus a chosen remainder. Adds ``copy``."""
    counts = class_counts(df, label)
    top = counts.agg(F.max("n")).scalar()
    sized = counts.withColumn("top", top)
    quotas = sized.select(label, F.expr("top % n").alias("quota"))
    marked = hashed_head(df, [label], id_col, seed, quotas, "extra")
    repeats = sized.select(label, F.expr("top DIV n").alias("repeat"))
    times = F.col("repeat") + F.col("extra").cast("int")
    return join_small(marked, repeats, [label]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times))
    ).drop("extra", "repeat")


def stratified_split(
    df: DataFrame, id_col: str, label: str = "label", test_percent: int = 20, seed: int = SEED
) -> DataFrame:
    """Adds ``is_train``; the first rows of each class in hash order are the training part. Unlabelled rows are left aside."""
    quotas = class_counts(df, label).select(label, F.expr(f"n * {100 - test_percent} DIV 100").alias("quota"))
    return hashed_head(df, [label], id_col, seed, quotas, "is_train")


def random_split(df: DataFrame, id_col: str, percent: int = 80, seed: int = SEED) -> DataFrame:
    """Adds ``is_first`` for an unstratified share; the other rows are its complement."""
    quota = df.agg(F.expr(f"count(1) * {percent} DIV 100").alias("quota"))
    return hashed_head(df, [], id_col, seed, quota, "is_first")


def holdout(df: DataFrame, id_col: str, percent: int = 10, at_most: int = 1000, seed: int = SEED) -> DataFrame:
    """Adds ``is_holdout`` for the smaller of a share and a fixed number of rows."""
    quota = df.agg(F.expr(f"least(count(1) * {percent} DIV 100, {at_most})").alias("quota"))
    return hashed_head(df, [], id_col, seed, quota, "is_holdout")


def stratified_folds(
    df: DataFrame, id_col: str, label: str = "label", folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Adds ``fold`` 0..k-1, spread evenly over each class; rows without a label are spread as a class of their own."""
    numbered = hashed_row_number(df, [label], id_col, seed, "__rn")
    return numbered.withColumn("fold", ((F.col("__rn") - 1) % folds).cast("int")).drop("__rn")


def class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Balanced weight n / (classes * n_class) per labelled row; rows without a label have a null weight."""
    counts = class_counts(df, label)
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = counts.withColumn("__t", total).select(
        label, (F.col("__t")["n"] / (F.col("__t")["k"] * F.col("n"))).alias(name)
    )
    return join_small(df, weights, [label], "left")


def large_groups(df: DataFrame, key: str = "protocol", minimum: int = 100) -> DataFrame:
    """Rows of the groups that have at least ``minimum`` rows."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum).select(key)
    return join_small(df, enough, [key], "left_semi")


def deduplicate(df: DataFrame, subset: Sequence[str], id_col: str) -> DataFrame:
    """Keeps the row with the lowest id among equal rows; copies are dropped map-side."""
    rest = [c for c in df.columns if c not in subset and c != id_col]
    if not rest:
        return df.groupBy(*subset).agg(F.min(id_col).alias(id_col))
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(id_col, *rest), F.col(id_col)).alias("__r"))
    return kept.select(*subset, "__r.*")
