"""Metrics over predictions. Counting comes first: every curve works on distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scale import chunk_totals, radix_cells, with_ordered_bits

# The swept thresholds, 0.10 to 0.85 in steps of 0.05.
THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(16)]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def confusion_counts(label: str | Column = "label", pred: str | Column = "pred") -> list[Column]:
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(pred) if isinstance(pred, str) else pred
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    return [F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in cells.items()]


def binary_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and support, overall or per key."""
    counted = df.groupBy(*keys).agg(*confusion_counts())
    return counted.select(
        *keys, "tp", "fp", "tn", "fn",
        precision().alias("precision"), recall().alias("recall"), f1().alias("f1"),
        accuracy().alias("accuracy"),
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("support"),
    )


def confusion_matrix(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(label, pred, count, share of the label) with every cell of the given classes."""
    names = F.array(*[F.lit(c) for c in classes])
    cells = df.sparkSession.range(1).select(F.explode(names).alias("label")).withColumn("pred", F.explode(names))
    counts = df.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(counts, ["label", "pred"], "left").fillna(0, ["n"])
    of_label = F.sum("n").over(Window.partitionBy("label"))
    return full.withColumn("share", ratio(F.col("n"), of_label))


def classification_report(df: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then the macro and weighted means."""
    cells = df.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(f"{c}_n"))
    hits = cells.where("label = pred").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    per_class = (
        side("label").join(side("pred"), "class", "full").join(hits, "class", "left")
        .fillna(0, ["label_n", "pred_n", "tp"])
        .select(
            F.col("class").cast("string").alias("class"),
            ratio(F.col("tp"), F.col("pred_n")).alias("precision"),
            ratio(F.col("tp"), F.col("label_n")).alias("recall"),
            ratio(2 * F.col("tp"), F.col("label_n") + F.col("pred_n")).alias("f1"),
            F.col("label_n").alias("support"),
        )
    )
    names = ["precision", "recall", "f1"]
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def score_counts(df: DataFrame, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Positives and negatives per distinct score, with the coarse and the middle cell of the score."""
    counts = df.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    coarse, middle = radix_cells(F.col("bits"))
    imaged = with_ordered_bits(counts, -F.col("score") if descending else F.col("score"))
    return imaged.withColumns({"coarse": coarse, "middle": middle}).drop("bits")


def auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC with ties counted half; 0 if only one class is present.

    Pairs of distinct scores are counted inside the middle cells, then between the middle cells of a coarse
    one, then between the coarse ones. Scores may have any range and any distribution.
    """
    counts = score_counts(df, keys).withColumn("won", F.col("pos").cast("double") * F.col("neg") / 2)
    for cells, order in ((["coarse", "middle"], "score"), (["coarse"], "middle"), ([], "coarse")):
        lower = Window.partitionBy(*keys, *cells).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
        counts = counts.withColumn("won", F.col("won") + below).groupBy(*keys, *cells).agg(
            *[F.sum(c).alias(c) for c in ("won", "pos", "neg")]
        )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return counts.select(*keys, F.when(pairs > 0, F.col("won") / pairs).otherwise(0.0).alias("auc"))


def curve_counts(df: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives scored at least as high, and the totals."""
    counts = score_counts(df, descending=True)
    inside = Window.partitionBy("coarse", "middle").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = {"pos": F.col("pos"), "neg": F.col("neg")}
    cells = counts.groupBy("coarse", "middle").agg(*[F.sum(n).alias(n) for n in sums])
    of_middle = chunk_totals(cells, ["coarse"], "middle", {f"{n}_middle": c for n, c in sums.items()})
    of_coarse = chunk_totals(cells, [], "coarse", {f"{n}_coarse": c for n, c in sums.items()})
    carried = of_middle.join(of_coarse, "coarse")
    local = counts.withColumns({"tp_in": F.sum("pos").over(inside), "fp_in": F.sum("neg").over(inside)})
    total = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return local.join(carried, ["coarse", "middle"]).select(
        "score", "pos", "neg",
        (F.col("tp_in") + F.col("pos_middle") + F.col("pos_coarse")).alias("tp"),
        (F.col("fp_in") + F.col("neg_middle") + F.col("neg_coarse")).alias("fp"),
        total.alias("total"),
    ).select("score", "pos", "neg", "tp", "fp", "total.*")


def roc_curve(df: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    return curve_counts(df).select(
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at every distinct threshold, with the recall gained there."""
    return curve_counts(df).select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
        ratio(F.col("pos"), F.col("p")).alias("gained"),
    )


def average_precision(df: DataFrame) -> DataFrame:
    return pr_curve(df).agg(F.sum(F.col("precision") * F.col("gained")).alias("average_precision"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts and F1 at each threshold, from one pass.

    A row is counted once, under the number of thresholds it reaches; a threshold's positives
    are the counts at its index and above. Rows are never copied per threshold.
    """
    reached = sum((F.col("score") >= t).cast("int") for t in thresholds)
    steps = df.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    per_step = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds, 1)])
    )
    hit = F.col("reached") >= F.col("i")
    counted = steps.withColumn("t", per_step).select("reached", "pos", "neg", "t.*").groupBy("i", "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return counted.select("i", "threshold", "tp", "fp", "tn", "fn", f1().alias("f1"))


def best_threshold(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, default: float = 0.5) -> DataFrame:
    """First threshold with the highest F1; the default if no F1 is above 0."""
    swept = threshold_sweep(df, thresholds)
    best = swept.agg(F.max(F.struct("f1", -F.col("i"), "threshold")).alias("b"))
    return best.select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(default)).alias("threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1"),
    )


def rank_models(metrics: DataFrame, name: str = "model_type") -> DataFrame:
    """Models by falling F1; the table has one row per model."""
    w = Window.partitionBy().orderBy(F.desc("f1"), name)
    return metrics.withColumn("rank", F.row_number().over(w))


def importance_ranking(importances: DataFrame, top: int | None = None) -> DataFrame:
    """Average importance per feature, highest first."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    ordered = mean.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered


def metrics_wide(long: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    return long.groupBy(row).pivot(column, list(names)).agg(F.first(value))


def metrics_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(names), "metric", "value")


def improvements(reports: DataFrame, model: str | list[str] = "model_type") -> DataFrame:
    """F1 gain of each report over the model's previous one. Reports are one row per training run."""
    w = Window.partitionBy(model).orderBy("ts_us")
    return reports.withColumn("gain", F.col("f1") - F.lag("f1").over(w))
