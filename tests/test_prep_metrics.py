"""Preparation and metrics on small and skewed tables."""

import hashlib
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import prep as H
from flowlens.operators.scale import join_small, running_totals, salted_join, salts_of


def order(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    """One class holds nine rows in ten."""
    rows = [(i, 1 if i % 10 == 0 else 0, float(i % 7)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, label int, x double")


def test_split_is_exact_and_complementary(labelled):
    rows = H.stratified_split(labelled, "id").collect()
    assert len(rows) == 500
    for label, n in ((0, 450), (1, 50)):
        ids = sorted((r.id for r in rows if r.label == label), key=order)
        assert {r.id for r in rows if r.label == label and r.is_train} == set(ids[: n * 80 // 100])


def test_balancing(labelled):
    down = Counter(r.label for r in H.downsample_majority(labelled, "id").collect())
    assert down == {0: 50, 1: 50}
    over = H.oversample(labelled.where("id < 493"), "id").collect()
    assert Counter(r.label for r in over) == {0: 443, 1: 443}
    assert max(Counter(r.id for r in over if r.label == 1).values()) == 9
    mild = labelled.where("label = 1 OR id < 100")
    assert H.downsample_majority(mild, "id").count() == mild.count()


def test_folds_cover_each_class_evenly(labelled):
    sizes = Counter((r.label, r.fold) for r in H.stratified_folds(labelled, "id").collect())
    assert set(sizes.values()) == {90, 10}


def test_holdout_quota(labelled):
    assert H.holdout(labelled, "id").where("is_holdout").count() == 50
    assert H.holdout(labelled, "id", at_most=7).where("is_holdout").count() == 7


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_median(spark, n):
    rnd = random.Random(n)
    xs = [rnd.choice([-5.0, 0.0, 0.25, 3e9, rnd.gauss(0, 100)]) for _ in range(n)]
    df = spark.createDataFrame([(x, None) for x in xs] + [(None, 1.0)], "a double, b double")
    got = {r.feature: r["median"] for r in H.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": pytest.approx(median(xs)), "b": 1.0}


def test_scalers_guard_constants(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, c double")
    assert [tuple(r) for r in H.standardize(df, ["a", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in H.normalize(df, ["a", "c"], lo=-1, hi=1).collect()] == [(-1.0, -1.0), (1.0, -1.0)]


def test_clean_decides_types_once(spark):
    df = spark.createDataFrame(
        [("1.1.1.1", "5", "x", -2.0, 1.0), ("2.2.2.2", None, "7", 3.0, 0.0)],
        "src_ip string, byte_count string, note string, flow_duration double, label double",
    )
    out = H.clean(df)
    assert out.columns == ["byte_count", "flow_duration", "label"]
    assert [tuple(r) for r in out.collect()] == [(5.0, 0.0, 1), (None, 3.0, 0)]


def test_deduplicate_keeps_lowest_id(spark):
    df = spark.createDataFrame([(i, "copy", i * 2) for i in range(50)] + [(99, "single", 0)], "id long, t string, v long")
    assert {tuple(r) for r in H.deduplicate(df, ["t"], "id").select("id", "t", "v").collect()} == {(0, "copy", 0), (99, "single", 0)}


def test_running_totals_over_chunks(spark):
    rnd = random.Random(3)
    rows = [(i % 2, rnd.randrange(100), i, rnd.randrange(10)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v long").withColumn("c", F.expr("t DIV 9"))
    got = {r.id: (r.s, r.n) for r in running_totals(df, ["k"], "c", ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    for k in (0, 1):
        total = 0
        for n, (_, _, i, v) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total += v
            assert got[i] == (total, n)


def test_small_and_salted_joins(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "id long, k string")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("unused", 3)], "k string, v int")
    want = {(r.id, r.k, r.v) for r in facts.join(dim, "k", "left").collect()}
    assert {(r.id, r.k, r.v) for r in salted_join(facts, dim, ["k"], "id", "left").collect()} == want
    for limit in (100, 1):
        assert {(r.id, r.k, r.v) for r in join_small(facts, dim, ["k"], "left", limit).collect()} == want


def pairs(spark, cells):
    rows = [(y, p) for (y, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "label int, pred int")


@pytest.mark.parametrize(
    "cells, accuracy, f1",
    [(((17, 0), (0, 5)), 1.0, 1.0), (((104, 3), (6, 5)), 0.9237, 0.5263), (((52, 4), (3, 2)), 0.8852, 0.3636)],
)
def test_published_matrices(spark, cells, accuracy, f1):
    counts = {(y, p): cells[y][p] for y in (0, 1) for p in (0, 1)}
    r = M.binary_metrics(pairs(spark, counts)).first()
    assert (r.accuracy, r.f1) == (pytest.approx(accuracy, abs=5e-5), pytest.approx(f1, abs=5e-5))


def test_auc_counts_ties_half(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), rnd.choice([0.1, 0.5, 0.5000001, 0.9, 2.0, -1.0])) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert M.auc(df).first()[0] == pytest.approx(want)
    assert M.auc(df.where("label = 1")).first()[0] == 0.0


def test_best_threshold_default(spark):
    none = spark.createDataFrame([(0, 0.3), (0, 0.9)], "label int, score double")
    assert M.best_threshold(none).first()[0] == 0.5
    some = spark.createDataFrame([(0, 0.3), (1, 0.62), (1, 0.9)], "label int, score double")
    assert M.best_threshold(some).first()[0] == 0.35


def test_hot_keys_are_measured_and_spread(spark):
    """A key with 40 % of the facts, some warm ones, null keys and many cold ones."""
    facts = spark.range(20_000).select(
        "id", F.when(F.col("id") % 5 < 2, "hot").when(F.col("id") % 50 == 3, "warm").when(F.col("id") % 50 == 4, None)
        .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
    )
    dim = facts.select("k").distinct().withColumn("v", F.length("k")).where("k IS NULL OR k <> 'k9'")
    salts = {r.k: r.salts for r in facts.withColumn("salts", salts_of(facts, ["k"])).select("k", "salts").distinct().collect()}
    assert 102 <= salts["hot"] <= 105 and 5 <= salts["warm"] <= 7 and 5 <= salts[None] <= 7
    assert set(v for k, v in salts.items() if k not in ("hot", "warm", None)) == {1}
    pieces = facts.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(salts["hot"]))).count()
    assert pieces.agg(F.max("count")).first()[0] < 150
    for how in ("inner", "left"):
        want = sorted(map(str, facts.join(dim, ["k"], how).select("id", "k", "v").collect()))
        assert sorted(map(str, salted_join(facts, dim, ["k"], "id", how).select("id", "k", "v").collect())) == want
    assert salted_join(facts.limit(0), dim, ["k"], "id", "left").count() == 0
