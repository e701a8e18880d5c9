"""Ordered images, medians, AUC and curves on distributions that crowd a fixed grid."""

import math
import random
import struct
from statistics import median

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import prep as H
from flowlens.operators.scale import radix_cells, with_ordered_bits


def image(x):
    """The bits of a double, folded so that they follow its order."""
    if math.isnan(x):
        return (1 << 63) - 1
    bits = struct.unpack(">Q", struct.pack(">d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_images_are_the_bits_of_the_double(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    xs += [s * math.ldexp(1.0, e) for e in range(-1074, 1024) for s in (1, -1)]
    xs += [math.nextafter(math.ldexp(1.0, e), d) for e in range(-1070, 1023, 7) for d in (0.0, math.inf)]
    xs += [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(63)))[0] for _ in range(20_000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x double")
    got = {r.i: r.b for r in with_ordered_bits(df, "x", "b").collect()}
    assert got.pop(len(xs)) is None
    wrong = [(xs[i], b, image(xs[i])) for i, b in got.items() if b != image(xs[i])]
    assert wrong == []


def feeds():
    rng = random.Random(7)
    return {
        "logits": [rng.gauss(0, 8) for _ in range(3001)],
        "tiny": [rng.random() * 1e-7 for _ in range(3000)],
        "epoch seconds": [1_705_000_000 + rng.random() * 100 for _ in range(3001)],
        "one value": [0.25] * 2000,
        "one octave and ties": [1 + rng.randrange(900) * 2.0**-52 for _ in range(3000)],
        "huge and small": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3001)],
    }


@pytest.mark.parametrize("name", list(feeds()))
def test_medians_of_any_distribution(spark, name):
    xs = feeds()[name]
    df = spark.createDataFrame([(x, None if i % 2 else x) for i, x in enumerate(xs)], "a double, b double")
    got = {r["feature"]: r["median"] for r in H.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": median(xs), "b": median(xs[::2])}


@pytest.mark.parametrize("name", list(feeds()))
def test_auc_and_curves_of_any_distribution(spark, name):
    rng = random.Random(3)
    xs = feeds()[name][:600]
    rows = [(x, int(rng.random() < 0.3 + 0.3 * (x > median(xs)))) for x in xs]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert M.auc(df).first()["auc"] == pytest.approx(won / len(pos) / len(neg), abs=1e-12)
    curve = {r.score: (r.tp, r.fp) for r in M.curve_counts(df).collect()}
    assert curve == {x: (sum(p >= x for p in pos), sum(n >= x for n in neg)) for x in set(xs)}


def test_no_cell_is_fuller_than_its_digit(spark):
    """A million neighbouring doubles: no middle cell holds more than 2^21 of them, and images split them."""
    df = spark.range(1 << 20).select((F.lit(1.0) + F.col("id") * 2.0**-52).alias("v"))
    imaged = with_ordered_bits(df, "v")
    assert imaged.select("bits").distinct().count() == 1 << 20
    assert imaged.groupBy(*radix_cells(F.col("bits"))).count().agg(F.max("count")).first()[0] <= 1 << 21


def test_medians_digit_by_digit(spark, monkeypatch):
    """With few cells a digit, every pass is gone through, also among neighbouring doubles."""
    monkeypatch.setattr(H, "RADIX", (12, *[4] * 13))
    xs = [1 + i * 2.0**-52 for i in range(101)] + [-5.0, 1e300]
    df = spark.createDataFrame([(x, -x) for x in xs], "a double, b double")
    assert {r["feature"]: r["median"] for r in H.exact_medians(df, ["a", "b"]).collect()} == {"a": median(xs), "b": -median(xs)}
