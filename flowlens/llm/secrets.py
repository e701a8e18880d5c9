"""Secret scans: three fixed patterns, and a battery of randomness tests for what no pattern names.

Only DataFrame functions are used. A long run of letters and digits is read in the alphabet it seems to
be encoded with. Four tests ask whether its symbols could be uniform draws: a test of pairs of equal symbols,
a runs test above and below the middle of the alphabet, the correlation of neighbours, and how frequent its
letters are in written language. Readable strings fail at least one of them. Rejections are controlled for false discovery among all
candidates of similar length, those of letters alone apart from others, for short strings can hardly be rejected; what is not rejected is reported.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import saved

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs cut off at their least length are the same as whole runs of which short ones are dropped.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

KINDS = ("assign", "access", "hex", "random")
LENGTHS = (20, 24, 32, 48)  # least length of each class of candidates
FEW_DIGITS = 2  # candidates with fewer digits or no letter are classes of their own
# Rough shares of letters in written European languages; uniform letters score low.
LETTERS = dict(zip("etainosrldhcumfpgwybvkxjqz", (
    .127, .091, .082, .075, .070, .067, .063, .060, .040, .043, .061, .028, .028, .024, .022, .019, .020, .024, .020, .015, .010, .008, .0015, .0015, .001, .0007)))
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "lower36": ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "upper36": ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "base62": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
}
SPAN = "array<struct<start:int,stop:int,kind:int,class:int,p:double>>"


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches of a pattern: start, stop (code points), the text of the match and of a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(found.alias("m"), inner.alias("g"), between.alias("b")), lambda x: F.struct(
        F.coalesce(F.length(x["b"]), F.lit(0)).alias("skip"), F.length(x["m"]).alias("size"), x["m"].alias("m"), x["g"].alias("g"),
    ))
    walked = F.aggregate(
        F.filter(steps, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int,m:string,g:string>>)").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["skip"] + x["size"]).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["skip"]).alias("start"), (a["at"] + x["skip"] + x["size"]).alias("stop"), x["m"].alias("m"), x["g"].alias("g"),
            ))).alias("out"),
        ),
        lambda a: a["out"],
    )
    none = F.expr("CAST(array() AS array<struct<start:int,stop:int,m:string,g:string>>)")
    return F.when(text.rlike(pattern), walked).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a published polynomial (error below 1e-7); at least 1e-300."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def _alphabet(body: Column) -> Column:
    *named, (_, rest) = ALPHABETS.values()
    out = F.lit(rest)
    for pattern, letters in reversed(named):
        out = F.when(body.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def randomness_p(token: Column) -> Column:
    """Smallest p-value of the battery, times the number of tests: small if ``token`` is not random.

    A token whose runs or correlation cannot be measured (all symbols on one side, or all equal) has the least, 1e-300.
    """
    logs = [math.log(x) for x in LETTERS.values()]
    usual, width = sum(logs) / len(logs), statistics.pstdev(logs)
    score = F.create_map(*[F.lit(x) for c, v in zip(LETTERS, logs) for x in (c, (v - usual) / width)])
    body = F.rtrim(token, F.lit("="))
    alphabet = _alphabet(body)
    symbols = F.split(body, "")
    state = F.transform(F.array(F.struct(body.alias("t"), alphabet.alias("a"), symbols.alias("s"))), lambda x: F.struct(
        F.size(x["s"]).cast("double").alias("n"), F.length(x["a"]).cast("double").alias("k"), x["t"].alias("t"), x["s"].alias("s"),
        F.transform(x["s"], lambda c: (F.instr(x["a"], c) - 1).cast("double")).alias("v"),
    ))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    pairs = lambda v: F.slice(F.arrays_zip(v.alias("x"), F.slice(v, 2, 1 << 30).alias("y")), 1, F.size(v) - 1)

    def measured(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        squares = total(F.transform(F.array_distinct(x["s"]), lambda c: F.pow(n - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0))))
        # Pairs of equal symbols are about Poisson; its tail by the cube root, for short strings have few.
        equal, expected = (squares - n) / 2, n * (n - 1) / (2 * k)
        z_counts = F.when(equal > 0, 3 * F.sqrt(equal) * (1 - 1 / (9 * equal) - F.pow(expected / equal, F.lit(1 / 3)))).otherwise(-9.0)
        scores = F.filter(F.transform(x["s"], lambda c: F.element_at(score, F.lower(c))), lambda v: v.isNotNull())
        z_usual = F.when((F.size(scores) > 0) & (k > 16), total(scores) / F.sqrt(F.size(scores).cast("double"))).otherwise(-9.0)
        sides = F.transform(v, lambda i: (i >= k / 2).cast("double"))
        ones = total(sides)
        mean_runs = 1 + 2 * ones * (n - ones) / n
        var_runs = 2 * ones * (n - ones) * (2 * ones * (n - ones) - n) / (n * n * (n - 1))
        runs = 1 + total(F.transform(pairs(sides), lambda p: (p["x"] != p["y"]).cast("double")))
        mean = total(v) / n
        spread = total(F.transform(v, lambda i: (i - mean) * (i - mean)))
        serial = total(F.transform(pairs(v), lambda p: (p["x"] - mean) * (p["y"] - mean)))
        p_counts = upper_tail(z_counts)
        p_runs = F.when(var_runs > 0, 2 * upper_tail(F.abs((runs - mean_runs) / F.sqrt(var_runs)))).otherwise(0.0)
        p_serial = F.when(spread > 0, 2 * upper_tail(F.abs((serial / spread + 1 / n) * F.sqrt(n)))).otherwise(0.0)
        return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 4 * F.least(p_counts, p_runs, p_serial, upper_tail(z_usual))))

    return F.element_at(F.transform(state, measured), 1)


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, ``base`` spans and ``candidates`` with their p-value and class of length.

    Candidates are all runs that do not lie in a base span as a whole. Null counts as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    span = lambda x, kind: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(0).alias("class"), F.lit(1.0).alias("p")
    )
    base = F.concat(
        F.transform(F.filter(_matches(text, ASSIGN, 0, 2), lambda x: F.length(x["g"]) >= 12), lambda x: span(x, 0)),
        F.transform(_matches(text, ACCESS, 1), lambda x: span(x, 1)),
        F.transform(_matches(text, HEX, 2), lambda x: span(x, 2)),
    )
    size = lambda x: x["stop"] - x["start"]
    mixed = lambda x: x["m"].rlike(f"([0-9].*){{{FEW_DIGITS}}}") & x["m"].rlike("[A-Za-z]")
    free = lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["stop"] <= b["stop"]))
    found = df.select(F.col(id_col), text.alias("__text"), F.array_sort(base).cast(SPAN).alias("base"), *more)
    runs = F.filter(_matches(F.col("__text"), CANDIDATE, 3), free)
    return found.withColumn(
        "candidates",
        F.transform(runs, lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(3).alias("kind"),
            sum([(size(x) >= n).cast("int") for n in LENGTHS[1:]], F.when(mixed(x), 0).otherwise(len(LENGTHS))).alias("class"), randomness_p(x["m"]).alias("p"),
        )).cast(SPAN),
    ).drop("__text")


STEPS = 8  # p-values are counted in steps of a factor 2^(1/8)


def thresholds(candidates: DataFrame, rate: float) -> dict[int, float]:
    """Largest rejected p-value of each class of length (Benjamini-Hochberg on counted p-values).

    At most 300 * log2(10) * STEPS + 1 counts for each of the eight classes reach the driver.
    """
    step = F.floor(-F.log2("c.p") * STEPS).cast("int")
    counts = (
        candidates.select(F.explode("candidates").alias("c")).groupBy(F.col("c.class").alias("class"), step.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("c.p").alias("p")).collect()
    )
    out: dict[int, float] = {}
    for kind in {r["class"] for r in counts}:
        rows = sorted((r for r in counts if r["class"] == kind), key=lambda r: -r["step"])
        total, seen = sum(r["n"] for r in rows), 0
        for r in rows:
            seen += r["n"]
            if r["p"] <= rate * seen / total:
                out[kind] = r["p"]
    return out


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, more: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: id, the columns in ``more`` and ``spans`` (start, stop, kind, class, p) by start, then kind.

    Positions are code points, ``stop`` exclusive; ``kind`` is an index of KINDS. Null and empty texts
    have no spans, repeated rows each have theirs. What was found is written to the shared folder once,
    since the false-discovery threshold needs the p-values of all candidates before any is judged.
    """
    found = saved(find_spans(df, id_col, text_col, more), "secrets")
    limits = thresholds(found, rate)
    random = F.filter("candidates", lambda c: ~_refuted(c, limits))
    return found.withColumn("spans", F.array_sort(F.concat("base", random))).drop("candidates", "base")


def _refuted(c: Column, limits: dict[int, float]) -> Column:
    """Whether uniformity is rejected for a candidate."""
    out = F.lit(False)
    for kind, limit in limits.items():
        out = out | ((c["class"] == kind) & (c["p"] <= limit))
    return out


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end`` with commas between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span, or run of overlapping ones, replaced by a mark. Null stays null."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, kept).otherwise(text)
