"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A *mask* keeps some of the words under it and ignores the others; the hash of the kept ones is a *seed*. A
copy that keeps 70 % of an item's words keeps five of some seven neighbouring words, wherever the others
were replaced, and a fixed family of masks of four words is chosen such that one of them keeps equal words
only in each of these cases, and in those of shorter items. So every such pair shares a seed: seeds of
items and texts are joined, and item and text are compared word by word along the line on which they meet.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import saved

STRETCH = 12  # words: overlaps of at least so many are judged, and whole items below
FLOOR = 4  # equal words asked of an item that has as many; shorter ones must be whole
LEAST_ITEM = 2  # a single word is no passage
WEIGHT = 4  # words that a mask keeps
WIDEST = 7  # words in a row that a mask is laid on in a long item
NOT_WORD = "[^\\p{L}\\p{N}]+"
BROADCAST_SEEDS = 500_000  # seeds of items that are sent to all tasks at once; more of them are taken in parts
PART_SEEDS = 500_000  # seeds of such a part
PIECE = (16, 256)  # positions of a text that are looked up together, fewer where items are long
PIECE_WORDS = 1 << 16  # positions of a piece times words of the longest item


def words_of(text: Column) -> Column:
    """Lower-case words; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def window(agreement: float, shortest: int = STRETCH, widest: int = WIDEST) -> tuple[int, int]:
    """Sizes (w, k): any ``shortest`` words or more of which a share of ``agreement`` is equal have k equal ones in some w in a row.

    Were there k - 1 at most in each, q stretches of w words and r words more had at most q * (k - 1) + min(r, k - 1).
    If that stays short for w lengths in a row, it does for all longer ones.
    """
    fits = [
        (w, k) for w in range(1, widest + 1) for k in range(1, w + 1)
        if k - 1 <= agreement * w and all(n // w * (k - 1) + min(n % w, k - 1) < agreement * n for n in range(shortest, shortest + w))
    ]
    return max(fits, key=lambda f: (f[1], -f[0]))


def needed(n: int, agreement: float) -> int:
    """Equal words asked of an item of ``n`` words, fewer than STRETCH, which has to stand in the text as a whole."""
    return max(math.ceil(agreement * n - 1e-9), min(n, FLOOR))


def cover(needs: list[tuple[int, int]], weight: int = WEIGHT) -> list[tuple[int, ...]]:
    """Fixed masks, as the places they keep: whichever k of n words are equal, for each (n, k) of ``needs`` some mask keeps equal ones only.

    Greedy: the mask that serves most of what is left comes next.
    """
    left = [(set(equal), n) for n, k in needs for equal in itertools.combinations(range(n), k)]
    fits = lambda mask, equal, n: any(all(o + s in equal for o in mask) for s in range(n - mask[-1]))
    widest = max((n for n, _ in needs), default=0)
    known = [(0, *rest) for rest in itertools.combinations(range(1, widest), weight - 1)]
    chosen: list[tuple[int, ...]] = []
    while left:
        served = {m: sum(fits(m, *x) for x in left) for m in known}
        best = min(known, key=lambda m: (-served[m], m[-1], m))
        chosen.append(best)
        left = [x for x in left if not fits(best, *x)]
    return chosen


@lru_cache(maxsize=8)
def masks(agreement: float) -> dict[tuple[int, ...], tuple[int, int]]:
    """The masks, each with the least and largest number of words of items that it is laid on.

    Together they meet every pair that may count. Items of fewer than WEIGHT words have one mask that keeps them whole.
    """
    short = [(n, needed(n, agreement)) for n in range(LEAST_ITEM, STRETCH)]
    out: dict[tuple[int, ...], tuple[int, int]] = {}
    for weight in sorted({min(k, WEIGHT) for _, k in [*short, window(agreement)]}):
        needs = [x for x in [*short, window(agreement)] if min(x[1], WEIGHT) == weight]
        long = window(agreement) in needs
        for mask in cover(needs, weight):
            out[mask] = (max(min(n for n, _ in needs), mask[-1] + 1), 1 << 30 if long else max(n for n, _ in needs))
    return out


def seeds(words: Column, at: Column, used: list[tuple[int, ...]], agreement: float, items: bool = False) -> Column:
    """Hashes of the words that each mask keeps when it begins at a place; null where it does not fit."""
    known = masks(agreement)
    out = []
    for number, mask in enumerate(known):
        if mask in used:
            fits = at + mask[-1] < F.size(words)
            if items:
                fits &= F.size(words).between(*known[mask])
            out.append(F.when(fits, F.xxhash64(F.lit(number), *[F.get(words, at + o) for o in mask])))
    return F.array(*out)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", agreement: float = 0.7,
) -> DataFrame:
    """One row per text and item that overlap: id, item id, n_agree, n_aligned, item_words.

    An item may be lined up with a text at any place where STRETCH of its words or, if it has fewer, all of them
    stand against words of the text; ``n_agree`` of these ``n_aligned`` words are equal. The pair counts if on
    some line at least ``agreement`` of the words are equal, either of all or of some STRETCH in a row with half
    as many on either side, as far as there are any. Every such pair is found. An item under STRETCH words needs
    FLOOR equal words besides, or all of its words if it has fewer; an item under LEAST_ITEM words is not looked
    for. The line with most equal words is reported. Texts without a match, null or empty ones, and null ids
    have no row; rows that share an id are judged together. Every position of every text is looked up.
    """
    items = saved(
        benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("item")).where(F.size("item") >= LEAST_ITEM)
        .withColumn("item_no", F.monotonically_increasing_id()),  # ids may be null or repeat
        "items",
    )
    sizes = [r[0] for r in items.select(F.least(F.size("item"), F.lit(STRETCH))).distinct().collect()]  # at most STRETCH numbers
    used = [m for m, (low, high) in masks(agreement).items() if any(low <= n <= high for n in sizes)] or [*masks(agreement)][:1]
    found = saved(
        items.select("item_no", "item", F.posexplode("item").alias("at", "word"))
        .select("item_no", "at", F.explode(seeds(F.col("item"), F.col("at"), used, agreement, items=True)).alias("word_seed")).where("word_seed IS NOT NULL"),
        "seeds",
    )
    reach = max(STRETCH, items.select(F.max(F.size("item"))).first()[0] or 0)
    texts = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).where("id IS NOT NULL")
    n = found.count()
    if n <= BROADCAST_SEEDS:
        best = best_lines(texts, items, found, used, reach, agreement)
    else:  # a pass over the texts for each part of the items, so that no task ever holds more than a part
        parts = -(-n // PART_SEEDS)
        of_part = lambda df, k: df.where(F.pmod(F.xxhash64("item_no"), F.lit(parts)) == k)
        judged = [
            saved(best_lines(texts, of_part(items, k), of_part(found, k), used, reach, agreement).where("b.enough"), "judged") for k in range(parts)
        ]
        best = reduce(DataFrame.unionByName, judged).groupBy("id", "item_id").agg(F.max("b").alias("b"))
    return best.where("b.enough").select(F.col("id").alias(id_col), "item_id", "b.n_agree", "b.n_aligned", "b.item_words")


def pieces(words: Column, reach: int) -> Column:
    """Cuts an array of words: positions from ``first`` on and before ``end`` of each piece are its own, ``reach`` words on either side only stand by."""
    step = min(PIECE[1], max(PIECE[0], PIECE_WORDS // reach))
    n = F.size(words)

    def piece(at: Column) -> Column:
        low, high = F.greatest(at - reach, F.lit(0)), F.least(at + step + reach, n)
        return F.struct(F.slice(words, low + 1, high - low).alias("words"), (at - low).alias("first"), (F.least(at + step, n) - low).alias("end"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), piece))


def best_lines(texts: DataFrame, items: DataFrame, found: DataFrame, used: list[tuple[int, ...]], reach: int, agreement: float) -> DataFrame:
    """The best line of each text and item that share a seed: id, item_id, b. Items have ``reach`` words at most.

    Generated code holds all rows that come of one row before it hands them on, each with the words it goes with.
    So texts are cut into pieces first, and a seed meets one row with its places in the items. Both are opened
    outside of generated code (as are all lambdas), one row at a time: a task holds the hits of one piece, however
    long a text is and however many items share a seed. Opened as outer: else what is opened is made twice, for a
    filter on its number.
    """
    cut = texts.select("id", F.explode_outer(pieces(F.col("words"), reach)).alias("piece"))
    placed = cut.select("id", F.col("piece.words").alias("words"), F.explode_outer(F.sequence("piece.first", F.col("piece.end") - 1)).alias("p"))
    sown = placed.select("id", "words", "p", F.explode(seeds(F.col("words"), F.col("p"), used, agreement)).alias("word_seed"))
    known = found.groupBy("word_seed").agg(F.collect_list(F.struct("item_no", "at")).alias("places"))
    met = sown.join(F.broadcast(known), "word_seed").select(
        "id", "words", F.explode_outer(F.transform("places", lambda x: F.struct(x["item_no"], (F.col("p") - x["at"]).alias("shift")))).alias("line")
    )
    hits = met.select("id", "words", "line.*").join(F.broadcast(items), "item_no")
    agree = lambda low, high: F.aggregate(
        F.sequence(low, high - 1), F.lit(0),
        lambda n, i: n + (F.get("item", i.cast("int")) == F.get("words", (i + F.col("shift")).cast("int"))).cast("int"),
    )
    low = F.greatest(F.lit(0), -F.col("shift")).cast("int")
    high = F.least(F.size("item"), F.size("words") - F.col("shift")).cast("int")
    half = STRETCH // 2

    def some_part(x: Column) -> Column:
        begin = lambda s: F.greatest(x["low"], s - half)
        end = lambda s: F.least(x["high"], s + STRETCH + half)
        return F.exists(F.sequence(x["low"], x["high"] - STRETCH), lambda s: agree(begin(s), end(s)) >= agreement * (end(s) - begin(s)))

    def verdict(x: Column) -> Column:
        n = F.size("item")
        return F.when(x["high"] - x["low"] < F.least(n, F.lit(STRETCH)), False).when(
            x["agree"] >= agreement * (x["high"] - x["low"]), (n >= STRETCH) | (x["agree"] >= F.least(n, F.lit(FLOOR)))
        ).when(n < STRETCH, False).otherwise(some_part(x))

    line = F.struct(low.alias("low"), high.alias("high"), agree(low, high).alias("agree"))
    told = hits.select("id", "item_id", F.element_at(F.transform(F.array(line), lambda x: F.struct(
        verdict(x).alias("enough"), x["agree"].alias("n_agree"), (x["high"] - x["low"]).alias("n_aligned"), F.size("item").alias("item_words"),
    )), 1).alias("t"))
    # Judged after grouping: a filter here would become part of the join and take it out of generated code.
    return told.groupBy("id", "item_id").agg(F.max("t").alias("b"))
