"""Hashes of texts that are built to collide, even ranges, and masks that meet every pair that may count."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import arrays, decontaminate, shingle_join, suffixes


def thue_morse(bits, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(1 << bits))


def test_hashes_modulo_a_prime():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    sums = arrays.prefix_hashes(data)
    for i in (0, 1, 7, 5000):
        assert int(sums[i]) == sum((int(b) + 1) * pow(arrays.BASE, j, arrays.PRIME) for j, b in enumerate(data[:i])) % arrays.PRIME
    twice = np.concatenate([data, data])
    sums = arrays.prefix_hashes(twice)
    starts = r.integers(0, 4000, 300)
    ends = starts + r.integers(0, 1000, 300)
    assert (arrays.window(sums, starts, ends) == arrays.window(sums, starts + 5000, ends + 5000)).all()
    a, b = (r.integers(0, arrays.PRIME, 500, dtype=np.uint64) for _ in range(2))
    assert [int(x) for x in arrays.product(a, b)] == [int(x) * int(y) % arrays.PRIME for x, y in zip(a, b)]


def test_words_are_hashed_without_sums_over_whole_texts(monkeypatch):
    """Short words go by tables of what a byte adds at its place; sums are taken over the bytes of long words alone."""
    r = random.Random(3)
    words = ["".join(r.choices("abcXYZ\u00e9\u4e2d", k=r.randint(1, 12))) for _ in range(2000)]
    long = ["A" * 33, "b" * 32 + "C", "q" * 5000, "\u00fc" * 17]  # of 33, 33, 5000 and 34 bytes
    texts = pa.array([" ".join(words[:900]), None, "", " ".join([*long, "a" * 32, "A" * 31, *words[900:]]), "Ab", " "])
    data, borders = arrays.flat(texts)
    starts, ends, _ = arrays.words(data, borders, arrays.NOT_SPACE)
    want = arrays.window(arrays.prefix_hashes(arrays.LOWER[data]), starts, ends)
    summed = []
    plain = arrays.prefix_hashes
    monkeypatch.setattr(arrays, "prefix_hashes", lambda x: summed.append(len(x)) or plain(x))
    assert (arrays.word_hashes(data, starts, ends) == want).all()
    assert summed == [33 + 33 + 5000 + 34]
    none = np.zeros(0, np.int64)
    assert len(arrays.word_hashes(data, none, none)) == 0


def test_sets_are_sorted_distinct_and_named_alike():
    """A set is the same whatever else its batch holds, and equal sets have one name."""
    texts = ["a b c d e a b c d e a b c d e", "", "x y", "A B C D E A B C D E", None, "a b c d e a b c d e"]
    sets = shingle_join.gram_sets(pa.array(texts))
    assert [len(s) for s in sets] == [5, 0, 1, 5, 0, 5]
    assert all((np.unique(s) == s).all() for s in sets)
    names = shingle_join.class_names(sets)
    assert names[1] is None and names[4] is None and names[0] == names[3] == names[5] != names[2]
    assert [shingle_join.class_names([s])[0] for s in sets] == names and shingle_join.class_names([]) == []


@pytest.mark.parametrize("bits", [8, 9, 10, 11, 12])
def test_texts_in_the_order_of_thue_and_morse(bits):
    pair = [thue_morse(bits), thue_morse(bits, "b", "a")]
    for texts in (pair, [f"one two {x} three four five six" for x in pair], [thue_morse(bits, "the cat ", "the dog "), thue_morse(bits, "the dog ", "the cat ")]):
        data, borders = arrays.flat(pa.array(texts))
        sums = arrays.prefix_hashes(data)
        one, two = arrays.window(sums, borders[:-1], borders[1:])
        assert one != two
    one, two = shingle_join.gram_sets(pa.array([f"a b c {x} d e f" for x in pair]))
    assert not set(one.tolist()) & set(two.tolist()) or len(one) > 5


def some_text(n, seed):
    r = random.Random(seed)
    return "".join(r.choices("abcdefgh ", k=n))


@pytest.mark.parametrize("n", [5, 50, 500])
def test_ranges_are_even(n):
    """Neither anchors, which have least hashes, nor prefixes, which hold the least grams, crowd into few ranges."""
    texts = pa.array([some_text(60_000, s) for s in range(30)])
    _, gram, *_ = suffixes.anchors_of(*arrays.flat(texts), 400)
    held = np.bincount(((gram.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64), minlength=n)
    assert len(gram) > 10_000 and held.max() <= 2 * held.mean() + 20
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    hot = shingle_join.hot_map([])
    held = np.zeros(n)
    for out in shingle_join.prefixes(iter([batch]), hot, n):
        for row in out.to_pylist():
            held[row["bucket"]] += len(row["grams"]) // 8
    assert held.sum() > 40_000 and held.max() <= 2 * held.mean() + 20


@pytest.mark.parametrize("agreement", [0.6, 0.7, 0.8])
def test_masks_meet_every_pair(agreement):
    """Whatever words are replaced: some mask keeps equal words only."""
    known = decontaminate.masks(agreement)
    for n in range(decontaminate.LEAST_ITEM, decontaminate.STRETCH):
        for equal in itertools.combinations(range(n), decontaminate.needed(n, agreement)):
            assert any(low <= n <= high and all(o + s in equal for o in m) for m, (low, high) in known.items() for s in range(n))
    r = random.Random(2)
    for _ in range(2000):
        n = r.randint(decontaminate.STRETCH, 40)
        equal = set(r.sample(range(n), -int(-agreement * n // 1)))
        assert any(high > 100 and all(o + s in equal for o in m) for m, (low, high) in known.items() for s in range(n))


def test_items_and_texts_joined_by_shuffling(spark, monkeypatch):
    """Beyond the bound of the broadcast only hashes and places travel; results are the same. Items of 15 to 30 words, one to three in ten replaced."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(r.randint(15, 30)))) for i in range(40)] + [(99, "seven short words"), (98, "pair here")]
    docs, want = [], set()
    for j, (i, text) in enumerate(items * 3):
        w = text.split()
        gone = set(r.sample(range(len(w)), int(len(w) * r.choice([0.1, 0.2, 0.3])))) if i < 90 else set()
        copy = [word() if k in gone else x for k, x in enumerate(w)]
        docs.append((j, " ".join([*[word() for _ in range(30)], *copy, *[word() for _ in range(30)]])))
        want.add((j, i))
    docs += [(1000 + j, " ".join(word() for _ in range(80))) for j in range(30)] + [(None, items[0][1]), (2000, None), (2001, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sent = {tuple(x) for x in decontaminate.contaminated(df, bench).collect()}
    assert {(d, i) for d, i, *_ in sent} == want  # every planted pair, no other
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert {tuple(x) for x in decontaminate.contaminated(df, bench).collect()} == sent


def test_links_come_from_opened_groups(spark, monkeypatch):
    """What connects similar documents are links of the matrix, in many buckets as in one; frequent lines change nothing."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    line = " ".join(word() for _ in range(30))
    rows = []
    for c in range(30):
        base = [word() for _ in range(200)]
        for i in range(r.choice([1, 2, 12, 40])):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(200)] = word()
            rows.append((len(rows), " ".join([*copy, line] if c % 2 else copy)))
    import brute

    want = brute.similar_components(rows)
    links = []
    real = shingle_join.opened

    def counted(*args):
        out = shingle_join.saved(real(*args), "counted")
        links.append(out.count())
        return out

    monkeypatch.setattr(shingle_join, "opened", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for bucket in (1_000_000, 300):
        monkeypatch.setattr(shingle_join, "BUCKET", bucket)
        links.clear()
        got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in shingle_join.join_similar(df).collect())
        assert got == want
        joined = len(want) - len({c for _, _, c in want})
        assert links[0] > joined / 2 and sum(links) >= joined - sum(t == u for (_, t), (_, u) in zip(rows, rows[1:]))


def test_pieces_of_a_text_share_its_positions_out(spark, monkeypatch):
    """Each position belongs to one piece, which has the words within reach of it and no more than that."""
    monkeypatch.setattr(decontaminate, "PIECE", (3, 7))
    sizes = [0, 1, 6, 7, 8, 50]
    df = spark.createDataFrame([(n, [f"w{i}" for i in range(n)]) for n in sizes] + [(None, None)], "n int, words array<string>")
    for reach, step in ((5, 7), (1 << 15, 3)):
        got = {r["n"]: r["cut"] or [] for r in df.select("n", decontaminate.pieces(F.col("words"), reach).alias("cut")).collect()}
        assert got.pop(None) == []
        for n, cut in got.items():
            assert [w for p in cut for w in p["words"][p["first"] : p["end"]]] == [f"w{i}" for i in range(n)]
            for p in cut:
                own = int(p["words"][p["first"]][1:]), int(p["words"][p["end"] - 1][1:]) + 1
                assert own[1] - own[0] <= step
                assert p["words"] == [f"w{i}" for i in range(max(0, own[0] - reach), min(n, own[0] + step + reach))]


def test_seed_join_holds_a_piece_and_no_item(spark, monkeypatch):
    """Hits of a text are not gathered with all its words each, nor is an item sent along with each of its seeds; parts and pieces change no row."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    items = [(i % 9, " ".join(word() for _ in range(r.choice([2, 3, 5, 9, 12, 30, 70])))) for i in range(12)] + [(None, " ".join(word() for _ in range(20))), (50, "one"), (51, None)]
    known = [t for _, t in items if t and len(t.split()) > 1]
    docs = [(j, " ".join(" ".join(r.choice(known).split()[r.choice([0, 0, 4]):]) + " " + word() for _ in range(40))) for j in range(4)]
    docs += [(10 + j, " ".join(w if r.random() < 0.85 else word() for w in t.split())) for j, t in enumerate(known)] + [(30, None), (31, ""), (32, word())]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(df, bench)
    whole = sorted(map(str, found.collect()))
    assert len(whole) > 40 and any("item_id=None" in x for x in whole)
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    inside = lambda line: line.split("Generate")[0].rstrip().endswith(")")  # noqa: E731 - marked *(n): part of generated code
    opened = [line for line in lines if "Generate" in line]
    assert [inside(line) for line in opened] == [False, True, True, False], opened  # places, seeds, positions, pieces
    sent = [i for i, line in enumerate(lines) if "BroadcastExchange" in line]
    assert "places" in lines[sent[0] + 1] and "item#" not in lines[sent[0] + 1]
    monkeypatch.setattr(decontaminate, "PIECE", (3, 3))
    assert sorted(map(str, decontaminate.contaminated(df, bench).collect())) == whole
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "PART_SEEDS", 400)
    assert sorted(map(str, decontaminate.contaminated(df, bench).collect())) == whole
