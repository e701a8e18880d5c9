"""Manifest, exact search and whitening against plain readings, on odd rows, hot groups and empty tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import manifest, nearest, queries, whitening

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# manifest


def plain_leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The digest of a tree and, for each leaf, the (before, after) of its levels."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 16 * 16
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 16])))
            at[i] = p // 16
        level = ["".join(level[i : i + 16]) for i in range(0, len(level), 16)]
        level = [H(x) for x in level]
    return level[0], paths


def plain_manifest(rows):
    """Sorted results of (doc_id, source, lang, n_chars, text) rows."""
    low = {c: c + 32 for c in range(65, 91)}
    trees = defaultdict(list)
    for r in rows:
        altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        other = plain_leaf([*r[:4], r[4] and r[4].translate(low)]) if altered else None
        trees[(r[1] is not None, (r[1] or "").encode())].append(((r[0] is not None, r[0] or 0, plain_leaf(r)), r[0], other))
    subs = {g: plain_tree([x[0][2] for x in sorted(t, key=lambda x: x[0])]) for g, t in trees.items()}
    root, above = plain_tree([subs[g][0] for g in sorted(subs)])
    out = []
    for g, up in zip(sorted(subs), above):
        for (key, i, other), path in zip(sorted(trees[g], key=lambda x: x[0]), subs[g][1]):
            h = other or key[2]
            for before, after in path + up:
                h = H(before + h + after)
            out.append((i, key[2], subs[g][0], root, H("".join(b + a for b, a in path + up)), h, h == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, path int, tree int, pos int, n int, block int"


def documents(spark, rows, parts=7):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, 5) for r in rows], DOCS).repartition(parts)


def run_manifest(docs):
    columns = queries.MANIFEST_COLUMNS
    lower = F.translate("text", manifest.UPPER, manifest.UPPER.lower())
    found = manifest.manifest(
        docs, columns, altered=[lower if c == "text" else F.col(c) for c in columns], is_altered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )
    told = found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), manifest.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("f"),
    ).withColumn("v", F.col("f") == F.col("root"))
    return sorted((tuple(r) for r in told.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [
        (1, "b", "en", 3, "ABC"), (2, "b", None, None, None), (None, "b", "en", 0, ""), (None, None, None, None, None), (None, None, None, None, None), (3, "", "en", 1, "É漢😀 Z"),
        (-5, "a", "en", 2, "xY"), (7, "a", "en", 2, "same"), (7, "a", "en", 2, "same"), (7, "a", "en", 2, "Other"), (9, "é", "en", 2, "Long " * 50_000), (11, "Ab", "en", 1, "Z"),
    ]
    assert run_manifest(documents(spark, rows)) == plain_manifest(rows)
    one = [(4, "only", "en", 1, "Lone Leaf")]
    assert run_manifest(documents(spark, one)) == plain_manifest(one)
    assert run_manifest(documents(spark, rows).limit(0)) == []


@pytest.mark.parametrize("n", [255, 256, 257, 272, 4096, 4097, 4400, 9000])
def test_manifest_of_many_sizes(spark, n):
    """Sizes around full subtrees, so that ragged last subtrees of several rounds are met; half of the rows in one source."""
    rows = [(i, "hot" if i < n else f"s{i % 19}", "en", i % 7, f"Text {i}") for i in range(n + n // 2)]
    assert run_manifest(documents(spark, rows)) == plain_manifest(rows)


def test_manifest_of_equal_rows(spark):
    """A third of all rows is one and the same."""
    rows = [(5, "s", "en", 1, "Copy")] * 700 + [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(1400)]
    assert run_manifest(documents(spark, rows)) == plain_manifest(rows)


def test_manifest_query(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf}/documents.parquet'").fetchall()
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf)
    want = duckdb.sql(queries.MANIFEST_SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows) == sorted(want.fetchall(), key=str)
    assert got.columns == want.columns


def test_round_of_the_butterfly_keeps_groups_small(spark):
    """No block meets more than FANOUT others, and ragged partners are spread over the blocks that stand in."""
    blocks = 16 * 16 + 16 + 3
    state = spark.createDataFrame([("t", i, blocks, H(str(i))) for i in range(blocks)], "tree string, block long, blocks long, root string")
    got = manifest.butterfly(state).collect()
    root, paths = plain_tree([H(str(i)) for i in range(blocks)])
    assert {r["root"] for r in got} == {root}
    assert {r["block"]: [tuple(p) for p in r["path"]] for r in got} == dict(enumerate(paths))


# search


def plain_top(rows, every, k):
    ok = [(i, r, [int(np.floor(1024 * float(c))) for c in v]) for r, (i, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, r, q in ok:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, s, x in ok if s != r and len(x) == len(q))
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


VECS = "vec_id long, embedding array<double>, x int, row int, id int, width int, score int, rank int"


def vectors(spark, rows, kind=VECS):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], kind).repartition(6)


def clustered(n, d, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    return [(i, (centres[i % 12] + spread * r.standard_normal(d)).tolist()) for i in range(n)]


def search(df, **more):
    return sorted((tuple(r) for r in nearest.top_products(df, F.col("vec_id") % 10 == 0, **more).collect()), key=str)


def test_search_on_odd_rows(spark):
    rows = clustered(300, 6, 1)
    rows += [(0, rows[0][1]), (10, rows[3][1]), (None, rows[3][1]), (1000, None), (1010, []), (1020, [None] * 6), (1030, [float("nan")] * 6), (1040, [float("inf"), *[0.0] * 5])]
    rows += [(1050, [1.0, 2.0]), (1051, [0.5, -2.0]), (1060, [0.0] * 6), (1070, [-3.5] * 6), (1080, [3e4] * 6), (1090, [1e300] * 6)]
    plain = [r for r in rows if r[0] != 1090]  # products with it do not fit 64 bits
    assert search(vectors(spark, rows)) == plain_top(plain, 10, 10)
    assert search(vectors(spark, rows), block=16, wave=8) == plain_top(plain, 10, 10)
    assert search(vectors(spark, rows[:4])) == plain_top(rows[:4], 10, 10)
    assert search(vectors(spark, rows).limit(0)) == []


def test_search_with_a_very_common_vector(spark):
    rows = clustered(400, 5, 2)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    assert search(vectors(spark, rows), block=16) == plain_top(rows, 10, 10)


def test_search_prunes_and_stays_exact(spark):
    """With tight clusters the bounds leave most blocks unread, and the results are the same."""
    rows = clustered(3000, 8, 3, 0.01)
    x = np.floor(np.array([v for _, v in rows]) * 1024)
    largest = float((x * x).sum(axis=1).max())
    index = nearest.fit_index(x, len(x), largest, 32)
    d = nearest.distances(index.lifted(x), index.pivots)
    near, away = d.argmin(axis=1), d.min(axis=1)
    q = x[::300]
    scores = q @ x.T
    kth = np.sort(scores, axis=1)[:, -11]
    asked = index.asked(q)
    least = np.abs(asked[:, near] - away[None, :])
    reach = np.stack([index.reachable((v * v).sum(), least[i]) for i, v in enumerate(q)])
    assert (reach >= scores).all()
    assert (reach >= kth[:, None]).mean() < 0.5
    assert search(vectors(spark, rows[:1500]), block=32) == plain_top(rows[:1500], 10, 10)


def test_search_query(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    got = queries.QUERIES["op12_top_products"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == plain_top(rows, 100, 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


# whitening


def spread_matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 2, 1], [4, 4, 4, 2, 2, 1], [5] * 20, [8, 0, 0, 0], [1e6, 1e6 - 1e-3, 1, 1e-3], [3, 3 - 1e-9, 3 - 2e-9, 1], list(range(1, 61)), [1e-20, 3e-21, 1e-22],
])
def test_leading_eigenpairs(values):
    v = spread_matrix(values)
    found = whitening.leading(v, 16)
    w = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(found.values) == min(16, sum(x > 1e-12 * max(values) for x in values))
    assert np.abs(found.values - w[: len(found.values)]).max() <= 1e-13 * w[0]
    assert np.abs(found.vectors @ found.vectors.T - np.eye(len(found.values))).max() < 1e-11
    assert np.abs(v @ found.vectors.T - found.vectors.T * found.values).max() <= 1e-13 * w[0]


def test_inertia_counts():
    r = np.random.default_rng(5)
    for _ in range(500):
        n = r.integers(1, 10)
        a = r.integers(-2, 3, (n, n)).astype(float)
        w = np.linalg.eigvalsh(a + a.T)
        if np.abs(w).min() > 1e-9:
            assert whitening.inertia(a + a.T) == (w > 0).sum()
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]])) == 1 and whitening.inertia(np.zeros((3, 3))) == 0


def check_whitening(got, rows):
    """Against numpy's eigenpairs of the same covariance."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in ok], float) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    y = (n * u - sums) / n
    v = y.T @ y / n
    w, q = np.linalg.eigh(v)
    w, q = w[::-1], q[:, ::-1]
    k = min(16, int((w > 1e-9 * w[0]).sum()))
    want = defaultdict(list)
    white = ((n * x - sums) / n) @ q[:, :k] / np.sqrt(w[:k])
    for (i, _), d, row in zip(ok, ((n * x - sums) ** 2).sum(axis=1), white):
        want[i].append((int(d), row))
    rows_got = defaultdict(lambda: defaultdict(list))
    for r in got.collect():
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - w[r["component"] - 1] / np.trace(v)) < 1e-12
        rows_got[r["vec_id"]][r["component"]].append((r["deviation"], r["whitened"]))
    assert rows_got.keys() == want.keys()
    sign = None
    for i, those in want.items():
        assert sorted(rows_got[i]) == list(range(1, k + 1))
        if len(those) == 1:
            mine = np.array([rows_got[i][c][0][1] for c in range(1, k + 1)])
            sign = np.sign(mine * those[0][1]) if sign is None else sign
            assert rows_got[i][1][0][0] == those[0][0] and np.abs(mine * sign - those[0][1]).max() < 1e-7
        else:
            assert sorted(d for d, _ in rows_got[i][1]) == sorted(d for d, _ in those)


WHITE = "vec_id long, embedding array<double>, x int, id int, n int, component int, deviation int, whitened int"


def test_whitening_of_odd_rows(spark):
    rows = [(i, (np.array(v) * np.array([1, 2, 3, 4, 5, 6, 0.1])).tolist()) for i, v in clustered(500, 7, 4, 0.4)]
    rows += [(0, rows[5][1]), (None, rows[6][1]), (900, None), (901, [None] * 7), (902, [float("nan")] * 7), (903, [float("-inf")] * 7), (904, [])]
    rows += [(1000 + i, rows[7][1]) for i in range(250)]  # a very common vector counts once
    check_whitening(whitening.whiten(vectors(spark, rows, WHITE)), rows)
    uncommon = [*rows, (905, [1.0, 2.0]), (906, [1e300] * 7)]
    check_whitening(whitening.whiten(vectors(spark, uncommon, WHITE)), rows)


def test_whitening_without_spread(spark):
    assert whitening.whiten(vectors(spark, [], WHITE)).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25])] * 9, WHITE)).collect() == []
    line = [(i, [i / 64, 2 * i / 64, 0.0]) for i in range(40)]  # one direction only
    check_whitening(whitening.whiten(vectors(spark, line, WHITE)), line)


def test_deviation_that_does_not_fit():
    x = np.array([[0, 1 << 39], [1 << 39, 0]], np.int64)
    assert whitening.deviations(x, 2, [1 << 39, 1 << 39]) == [None, None]
    assert whitening.deviations(x >> 29, 2, [1 << 10, 1 << 10]) == [2 << 20, 2 << 20]


def test_whitening_query(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    check_whitening(queries.QUERIES["op13_whitening"](spark, sf), rows)
