"""The pipeline against its stages' plain readings, and its guard."""

import os
import subprocess
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from flowlens.llm import decontaminate, queries  # noqa: E402
from flowlens.llm.tables import saved, table  # noqa: E402


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), f"test-{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(seen[name]) == docs.count()
        if name != "sentencepiece":
            assert docs.columns == columns
    everything = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op4_toxicity"](spark, sf).collect()}
    assert set(seen["toxicity"]) == {i for i, p in scores.items() if not p}
    left = [(i, everything[i]) for i in seen["toxicity"]]
    assert set(seen["near_copies"]) == {c for _, _, c in brute.similar_components(left)}
    bench = [b for (b,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    clean = {i for i in seen["near_copies"] if not any(b in everything[i] for b in bench)}
    assert set(seen["decontamination"]) == clean
    assert set(seen["secrets"]) == clean == set(seen["sentencepiece"])
    for i in clean:
        text = seen["secrets"][i]["text"]
        assert not brute.base_spans(text)
        assert (text == everything[i]) == (not brute.base_spans(everything[i]) and "[SECRET]" not in text)
    ran = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert ran == {tuple(r) for r in seen["sentencepiece"].values()}


def test_rows_without_id_or_words_and_shared_ids(spark, sf):
    passage = table(spark, sf, "benchmark").first()["text"]
    rows = [(None, "", "en", "a"), (None, "", "de", "b"), (None, " \t", "en", "a"), (None, " \t", "en", "a"), (7, None, "en", "a"), (7, None, "de", "a"),
            (None, f"before {passage} after", "en", "a"), (5, f"one two {passage}", "en", "a"), (5, "a clean text with the same id", "en", "a"), (None, "clean", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted(map(tuple, stages["near_copies"](spark, docs.where("length(text) < 100 OR text IS NULL"), sf).collect()), key=str)
    assert kept == sorted([r for r in rows if not r[1] or len(r[1]) < 100], key=str)
    kept = sorted(map(tuple, stages["decontamination"](spark, docs, sf).collect()), key=str)
    assert kept == sorted([r for r in rows if passage not in (r[1] or "")], key=str)


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf), f"empty-{name}")
        assert docs.count() == 0


def test_library_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "flowlens"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "flowlens").mkdir()
    for name in os.listdir(os.path.join(ROOT, "flowlens")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "flowlens", name), tmp_path / "flowlens" / name)
    code = "import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    # The copy of the entry must not find the real package through its own folder.
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, ops, pipeline = out.stdout.split()
    assert int(n) > 100 and ops == "False" and pipeline == "False"


def test_tasks_hand_back_what_they_have_freed(monkeypatch):
    """Idle Python processes stay beside the stages that follow; after a task they should hold little."""
    from flowlens.llm import tables

    calls = []
    monkeypatch.setattr(tables, "give_back", lambda: calls.append(1))
    task = tables.lean(lambda batches: (2 * x for x in batches))
    assert list(task(iter([1, 2, 3]))) == [2, 4, 6] and calls == [1]
    begun = task(iter([1, 2, 3]))
    assert next(begun) == 2 and calls == [1]
    begun.close()  # a limit may end a task early
    assert calls == [1, 1]


def test_freed_memory_goes_back_to_the_system():
    code = """
import numpy as np
from flowlens.llm.tables import lean
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
def task(batches):
    some = [np.ones(500) for _ in range(60_000)]  # some 230 MB in small pieces
    pin.append(np.ones(500))  # what is above the freed pieces and stays
    yield len(some)
pin = []
start = held()
list(lean(task)(iter([])))
print(held() - start)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(run.stdout) < 60


def test_long_texts_are_judged_piece_by_piece(spark, tmp_path, monkeypatch):
    """The stage drops a text for a passage that lies across the borders of its pieces, wherever that is, and keeps all others."""
    monkeypatch.setattr(decontaminate, "PIECE", (16, 16))
    seen, plain = [], decontaminate.best_lines
    monkeypatch.setattr(decontaminate, "best_lines", lambda *x: seen.append(x[4]) or plain(*x))
    item, other = [f"w{i}" for i in range(30)], [f"x{i}" for i in range(400)]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [other[:at] + item + other[at:] for at in (0, 1, 15, 16, 17, 100, 399, 400)] + [other, item[:8] + other, item * 60]
    docs = spark.createDataFrame([(i, " ".join(t), 1) for i, t in enumerate(texts)] + [(None, " ".join(item), 2), (None, "y", 2)], "doc_id long, text string, n_chars int")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, (r["doc_id"] for r in left))) == ["8", "9", "None"] and seen == [30]
