"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is toxic with probability ``p = sigmoid(bias + sum of word weights)``; a document is toxic
unless all of its sentences are clean (noisy-or): ``1 - product(1 - p)``. Only document labels are
known in training, so the gradient itself tells which sentence explains a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.arrays import LETTERS, LOWER, flat, word_hashes, words
from flowlens.llm.tables import lean, slices

SLOT_BITS = 20
SAMPLE = 10_000  # bound on the labelled documents that a model is fitted on
LEAST_DOCS = 4  # a word in fewer sampled documents has no weight

ENDS = np.zeros(256, bool)  # bytes that end a sentence
ENDS[list(b".!?\n")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by word slot, float32
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def instances(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, the sentence of each word, and of each sentence with words: row, start and end byte in the row."""
    data, borders = flat(column)
    starts, ends, rows = words(data, borders, LETTERS)
    slots = (word_hashes(data, starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(ENDS[data])])[starts]
    key = stops + rows  # grows at each sentence end and at each row
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])])) if len(starts) else np.zeros(0, np.int64)
    sentence = np.zeros(len(starts), np.int64)
    sentence[first[1:]] = 1
    last = np.concatenate([first[1:], [len(starts)]])[: len(first)] - 1
    base = borders[rows[first]] if len(first) else first
    return slots, np.cumsum(sentence), rows[first] if len(first) else first, starts[first] - base, (ends[last] - base if len(first) else first)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


FEATURES = "id long, toxic int, slots array<int>, sizes array<int>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word slots of each text, and how many of them each sentence has."""
    for batch in slices(batches, 1024, 1 << 20):
        slots, sentence, row, _, _ = instances(batch.column("text"))
        sizes = np.bincount(sentence, minlength=len(row))
        listed = lambda values, n: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.astype(np.int32))
        )
        sentences = np.bincount(row, minlength=batch.num_rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(sentences)])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("toxic"), listed(slots, np.diff(ends)), listed(sizes, sentences)],
            names=["id", "toxic", "slots", "sizes"],
        )


def fit(sample: pa.Table, steps: int = 250, rate: float = 0.1, shrink: float = 2e-4) -> Model:
    """Noisy-or model of one weight per word slot, by proximal Adam steps over the whole sample of ``features``.

    ``shrink`` pulls weights to zero, so words that do not help keep none. Without both classes, or
    without words, every score is 0.
    """
    weights = np.zeros(1 << SLOT_BITS, np.float32)
    n, toxic = sample.num_rows, np.asarray(sample.column("toxic")) > 0
    if not 0 < toxic.sum() < n:
        return Model(weights, -50.0)
    slots, sizes = (sample.column(c).combine_chunks() for c in ("slots", "sizes"))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(sizes.offsets.to_numpy()))
    sentence = np.repeat(np.arange(len(row), dtype=np.int32), sizes.flatten().to_numpy())
    slots = slots.flatten().to_numpy()
    if not len(slots):
        return Model(weights, -50.0)
    pairs = np.unique(row[sentence].astype(np.int64) << SLOT_BITS | slots)
    often = np.bincount(pairs & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
    used = np.flatnonzero(often >= LEAST_DOCS)
    code = np.full(1 << SLOT_BITS, -1, np.int32)
    code[used] = np.arange(len(used), dtype=np.int32)
    x = code[slots]
    keep = x >= 0
    x, where, m = x[keep], sentence[keep], len(row)
    del pairs, slots, sentence, keep
    y = toxic.astype(np.float64)
    w, b = np.zeros(len(used)), -np.log(m / max(1.0, y.sum()))
    mw = vw = np.zeros(len(used))
    mb = vb = 0.0
    for t in range(1, steps + 1):
        z = np.bincount(where, weights=w[x], minlength=m) + b
        total = np.bincount(row, weights=softplus(z), minlength=n)
        rest = np.exp(-np.clip(total, 1e-9, 700))
        slope = np.where(y > 0, -rest / (1 - rest), 1.0) / n
        gz = slope[row] / (1 + np.exp(-z))
        gw, gb = np.bincount(x, weights=gz[where], minlength=len(used)), gz.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, scale = 1 - 0.9**t, np.sqrt(vw / (1 - 0.99**t)) + 1e-4
        w = w - rate * (mw / up) / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * shrink / scale)
        b -= rate * (mb / up) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    weights[used] = w
    return Model(weights, float(b))


def fit_on(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fits on at most SAMPLE labelled documents outside the held-out fold, chosen by a hash of their id.

    Repeated labels of an id count as toxic if one of them is; null labels and ids are left out.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The chosen ids are bounded by SAMPLE, so they may be sent to all tasks.
    sample = texts.join(F.broadcast(chosen), "id").select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"), "text")
    found = sample.mapInArrow(lean(features), FEATURES).orderBy(F.xxhash64("id", "slots")).limit(SAMPLE)
    return fit(found.select("toxic", "slots", "sizes").toArrow())


SCHEMA = "score double, offending array<struct<start:int,end:int,score:double>>"


def score_documents(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False
) -> DataFrame:
    """One row per input row: id, score (0 to 1) and the sentences whose own score is 0.5 or more.

    With ``whole_row`` a column ``row`` holds all columns of the input row.

    Sentences are given as byte ranges of the UTF-8 text, in order. Null and empty texts, and texts
    without words, score 0. Only the text is looked at. Repeated rows are scored one by one. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = [F.struct(*[df[c] for c in df.columns]).alias("row")] if whole_row else []
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"), *rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        for batch in slices(batches, 4096, 1 << 20):
            n = batch.num_rows
            slots, sentence, row, start, end = instances(batch.column("text"))
            z = np.bincount(sentence, weights=told.weights[slots], minlength=len(row))[: len(row)] + told.bias
            score = -np.expm1(-np.bincount(row, weights=softplus(z), minlength=n))
            hits = np.flatnonzero(z >= 0)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[hits], minlength=n))]).astype(np.int32)
            spans = pa.StructArray.from_arrays(
                [pa.array(start[hits].astype(np.int32)), pa.array(end[hits].astype(np.int32)), pa.array(1 / (1 + np.exp(-z[hits])))],
                names=["start", "end", "score"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans), *batch.columns[2:]],
                names=["id", "score", "offending", *batch.schema.names[2:]],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    row = f", row {kinds['row']}" if whole_row else ""
    return kept.mapInArrow(lean(run), f"id {kinds['id']}, {SCHEMA}{row}").withColumnRenamed("id", id_col)
