"""Token counts of a byte-level BPE vocabulary with a whole-token shortcut."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowlens.llm.tables import slices

# The published pre-token pattern of this family of vocabularies, and white space in its sense.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CACHE = 500_000  # chunks remembered by a worker; when full it starts anew, which changes no result


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    ranks: dict[tuple[str, str], int]  # merges by priority
    whole: frozenset[str]  # pre-tokens proved to be one token
    special: tuple[str, ...]  # matched in texts before anything else


def merged(letters: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies merges by priority, leftmost first, until none is left."""
    parts = list(letters)
    while len(parts) > 1:
        best, at = None, -1
        for i, pair in enumerate(zip(parts, parts[1:])):
            rank = ranks.get(pair)
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merged_long(letters: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of parts left, by a heap over a linked list: for long pre-tokens, in n log n steps."""
    import heapq

    parts: list[str | None] = list(letters)
    after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(letters, letters[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    left = len(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return left


def load(path: str) -> Vocabulary:
    """Reads the vocabulary and proves, once, which strings are one pre-token and merge into one token."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    special = tuple(t["content"] for t in told["added_tokens"])
    pattern, whole = regex.compile(PRE_TOKEN), set()
    for token in told["model"]["vocab"]:
        if token in special or any(c not in byte_of for c in token):
            continue
        try:
            text = bytes(byte_of[c] for c in token).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.fullmatch(text) and len(pattern.findall(text)) == 1 and merged(list(token), ranks) == [token]:
            whole.add(text)
    return Vocabulary(ranks, frozenset(whole), special)


class Counter:
    """Counts the tokens of texts; kept by a worker for its batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self.pattern = regex.compile(PRE_TOKEN)
        # A token never holds white space after something else, so a text may be cut before each run of it.
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.special = re.compile("|".join(map(re.escape, self.v.special))) if self.v.special else None
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def pre_token(self, text: str) -> int:
        if text in self.v.whole:
            return 1
        if (n := self.parts.get(text)) is None:
            spelt = [self.letters[b] for b in text.encode("utf-8")]
            n = len(merged(spelt, self.v.ranks)) if len(spelt) <= 64 else merged_long(spelt, self.v.ranks)
            if len(text) <= 64:
                if len(self.parts) >= CACHE:
                    self.parts.clear()
                self.parts[text] = n
        return n

    def plain(self, text: str) -> int:
        total, known = 0, self.known
        for chunk in self.chunks.findall(text):
            n = known.get(chunk)
            if n is None:
                n = sum(map(self.pre_token, self.pattern.findall(chunk)))
                if len(chunk) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[chunk] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self.plain, pieces))
        return self.plain(text)


def count_tokens(
    df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8) and n_tokens (without added begin or end tokens).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; other
    columns are ignored. Special strings inside texts count as one token each. No shuffle.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load(vocabulary_path))
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in slices(batches, 2048):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array([counter.count(t) for t in texts], pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
