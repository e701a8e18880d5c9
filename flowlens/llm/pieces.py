"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from flowlens.llm.tables import slices

MARK = "▁"  # stands for a space inside pieces
CACHE = 500_000  # chunks remembered by a worker; when full it starts anew, which changes no result


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a merge-type model whose normalizer changes nothing but spaces."""

    ids: dict[str, int]  # mergeable pieces
    scores: dict[str, float]
    texts: tuple[str, ...]  # by id
    byte_ids: tuple[int, ...]  # ids of the 256 byte pieces, or empty
    silent: frozenset[int]  # control ids
    unknown: int
    begin: int
    end: int
    model: bytes  # to check samples against the library


def load(path: str) -> Pieces:
    with open(path, "rb") as file:
        model = file.read()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = lib.get_piece_size()
    texts = tuple(lib.id_to_piece(i) for i in range(size))
    usual = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    byte_ids = tuple(i for i in range(size) if lib.is_byte(i))
    if any(MARK in texts[i].lstrip(MARK) for i in usual):
        raise ValueError("pieces with a space inside are not supported")
    if lib.encode(" a  b ", out_type=str) and "".join(lib.encode(" a  b ", out_type=str)) != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("only models that keep all spaces and add one in front are supported")
    return Pieces(
        {texts[i]: i for i in usual}, {texts[i]: lib.get_score(i) for i in usual}, texts,
        byte_ids if len(byte_ids) == 256 else (), frozenset(i for i in range(size) if lib.is_control(i)),
        lib.unk_id(), lib.bos_id(), lib.eos_id(), model,
    )


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """Merges adjacent symbols in the order of an agenda: highest score first, then leftmost."""
    symbols: list[str] = list(text)
    n = len(symbols)
    if n < 2:
        return symbols
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    agenda = [(-s, i, len(a) + len(b)) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (s := scores.get(a + b)) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, size = heapq.heappop(agenda)
        j = after[i]
        if not symbols[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != size:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (s := scores.get(symbols[i] + symbols[k])) is not None:
                heapq.heappush(agenda, (-s, i, len(symbols[i]) + len(symbols[k])))
        h = before[i]
        if h >= 0 and (s := scores.get(symbols[h] + symbols[i])) is not None:
            heapq.heappush(agenda, (-s, h, len(symbols[h]) + len(symbols[i])))
    return [s for s in symbols if s]


class Codec:
    """Encodes and decodes texts; kept by a worker for its batches."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        # No piece holds a space after something else, nor two characters that never stand together in one.
        # So chunks between such borders are merged on their own, and repeated ones only once.
        self.together = {s[i : i + 2] for s in pieces.ids for i in range(len(s) - 1)}
        alone = "" if any("\n" in s for s in pieces.ids) else "\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + ("|\n" if alone else ""))
        self.known: dict[str, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}

    def _part(self, text: str) -> tuple[int, ...]:
        if (ids := self.parts.get(text)) is not None:
            return ids
        out: list[int] = []
        for symbol in merge(text, self.p.scores):
            if (i := self.p.ids.get(symbol)) is not None:
                out.append(i)
            elif self.p.byte_ids:
                out += [self.p.byte_ids[b] for b in symbol.encode("utf-8")]
            else:
                out.append(self.p.unknown)
        if len(text) <= 64:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[text] = tuple(out)
        return tuple(out)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids of a chunk, packed, and the text they stand for."""
        ids: list[int] = []
        start, together = 0, self.together
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in together:
                ids += self._part(chunk[start:i])
                start = i
        ids += self._part(chunk[start:])
        found = struct.pack(f"<{len(ids)}I", *ids), self.joined(ids)
        if len(chunk) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, begin and end included, and the text decoded from them."""
        if not text:
            return struct.pack("<2I", self.p.begin, self.p.end), ""
        known, chunk = self.known, self._chunk
        found = [known.get(c) or chunk(c) for c in self.chunks.findall(MARK + text.replace(" ", MARK))]
        packed = b"".join([struct.pack("<I", self.p.begin), *[f[0] for f in found], struct.pack("<I", self.p.end)])
        # The space added in front is the first character of the first piece.
        return packed, "".join([f[1] for f in found])[1:]

    def joined(self, ids: Sequence[int]) -> str:
        """Text of ids, where byte pieces side by side are read as UTF-8 and bad bytes become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(as_text(raw))
                raw = bytearray()
            if i == self.p.unknown:
                out.append(" ⁇ ")
            elif i not in self.p.silent:
                out.append(self.p.texts[i].replace(MARK, " "))
        if raw:
            out.append(as_text(raw))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of any ids; the space added in front of a text is taken away again."""
        first = next((n for n, i in enumerate(ids) if i not in self.p.silent), len(ids))
        ids = ids[first:]
        text = self.joined(ids)
        starts = bool(ids) and ids[0] not in self.byte_of and self.p.texts[ids[0]].startswith(MARK)
        return text[1:] if starts else text


def as_text(raw: bytes | bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + size]).decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_pieces(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", checked: int = 2
) -> DataFrame:
    """One row per input row: id, ids (packed little-endian 32-bit integers) and the decoded text.

    Null texts count as empty and encode to begin and end only; repeated rows are encoded one by one;
    other columns are ignored. Of each piece of an Arrow batch ``checked`` texts are compared with the
    library, and a difference ends the job. No shuffle.
    """
    pieces = df.sparkSession.sparkContext.broadcast(load(model_path))
    kept = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces.value)
        lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.value.model)
        for batch in slices(batches, 1024, 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [codec.encode(t) for t in texts]
            for text, (packed, decoded) in zip(texts[:checked], found):
                ids = lib.encode(text, add_bos=True, add_eos=True)
                if struct.pack(f"<{len(ids)}I", *ids) != packed or lib.decode(ids) != decoded:
                    raise RuntimeError(f"encoding differs from the library: {text[:80]!r}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                names=["id", "ids", "decoded"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
