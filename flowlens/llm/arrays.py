"""Numpy views of Arrow text columns: words, their hashes and hashes of byte windows, many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = (1 << 61) - 1  # modulo a power of two, texts in the order of Thue and Morse would hash alike
BASE = 0x9E3779B97F4A7C15 % PRIME
INVERSE = pow(BASE, -1, PRIME)
LENGTH = np.uint64(0xD6E8FEB86659FD93)  # times its length, added to a string's hash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)  # words are runs of anything but ASCII white space
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

LETTERS = np.zeros(256, dtype=bool)  # words are runs of ASCII letters and of bytes of other characters
LETTERS[97:123] = True
LETTERS[65:91] = True
LETTERS[128:] = True


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the border of each row; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]] if raw else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a published finalizer); one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


LOW30, LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^31 modulo PRIME, below 2^62, for x below 2^61: bits from 2^61 on count from 2^0 again."""
    return (x >> np.uint64(30)) + ((x & LOW30) << np.uint64(31))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of numbers below it, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & LOW31, b >> np.uint64(31), b & LOW31
    return reduced(a1 * b1 * np.uint64(2) + shifted(a1 * b0 + a0 * b1) + a0 * b0)


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    for i in range(bits):
        n = 1 << i
        out[n : 2 * n] = product(out[:n], np.uint64(pow(base, n, PRIME)))
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(12, int(n).bit_length()))[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo PRIME; ``window`` takes the hash of any stretch from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    value, power = data.astype(np.uint64) + np.uint64(1), powers(BASE, len(data))
    low, high = np.cumsum(value * (power & LOW31)), np.cumsum(value * (power >> np.uint64(31)))
    out[1:] = reduced(reduced(low) + shifted(reduced(high)))
    return out


def window(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]``, equal for equal bytes wherever they stand; lengths are part of it."""
    raw = product(reduced(sums[ends] + (np.uint64(PRIME) - sums[starts])), powers(INVERSE, len(sums))[starts])
    return mix(raw + (ends - starts).astype(np.uint64) * LENGTH)


def words(data: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the row it belongs to. ``inside`` tells which bytes make words."""
    n = len(data)
    mask = inside[data]
    before = np.zeros(n + 1, bool)
    before[1:] = mask
    before[borders[borders <= n]] = False  # a word ends with its row
    starts = np.flatnonzero(mask & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = mask
    after[borders] = False
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


SHORT = 32  # bytes that are hashed by their place in the word; what is longer takes sums over its bytes


@lru_cache(maxsize=1)
def _terms() -> np.ndarray:
    """What each byte, with A-Z lowered, adds to the hash at each place of a word."""
    value = LOWER.astype(np.uint64) + np.uint64(1)
    return np.stack([product(value, np.full(256, pow(BASE, j, PRIME), np.uint64)) for j in range(SHORT)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word with A-Z lowered: what ``window`` gives, without sums over all bytes of the texts."""
    size = ends - starts
    short = np.minimum(size, SHORT + 1).astype(np.uint8)
    order = np.argsort(SHORT + 1 - short, kind="stable")  # longest first: those that go on stand in front
    longer = len(size) - np.cumsum(np.bincount(short, minlength=SHORT + 2))
    many, at, terms = int(longer[SHORT]), starts[order], _terms()
    total = np.zeros(len(size), np.uint64)
    for j in range(SHORT):
        k = int(longer[j])
        if k <= many:
            break
        total[many:k] += terms[j][data[at[many:k]]]
        at[many:k] += 1
        if j % 6 == 5:  # a folded sum and six terms stay below 2^64
            total[many:k] = (total[many:k] & np.uint64(PRIME)) + (total[many:k] >> np.uint64(61))
    out = np.empty(len(size), np.uint64)
    out[order] = reduced(total)
    out = mix(out + size.astype(np.uint64) * LENGTH)
    if many:
        rest = order[:many]
        stop = np.cumsum(size[rest])
        places = np.repeat(starts[rest] - stop + size[rest], size[rest]) + np.arange(stop[-1])
        out[rest] = window(prefix_hashes(LOWER[data[places]]), stop - size[rest], stop)
    return out
