"""Words of many texts at once, by numpy on an Arrow column's bytes.

Separators are ASCII bytes, so a word is a run of other bytes inside one text, whatever letters it is made of. A word's hash is a
polynomial of its bytes, each exchanged for a fixed random number, times powers of an odd number modulo 2**64, mixed at the
end; it depends on the word alone. Texts are taken in chunks of CHUNK bytes, so memory is bounded but for a longer single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: A-Z as a-z, every other byte as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_LETTER = np.random.Generator(np.random.PCG64(42)).integers(1, 2**64, 256, dtype=np.uint64)
_LETTER_OR_DIGIT = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
WORD, BLANK, CUT = 0, 1, 2  # kinds of bytes: of a word, between words, and one that also parts pieces of a text


def kinds(blank, cut=()) -> np.ndarray:
    """The kind of each byte, from those that stand between words and those that part pieces."""
    out = np.zeros(256, np.uint8)
    out[list(blank)] = BLANK
    out[list(cut)] = CUT
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, well mixed; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of MULTIPLIER and of its inverse, as many as were asked for so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 2**64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))


_POWERS = _Powers()


class Words:
    """Of a text column: lower (its bytes, A-Z in lower case, or as they are), starts and ends of words there, the text of each, and the first word of each
    text. marks: bytes that are words apart from an ASCII letter or digit, or a Latin letter of two bytes that begin with C3, beside them."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True, marks: np.ndarray | None = None):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, np.int64)
        if column.null_count:  # a null's bytes, if it has any, are no text's
            column = column.fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = column.buffers()[2] if rows else None
        raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.rows, self.offsets = rows, offsets - first
        self.lower = LOWER[raw] if lower else raw
        self.kind = kind[self.lower]
        inside = self.kind == WORD
        at = self.offsets[1:-1]
        at = at[(at > 0) & (at < len(inside))]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[at] = inside[at]
        end[at - 1] = inside[at - 1]
        if marks is not None and len(inside):
            mark, last = marks[self.lower], _LETTER_OR_DIGIT[self.lower]
            latin = (self.lower[:-1] == 0xC3) & (self.lower[1:] != 0x97) & (self.lower[1:] != 0xB7)  # but the signs of times and division
            part = (last[:-1] | np.r_[False, latin[:-1]][: len(latin)]) & mark[1:] | mark[:-1] & (last[1:] | np.r_[latin[1:], False][: len(latin)])
            begin[1:] |= part
            end[:-1] |= part
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word; at the end the number of all
        self.counts = np.diff(self.first)

    def texts(self) -> np.ndarray:
        """Of each word, the number of its text."""
        return np.repeat(np.arange(self.rows), self.counts)

    def pieces(self) -> np.ndarray:
        """Of each word, the number of its piece; pieces of different texts have different numbers."""
        cuts = np.flatnonzero(self.kind == CUT)
        return np.searchsorted(cuts, self.starts) + self.texts()

    def word(self, k: int) -> bytes:
        return self.lower[self.starts[k] : self.ends[k]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out, at = np.zeros(len(self.starts), np.uint64), 0
        while at < len(self.starts):
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            high = int(self.ends[to - 1])
            _POWERS.grow(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_LETTER[self.lower[low:high]] * _POWERS.up[: high - low], out=total[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mixed((total[e] - total[s]) * _POWERS.down[s])
            at = to
        return out


def runs(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` neighbours; none where there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    out = np.full(n, (seed * 0x5851F42D4C957F2D + size) % 2**64, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n])
    return out


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and `size` bytes of a text column, so that a worker's memory is bounded; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


#: A mask of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eight(lower: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start on, as a number of little end; zeros after the last."""
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    return np.ndarray((len(lower) + 1,), "<u8", padded, strides=(1,))[starts]


def alike(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether words are the same bytes, one by one. a, b: bytes, starts, ends."""
    size = a[2] - a[1]
    same = (size == b[2] - b[1]) & ((_eight(a[0], a[1]) ^ _eight(b[0], b[1])) & _FIRST[np.minimum(size, 8)] == 0)
    some = np.flatnonzero(same & (size > 8))
    for at in range(0, len(some), 1 << 16):
        own = some[at : at + (1 << 16)]
        n = size[own]
        inside = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        differ = a[0][inside + np.repeat(a[1][own], n)] != b[0][inside + np.repeat(b[1][own], n)]
        same[own[np.repeat(np.arange(len(own)), n)[differ]]] = False
    return same


@dataclass
class Lookup:
    """Different words by number, found by their hash and then their bytes. layers: hashes in rising order, starts, ends, and the number before; words of one hash
    are in layers of their own."""

    lower: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    size: int

    def find(self, words: Words, a: int, z: int, hashes: np.ndarray) -> np.ndarray:
        """The number of each word from a to z, -1 for others. hashes: of all words."""
        out = np.full(z - a, -1, np.int64)
        for known, starts, ends, before in self.layers:
            at = np.minimum(np.searchsorted(known, hashes[a:z]), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes[a:z])
            at = at[hit]
            same = alike((words.lower, words.starts[a + hit], words.ends[a + hit]), (self.lower, starts[at], ends[at]))
            out[hit[same]] = at[same] + before
        return out

    def column(self) -> pa.Array:
        """The words by number."""
        ends = np.concatenate([np.zeros(1, np.int64), *[x[2] for x in self.layers]])  # one after another
        return pa.Array.from_buffers(pa.large_string(), self.size, [None, pa.py_buffer(ends), pa.py_buffer(self.lower)]).cast(pa.string())


def looked_for(words: Words) -> tuple[Lookup, np.ndarray]:
    """The different words, and the number of each word."""
    hashes, own = words.hashes(), np.full(len(words.starts), -1, np.int64)
    layers, parts, rest, size, at = [], [], np.arange(len(own)), 0, 0
    while len(rest):
        known, where, number = np.unique(hashes[rest], return_index=True, return_inverse=True)
        starts, ends = words.starts[rest[where]], words.ends[rest[where]]
        same = alike((words.lower, words.starts[rest], words.ends[rest]), (words.lower, starts[number], ends[number]))
        own[rest[same]] = number[same] + size
        n = ends - starts
        to = at + n.cumsum()
        parts.append(words.lower[np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(starts, n)])
        layers.append((known, to - n, to, size))
        rest, size, at = rest[~same], size + len(known), int(to[-1])
    return Lookup(np.concatenate(parts) if parts else words.lower[:0], layers, size), own
