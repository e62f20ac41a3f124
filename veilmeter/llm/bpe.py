"""Byte-level BPE encoding and decoding without a tokenizer library.

A piece of text (a word with the space before it) is a row of byte symbols. A segment tree over the ranks of adjacent pairs
holds in its root the lowest rank, of equal ones the leftmost; that pair is merged, and three leaves change: the pair itself
and its neighbours on either side. This goes on until the root holds no rank. Pieces of up to 64 bytes run side by side, one
tree a row of a numpy array; longer ones have a tree of their own, so n symbols take O(n log n) steps.

A worker keeps the ids of pieces that it has met, up to a bound, and encodes only new ones.

Defined cases: null text counts as empty, which gives no ids and the empty text; an added token's string in a text gives its
id; equal texts give equal rows; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilmeter.llm.common import Known, slices, text_or_empty, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LARGEST = 64  # bytes of a piece that shares an array
KEPT = 150_000  # pieces in each of the two generations that a worker keeps
NONE = np.int64(1) << 40
#: White space of the Unicode standard; a piece never reaches over the border before a run of it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Fixed value: the pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = bytes(back[c] for c in t)
        for t, i in self.added.items():
            self.token[i] = t.encode()
        self.pieces = regex.compile(PATTERN)
        self.known = Known(KEPT)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE if it is not mergeable or an id is -1."""
        key = (left << 16) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Words of at most `width` bytes, a power of two up to 64: their ids as unsigned 32-bit integers."""
        n, row = len(words), 2 * width
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, row), NONE << 6, dtype=np.int64)
        tree[:, width:] = (self.rank(ids[:, :-1], ids[:, 1:]) << 6) + np.arange(width)
        for k in range(width.bit_length() - 2, -1, -1):
            tree[:, 1 << k : 2 << k] = tree[:, 2 << k : 4 << k].reshape(n, 1 << k, 2).min(axis=2)
        ids1, after1, before1, tree1 = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(n)
        while True:
            root = tree1[live * row + 1]
            go = root < (NONE << 6)
            live, root = live[go], root[go]
            if not len(live):
                break
            base, top = live * (width + 1), live * row
            at = root & 63
            gone = after1[base + at]
            new = self.merged[root >> 6]
            ids1[base + at], ids1[base + gone] = new, -1
            following, prior = after1[base + gone], before1[base + at]
            after1[base + at] = following
            before1[base + np.minimum(following, width)] = at
            first = np.maximum(prior, 0)
            left = np.where(prior >= 0, self.rank(ids1[base + first], new), NONE)
            right = self.rank(new, ids1[base + np.minimum(following, width)])
            none = np.full(len(live), NONE)
            for where, value in ((gone, none), (at, right), (first, np.where(prior >= 0, left, right))):
                node = width + where
                tree1[top + node] = (value << 6) + where
                while node[0] > 1:
                    node = node >> 1
                    tree1[top + node] = np.minimum(tree1[top + 2 * node], tree1[top + 2 * node + 1])
        left_over = ids[:, :width] >= 0
        flat, cuts = ids[:, :width][left_over].astype("<u4").tobytes(), [0, *(4 * np.cumsum(left_over.sum(axis=1))).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, word: bytes) -> bytes:
        """One word of any length with a tree of its own."""
        ranks = {(k >> 16, k & 0xFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist())} if not hasattr(self, "_pairs") else self._pairs
        self._pairs, merged = ranks, self.merged
        ids, n = self.byte_id[np.frombuffer(word, np.uint8)].tolist(), len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none = (int(NONE), 0)
        tree = [none] * (2 * width)
        for k in range(n - 1):
            tree[width + k] = (ranks.get((ids[k], ids[k + 1]), int(NONE)), k)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(where: int, rank: int) -> None:
            node = width + where
            tree[node] = (rank, where)
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1][0] < NONE:
            rank, at = tree[1]
            gone = after[at]
            ids[at], ids[gone] = int(merged[rank]), -1
            after[at] = following = after[gone]
            put(gone, int(NONE))
            if following < n:
                before[following] = at
            put(at, ranks.get((ids[at], ids[following]), int(NONE)) if following < n else int(NONE))
            if (prior := before[at]) >= 0:
                put(prior, ranks.get((ids[prior], ids[at]), int(NONE)))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        by_width: dict[int, list[bytes]] = {}
        out = {}
        for w in words:
            if len(w) <= LARGEST:
                by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
            else:
                out[w] = self.merge_long(w)
        for width, own in by_width.items():
            for k in range(0, len(own), 65536):
                out |= zip(own[k : k + 65536], self.merge_rows(own[k : k + 65536], width))
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [self.split_added.split(t) if self.split_added and any(a in t for a in self.added) else [t] for t in texts]
        units = [[UNIT.findall(p) if k % 2 == 0 else p for k, p in enumerate(own)] for own in parts]
        known, met = self.known, set()
        known.turn()
        for own in units:
            for p in own:
                if isinstance(p, list):
                    met.update(p)
        cut = {u: self.pieces.findall(u) for u in known.missing(met)}
        words = known.missing({w for ws in cut.values() for w in ws})
        ids = self.merge([w.encode() for w in words])
        known.now.update((w, ids[w.encode()]) for w in words)
        now = known.now
        now.update((u, b"".join([now[w] for w in ws])) for u, ws in cut.items() if len(ws) > 1)
        out = []
        for own in units:
            found = [b"".join(map(now.__getitem__, p)) if isinstance(p, list) else np.array([self.added[p]], "<u4").tobytes() for p in own]
            out.append(np.frombuffer(b"".join(found), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of long) of every whole text."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int64) for x in load(path).encode_batch(b.column(1).to_pylist())], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the text that they decode to."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for big in batches:
            for b in slices(big, 1):
                ids = bpe.encode_batch(b.column(1).to_pylist())
                digests = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), *(pa.array(x, pa.string()) for x in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
