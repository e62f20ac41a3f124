"""Packing: token sequences of at most 2048 ids from documents, by first-fit decreasing in randomised groups.

A document's ids and a closing id 1 are cut into pieces of 2048 and a rest. Where the text lies, a task encodes it and sends
on only (doc_id, start, length, checksum) of each piece. Pieces fall at random into groups of about GROUP pieces at most, as a
token is of a byte at least; their number grows with the rows and the bytes of the table. In a group, pieces go by falling length each into the first sequence with room, which a
tournament tree of the sequences' free room finds in logarithmic time.

The encoder works on words between blanks, tabs and line ends, which are independent of one another under this vocabulary's rules. A part
of a task's texts is split, also between marks and letters or digits, and its different words are told by numpy; only these are looked up or encoded,
and their ids are dealt out to all. A task keeps the ids of words that it has met, up to a bound.

Defined cases: null text counts as empty and has one id; equal rows are packed each; very long texts have many pieces;
pieces of equal length go by (doc_id, start); an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.llm.common import Known, slices, text_or_empty, tokenizer_path
from veilmeter.llm.words import Words, kinds, looked_for

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
CLOSING = 1
GROUP = 8192
KEPT = 150_000
#: Other white space, and what only Python takes for it, stays inside a word, which the library encodes.
BLANKS = kinds([32, 9, 10, 13])
#: Marks that join no contraction and begin or end no token of the vocabulary's own.
SIGNS = ".,;:!?()%&*#$-"
MARKS = np.array([chr(b) in SIGNS for b in range(256)])
#: Letters that are composed and have one lower-case letter, or marks: one word to the vocabulary.
PLAIN = re.compile(f"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+|[{re.escape(SIGNS)}]+")


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.ends[ends] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Words that are each one run of letters or of marks: encoded as one text, cut where a token ends a word."""
        out = []
        for k in range(0, len(words), 1000):
            ids = np.array(self._whole(" ".join(words[k : k + 1000])), dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_batch(self, texts: list[str], known: Known | None = None) -> list[bytes]:
        """known: what a task keeps of words between calls; it goes with the task."""
        return self.encode_column(pa.array(texts, pa.string()), known)

    def encode_column(self, texts: pa.Array, known: Known | None = None) -> list[bytes]:
        """encode_batch of a column without nulls."""
        known = Known(KEPT) if known is None else known
        own_case = pc.any(pc.match_substring(texts, "<|")).as_py()  # the vocabulary's own tokens are told by case
        words = Words(texts, BLANKS, not own_case, MARKS)
        found, number = looked_for(words)
        met = found.column().to_pylist()
        known.turn()
        plain, other = [], []
        for w in known.missing(set(met)):
            (plain if PLAIN.fullmatch(w) else other).append(w)
        now = known.now
        now.update(zip(plain, self._encode_plain(plain)))
        now.update(zip(other, self._encode(other)))
        own = [now[w] for w in met]
        # The ids of the different words one after another; those of all words are taken from there.
        ids, size = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        n = size[number]
        ends = np.r_[0, n.cumsum()]
        flat = ids[np.arange(ends[-1]) + np.repeat((size.cumsum() - size)[number] - ends[:-1], n)].tobytes()
        cuts = (4 * ends[words.first]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row: the pieces; row counts the documents of a task."""
    path = vocabulary or tokenizer_path(VOCABULARY)
    last = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = 0, Known(KEPT)
        for big in batches:
            for b in slices(big, 1):
                out = []
                for doc, ids in zip(b.column(0).to_pylist(), encoder(path).encode_column(b.column(1), known)):
                    view = memoryview(ids + last)
                    n, row = len(view) // 4, row + 1
                    out += [(doc, s, min(LENGTH, n - s), zlib.crc32(view[4 * s : 4 * (s + LENGTH)]), n, row) for s in range(0, n, LENGTH)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def first_fit(lengths: list[int], room: int = LENGTH) -> tuple[list[int], list[int]]:
    """For lengths in falling order: each one's sequence and offset. The tree's leaves are sequences, a node holds the most free room below it."""
    width = 1 << max(1, (len(lengths) - 1).bit_length())
    tree = [room] * (2 * width)
    where, offset = [], []
    for n in lengths:
        node = 1
        while node < width:
            node *= 2
            if tree[node] < n:
                node += 1
        where.append(node - width)
        offset.append(room - tree[node])
        tree[node] -= n
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return where, offset


def pack(docs: DataFrame, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-(rows + size // LENGTH) // group))
    # The row number spreads copies of one document over the groups, the start equal pieces of one text.
    pieces = cut(docs, vocabulary).withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(groups)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, own["offset"] = first_fit(own["length"].tolist())
        own["sequence_id"] = own["grp"] * (1 << 32) + np.array(where, dtype=np.int64)
        return own[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pieces.drop("row").groupBy("grp").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
