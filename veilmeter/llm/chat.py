"""Chat formatting at token level.

Each turn is `<|turn|>` role `<|sep|>` text `<|end|>`. Role and text are encoded apart from one another with a byte-level
vocabulary, the three marks are reserved ids beyond it and are spliced in, so no content can ever produce them. In the
formatted string the marks are visible, so control strings inside a text are escaped: one backslash more after their first
character; reading back takes one away. The loss mask marks the tokens of assistant texts; it is the running sum of +1 where
such a text begins and -1 where it ends.

Turns are encoded where they lie, before any shuffle. Only reading a conversation in order needs its turns together: they
are sorted by (conversation, turn) and streamed, so a conversation that holds a third of all rows needs no more memory.

Defined cases: null text and null role count as empty; equal turn numbers go by role, then text; a null conversation id is
one conversation; repeated rows are repeated turns; an empty table gives an empty table; only the four columns are read, so
further columns don't matter. The encoder gets a text in parts of at most PART characters, cut before a blank that follows a
word, where its pattern never joins; only a longer run without such a blank is cut inside, as the library fails on long runs.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.llm.common import slices, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
FIRST_RESERVED = 50256
PART = 50_000
TURN, SEP, END = FIRST_RESERVED, FIRST_RESERVED + 1, FIRST_RESERVED + 2
MARKS = {TURN: "<|turn|>", SEP: "<|sep|>", END: "<|end|>"}
#: Strings that a chat template or tokenizer might take for control marks.
CONTROL = [*MARKS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(x[0])})(?=\\*{re.escape(x[1:])})" for x in CONTROL))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(x[0])})\\(?=\\*{re.escape(x[1:])})" for x in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text) if "\\" in text else text


@functools.lru_cache
def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[str]:
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most + 1)
        while cut > at and text[cut - 1].isspace():
            cut = text.rfind(" ", at + 1, cut)
        cut = cut if cut > at else at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoded(encode, text: str) -> list[int]:
    return encode(text) if len(text) <= PART else [i for x in parts(text) for i in encode(x)]


def assemble(segments: list[tuple[list[int], list[int], bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of turns (role ids, text ids, whether its loss counts): all ids, the mask over them, and where each turn begins."""
    sizes = np.array([[1, len(r), 1, len(t), 1] for r, t, _ in segments], dtype=np.int64).reshape(-1, 5)
    starts = np.cumsum(sizes.ravel()) - sizes.ravel()
    ids = np.empty(int(sizes.sum()), dtype=np.uint32)
    at = starts.reshape(-1, 5)
    change = np.zeros(len(ids) + 1, dtype=np.int8)
    for (role, text, loss), (a, b, c, d, e) in zip(segments, at.tolist()):
        ids[a], ids[c], ids[e] = TURN, SEP, END
        ids[b:c], ids[d:e] = role, text
        if loss and e > d:
            change[d] += 1
            change[e] -= 1
    return ids, np.cumsum(change[:-1], dtype=np.int8).astype(bool), at[:, 0]


def format_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn, ids (unsigned 32-bit little-endian), mask (a byte a token): the formatted turns. A conversation's
    formatted form is these in order; `tie` keeps that order where turn numbers are equal."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for big in batches:
            for b in slices(big, 3, 2000, 4 << 20):
                roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
                ids, mask, starts = assemble([(encoded(encode, escape(r)), encoded(encode, escape(t)), r == "assistant") for r, t in zip(roles, texts)])
                cuts = [*starts.tolist(), len(ids)]
                parts = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for x in (ids, mask)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *(pa.array(x, pa.binary()) for x in parts)], ["conv_id", "turn", "tie", "ids", "mask"])

    text, role = (F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role, text).withColumn("tie", F.concat_ws(":", "role", F.sha2("text", 256)))
    return rows.mapInArrow(run, "conv_id long, turn long, tie string, ids binary, mask binary")


def _decoded(decode, ids: np.ndarray) -> str:
    return decode(ids.tolist()).decode()


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per conversation, from its formatted tokens alone: turns and their digest, text under the loss mask and its digest, length of the formatted string."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(path).decode_bytes
        now, held, done = object(), None, []

        def flush() -> None:
            if held:
                done.append((now, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return batch

        for b in batches:
            for conv, raw, marked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held is None or conv != now:
                    flush()
                    now, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(marked, bool)
                turn, sep, end = np.flatnonzero(ids >= FIRST_RESERVED)
                role, text = _decoded(decode, ids[turn + 1 : sep]), _decoded(decode, ids[sep + 1 : end])
                held[0] += 1
                held[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                if mask.any():
                    loss = unescape(_decoded(decode, ids[mask]))
                    held[2] += len(loss)
                    held[3].update(loss.encode())
                held[4] += len(role) + len(text) + sum(map(len, MARKS.values()))
            if len(done) >= 1000:
                yield out()
        flush()
        yield out()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
