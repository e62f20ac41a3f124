"""Phrase mining: candidates from a sketch's upper bounds, exact counts by guarded automata, thresholds at the end.

1. Every word and pair of words inside a piece is hashed and counted in an array of counters, as wide as the corpus asks for up
   to 2**WIDEST; then so is every longer run, up to LONGEST words, all of whose pairs passed. A counter is never less than the count of
   any run that falls into it, so runs with one of their two counters below `least` are out, and longer ones that hold such a pair. Tasks send their counters as short binary rows, which are added up by range of counters; what goes on is a bit each.
   Where the widest array would be too full, the runs are dealt to rounds by their hash, each with an array of its own.
2. What passes is written once as (lang, phrase) with an id. It is a superset of the frequent runs, whatever the sketch's width.
3. Candidates are compiled into an automaton over words, as arrays: a state is a candidate, or a language to begin with, and a sorted array
   tells to which one a word leads on. Each word of a text begins a walk, all walks of a batch take their steps together, and none leaves
   its piece, so overlaps count. Words are told by their hash and then by their bytes, so counts are exact. A candidate that goes on from none is not
   frequent, as what it begins with isn't. At most MOST candidates, all those that begin with the same word among them, are in one automaton; further ones take
   further passes over the texts. Tasks send a count for each candidate that they met.
4. Single words are counted with the phrases, which gives both sides of every cut. Products are decimals of 38 digits.

Defined cases: null text is empty, null lang is `und`, the same as a lang of that name; a text without words counts for nothing;
equal scores go by count, then by the phrase's bytes; repeated rows count again; a very long text is scanned whole, cut at the ends
of its pieces; an empty table gives an empty table; only text and lang are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import slices, written
from veilmeter.llm.words import Lookup, Words, kinds, looked_for, mixed

LONGEST = 5
LEAST = 100
TOP = 2000
FEWEST, WIDEST = 18, 25  # the counters, as a power of two
FILL = 64  # bytes of text to a counter
TASKS = 3  # for each core
SMALL = 24  # up to so many counters, as a power of two, have four bytes each; more have two
ENOUGH = 20_000  # what a counter of two bytes is kept at; thresholds above it take four bytes
MOST = 2_000_000  # candidates in an automaton
SEGMENT = 1 << 11  # counters in a row
SCAN = 1 << 20  # bytes of a long text that are scanned at once, or a longer piece
SEEN, FRESH = 4_000_000, 100_000  # hashes of candidates that a task remembers having sent, and how many of them in a set
#: Blanks and tabs stand between words; stops, commas, signs and line ends part pieces.
KINDS = kinds([32, 9], [*b".,;:!?", *range(10, 14)])


def _seeds(langs: pa.Array) -> np.ndarray:
    import xxhash

    coded = langs.dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


class Runs:
    """The hashes of runs inside pieces, which depend on their language too: of single words, of pairs, and of longer runs all of whose pairs pass."""

    def __init__(self, words: Words, langs: pa.Array):
        self.piece = words.pieces()
        self.own = words.hashes() ^ _seeds(langs)[words.texts()]
        self.single = mixed(self.own)
        self.inside = self.piece[:-1] == self.piece[1:]
        self.pair = self._longer(self.single[:-1], self.own[1:])

    @staticmethod
    def _longer(runs: np.ndarray, more: np.ndarray) -> np.ndarray:
        return mixed(runs * np.uint64(0xD6E8FEB86659FD93) + more)

    def short(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """size, first word, hash."""
        yield 1, np.arange(len(self.single)), self.single
        first = np.flatnonzero(self.inside)
        yield 2, first, self.pair[first]

    def frequent(self, known: Known) -> np.ndarray:
        """Whether each pair passes, and both of its words."""
        single = known.passes(self.single)
        return self.inside & single[:-1] & single[1:] & known.passes(self.pair)

    def long(self, known: Known, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ok = self.frequent(known)
        first = np.flatnonzero(ok[:-1] & ok[1:])
        runs = self.pair[first]
        for size in range(3, longest + 1):
            if size > 3:
                on = first + size - 2 < len(ok)
                on[on] = ok[first[on] + size - 2]
                first, runs = first[on], runs[on]
            runs = self._longer(runs, self.own[first + size - 1])
            yield size, first, runs


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two counters of each hash, one in each half of 2**bits."""
    half = 1 << (bits - 1)
    return [(h >> np.uint64(65 - bits)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64(half - 1)).astype(np.int64) + half]


class Known:
    """A bit for each counter of each round: whether it reached the threshold."""

    def __init__(self, bits: int, rounds: int, packed: np.ndarray):
        self.bits, self.rounds, self.packed = bits, rounds, packed  # packed: round x byte

    def passes(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in places(h, self.bits):
            row = self.packed[0][at >> 3] if self.rounds == 1 else self.packed[(h % np.uint64(self.rounds)).astype(np.int64), at >> 3]
            out &= (row >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    for big in batches:
        for b in slices(big, 1):
            yield b.column(0), Words(b.column(1), KINDS)


def _own(docs: DataFrame) -> DataFrame:
    """What is read, in some tasks for each core: each sends what it has found of all candidates, so their number isn't to grow with the table."""
    docs = docs.coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def raised(counters: np.ndarray, at: np.ndarray) -> None:
    """Adds one at each place; counters of two bytes stay at ENOUGH, which reaches every threshold that they are for."""
    for k in range(0, len(at), 2 * ENOUGH):
        some = at[k : k + 2 * ENOUGH]
        np.add.at(counters, some, counters.dtype.type(1))
        if counters.dtype == np.uint16:
            counters[some] = np.minimum(counters[some], ENOUGH)


def frequent_bits(docs: DataFrame, bits: int, least: int, rounds: int, turn: int, shorter: Known | None = None) -> np.ndarray:
    """Packed bits: whether each of 2**bits counters reached `least`, of the runs whose turn it is: words and pairs, or the longer ones
    that pass by what is known of the shorter."""
    sent = None if shorter is None else docs.sparkSession.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint32 if bits <= SMALL or least > ENOUGH else np.uint16)
        for langs, words in _batches(batches):
            runs = Runs(words, langs)
            for _, _, h in runs.short() if sent is None else runs.long(sent.value):
                h = h if rounds == 1 else h[h % np.uint64(rounds) == turn]
                for at in places(h, bits):
                    raised(counters, at)
        parts = counters.reshape(-1, SEGMENT)
        own = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(own), 1000):
            some = own[at : at + 1000]
            data = [(x if x.max() > 65535 else x.astype(np.uint16) if x.max() > 255 else x.astype(np.uint8)).tobytes() for x in parts[some]]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(data, pa.binary())], ["segment", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {SEGMENT: np.uint8, 2 * SEGMENT: np.uint16, 4 * SEGMENT: np.uint32}
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["segment", "data"])

        for b in batches:
            for segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if segment != now:
                    if now is not None and (total >= least).any():
                        yield out()
                    now, total = segment, np.zeros(SEGMENT, np.int64)
                total += np.frombuffer(data, kind[len(data)])
        if now is not None and (total >= least).any():
            yield out()

    schema = "segment long, data binary"
    parts = _own(docs).mapInArrow(count, schema).repartition("segment").sortWithinPartitions("segment")
    out = np.zeros(((1 << bits) // SEGMENT, SEGMENT // 8), np.uint8)
    for r in parts.mapInArrow(add, schema).toLocalIterator():  # 2**bits / 8 bytes at most
        out[r["segment"]] = np.frombuffer(r["data"], np.uint8)
    return out.ravel()


def sketch(docs: DataFrame, least: int = LEAST, widest: int = WIDEST) -> tuple[Known, Known]:
    """What is known of words and pairs, and of longer runs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(widest, max(FEWEST, int(max(1, size // FILL)).bit_length()))
    rounds = max(1, -(-size // (FILL << bits)))
    short = Known(bits, rounds, np.stack([frequent_bits(docs, bits, least, rounds, k) for k in range(rounds)]))
    return short, Known(bits, rounds, np.stack([frequent_bits(docs, bits, least, rounds, k, short) for k in range(rounds)]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in an array in rising order."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def candidates(docs: DataFrame, known: tuple[Known, Known]) -> DataFrame:
    """id, lang, phrase: every run that may occur often enough in its language, once."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (short, long), seen, fresh = sent.value, np.zeros(0, np.uint64), set()
        for langs, words in _batches(batches):
            text, runs = words.texts(), Runs(words, langs)
            own_langs, phrases = [], []
            for known, found in ((short, runs.short()), (long, runs.long(short))):
                for k, first, h in found:
                    hit = runs.frequent(known)[first] if k == 2 else known.passes(h)
                    own, where = np.unique(h[hit], return_index=True)
                    new = ~_among(own, seen)
                    for x, i in zip(own[new].tolist(), first[hit][where[new]].tolist()):
                        if x not in fresh:
                            fresh.add(x)
                            own_langs.append(langs[int(text[i])].as_py())
                            phrases.append(b" ".join(words.word(j) for j in range(i, i + k)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(own_langs, pa.string()), pa.array(phrases, pa.string())], ["lang", "phrase"])
            if len(fresh) > FRESH:
                seen = np.union1d(seen if len(seen) < SEEN else seen[:0], np.fromiter(fresh, np.uint64, len(fresh)))
                fresh = set()

    return written(_own(docs).mapInArrow(pick, "lang string, phrase string").distinct().withColumn("id", F.monotonically_increasing_id()), "phrases")


@dataclass
class Automaton:
    """Candidates by their words. steps: for each length, state * (words) + word in rising order; a state's number is its place there after all shorter
    ones; ids: of each state."""

    langs: dict[str, int]
    known: Lookup
    steps: list[np.ndarray]
    ids: list[np.ndarray]

    def words(self, words: Words, a: int, z: int, hashes: np.ndarray) -> np.ndarray:
        """The number of each word from a to z, -1 for those of no candidate."""
        return self.known.find(words, a, z, hashes)

    def walk(self, langs: np.ndarray, pieces: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """length, and the place among the candidates of that length, of each candidate met. langs, pieces, own: of each word, its language's number (-1: none), piece, number."""
        first = np.flatnonzero((own >= 0) & (langs >= 0))
        state, before = langs[first], len(self.langs)
        for k, steps in enumerate(self.steps):
            if not len(first) or not len(steps):
                return
            if k:
                on = first + k < len(own)
                first, state = first[on], state[on]
                on = (pieces[first + k] == pieces[first]) & (own[first + k] >= 0)
                first, state = first[on], state[on]
            key = state * self.known.size + own[first + k]
            at = np.minimum(np.searchsorted(steps, key), len(steps) - 1)
            hit = steps[at] == key
            first, at = first[hit], at[hit]
            yield k, at
            state, before = at + before, before + len(steps)


def compiled(found: pa.Table, longest: int = LONGEST) -> Automaton:
    """found: id, lang, phrase."""
    coded = found.column("lang").combine_chunks().dictionary_encode()
    words = Words(found.column("phrase").combine_chunks(), KINDS)
    known, own = looked_for(words)
    langs, ids = coded.dictionary.to_pylist(), found.column("id").to_numpy()
    rows, state, before = np.flatnonzero(words.counts > 0), coded.indices.to_numpy().astype(np.int64), len(langs)
    steps, out = [], []
    for k in range(longest):
        key = state[rows] * known.size + own[words.first[rows] + k]
        ends = words.counts[rows] == k + 1
        order = np.argsort(key[ends])
        steps.append(key[ends][order])
        out.append(ids[rows[ends]][order])
        rows, key = rows[~ends], key[~ends]
        on = _among(key, steps[-1])
        rows = rows[on]
        state[rows] = np.searchsorted(steps[-1], key[on]) + before
        before += len(steps[-1])
    return Automaton({x: j for j, x in enumerate(langs)}, known, steps, out)


def _spans(ends: np.ndarray, starts: np.ndarray, pieces: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """text, first word, end: whole texts, long ones cut at the ends of pieces. first: of each text, its first word."""
    for t, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        while a < z:
            to = int(np.searchsorted(ends[a:z], starts[a] + SCAN, side="right")) + a
            if to < z:
                at = max(a, to - 1)
                more = np.flatnonzero(pieces[at + 1 : z] != pieces[at])
                to = at + 1 + int(more[0]) if len(more) else z
            yield t, a, to
            a = to


def counts(docs: DataFrame, found: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(id, f): how often each candidate that occurs does; (lang, n): the words of each language."""
    spark = docs.sparkSession
    sets = max(1, -(-found.count() // most))
    begins = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 1)), F.lit(sets))
    tables = []
    for k in range(sets):
        sent = spark.sparkContext.broadcast(compiled(found.filter(begins == k).select("id", "lang", "phrase").toArrow()))  # about `most` phrases

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, totals=k == 0) -> Iterator[pa.RecordBatch]:
            own, held = sent.value, Counter()
            sums = [np.zeros(len(x), np.int64) for x in own.ids]
            for langs, words in _batches(batches):
                names = langs.to_pylist()
                for lang, n in zip(names, words.counts.tolist()):
                    held[lang] += n
                if not own.known.size:
                    continue
                numbers = np.array([own.langs.get(x, -1) for x in names], np.int64)[words.texts()]
                hashes, pieces = words.hashes(), words.pieces()
                long = len(words.lower) > 2 * SCAN
                for _, a, z in _spans(words.ends, words.starts, pieces, words.first) if long else [(0, 0, len(hashes))]:
                    for m, at in own.walk(numbers[a:z], pieces[a:z], own.words(words, a, z, hashes)):
                        np.add.at(sums[m], at, 1)
            for ids, n in zip(own.ids, sums):
                met = np.flatnonzero(n)
                none = np.full(len(met), None, object)
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(none, pa.string()), pa.array(n[met])], ["id", "lang", "f"])
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([None] * len(held), pa.int64()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["id", "lang", "f"])

        tables.append(written(_own(docs).mapInArrow(scan, "id long, lang string, f long").groupBy("id", "lang").agg(F.sum("f").alias("f")), "counts"))
        sent.unpersist()
    both = reduce(DataFrame.unionByName, tables)
    return both.filter("id IS NOT NULL").select("id", "f"), both.filter("id IS NULL").select("lang", F.col("f").alias("n"))


def _joined(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two words or more, by its worst cut. counted: lang, phrase, f of phrases and words."""
    parts = counted.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    cut = parts.filter("m >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", _joined("w", F.lit(1), F.col("k")).alias("left"), _joined("w", F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    side = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = F.expr("1000BD * cast(a as decimal(14,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    worst = F.min(F.struct(whole.alias("score"), "k", "l", "r", "n", "a")).alias("b")
    return both.groupBy("lang", "phrase").agg(worst).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def closed(counted: DataFrame) -> DataFrame:
    """lang, phrase of those that no longer phrase always holds. A longer one as frequent has one of one more word between that is so too."""
    parts = counted.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    inner = F.explode(F.array(_joined("w", F.lit(1), F.col("m") - 1), _joined("w", F.lit(2), F.col("m") - 1)))
    longer = parts.filter("m >= 3").select("lang", inner.alias("phrase"), F.col("f").alias("g")).groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    both = parts.filter("m >= 2").join(longer, ["lang", "phrase"], "left")
    return both.filter(F.coalesce(F.col("g") < F.col("f"), F.lit(True))).select("lang", "phrase")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST, widest: int = WIDEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    known = sketch(docs, least, widest)
    found = candidates(docs, known)
    own, totals = counts(docs, found, most)
    counted = written(found.join(own.filter(F.col("f") >= least), "id").select("lang", "phrase", "f"), "frequent")
    each = scored(counted, totals).join(closed(counted), ["lang", "phrase"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
