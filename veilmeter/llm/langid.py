"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of its labelled rows. A text is parsed against each: a phrase
is the longest match with the sample from where the last one ended. The language that needs the fewest phrases for the text's
length wins. Automata are built once, on the driver, and sent as a few small arrays: a state's transitions lie at base[state] +
code of the letter, and states are laid over one another so that few places stay empty. A letter without a transition starts the
next phrase at the root. numpy walks many pieces of texts at once. Pieces of BLOCK letters are parsed as if a phrase began
there; then each is parsed again from the state in which its predecessor ended, until both parses begin a phrase at one place,
from where they agree. So phrases are those of the whole text.

Text is taken in lower case, letters only, with one space between words; every letter of a sample has a code of its own. The
fitting sample is bounded: by a hash of the row, as many whole ones as reach SAMPLE characters, of about ROWS a language. Rows of over LONGEST
characters come last, are looked at only where a language's others don't reach SAMPLE, and then give 4 * SAMPLE characters at most. Everything else covers all rows and whole texts.

Defined cases: `und` with score 0 for a null text, one without a letter, or when no language could be learned; equal rates go
to the first language in order of names; rows without a label aren't learned from; repeated rows count once in the sample, and
each gets its result; equal texts give equal results; an empty table gives an empty table; very long texts are parsed whole;
only doc_id, text and (to learn) lang are read, and other columns keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.llm.common import slices

ROWS = 64
LONGEST = 4_000
SAMPLE = 24_000
BLOCK = 512
REJECT = 0.01
RARE, SPACE = 0, 1  # codes: a letter of no sample; white space and all that isn't a letter


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def learn(docs: DataFrame, rows: int = ROWS) -> list[tuple[str, list[str]]]:
    """Per language, in order of names, its sample texts."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.coalesce(~_held_out(), F.lit(False)) & (F.length("text") > 0))
    own = own.withColumn("long", F.length("text") > LONGEST)
    short = F.sum((~F.col("long")).cast("long"))
    found = own.groupBy("lang").agg(short.alias("short"), F.count("*").alias("n"), F.sum(F.when(~F.col("long"), F.length("text"))).alias("held")).collect()  # a row a language
    if not found:
        return []
    least = {r["lang"]: 0.0 if (r["held"] or 0) >= SAMPLE or r["n"] == r["short"] else rows / (r["n"] - r["short"]) for r in found}
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, rows / max(1, r["short"])))])
    share_long = F.create_map(*[F.lit(x) for k, s in least.items() for x in (k, min(1.0, s))])
    hashed = own.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)) / 1e9)
    picked = hashed.filter(F.col("h") < F.when(F.col("long"), share_long[F.col("lang")]).otherwise(share[F.col("lang")]))
    picked = picked.select("lang", "long", "h", "doc_id", F.substring("text", 1, 4 * SAMPLE).alias("text")).distinct()
    by: dict[str, list[tuple]] = {}
    for r in picked.orderBy("long", "h", "doc_id").limit(4 * rows * len(found)).collect():
        by.setdefault(r["lang"], []).append((r["long"], r["h"], r["doc_id"], r["text"]))
    return [(lang, [x[3] for x in sorted(by[lang], key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0, x[3]))]) for lang in sorted(by)]


def letters(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        now = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return after


def laid_over(after: list[dict[int, int]], codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner, to: state s goes by code c to to[base[s] + c] if owner[base[s] + c] is s."""
    most = sum(map(len, after)) + codes
    free, base = bytearray(b"\1") * (2 * most), np.zeros(len(after), np.int64)
    owner, to = np.full(2 * most, -1, np.int32), np.zeros(2 * most, np.int32)
    start = {1: 0}
    for s in sorted(range(len(after)), key=lambda s: -len(after[s])):
        own = sorted(after[s])
        if not own:
            continue
        kind = min(len(own), 8)
        at = start.get(kind, max(start.values()))
        while True:
            at = free.find(1, at + own[0]) - own[0]
            if all(free[at + c] for c in own[1:]):
                break
            at += 1
        start[kind] = max(start.get(kind, 0), at - codes // 2)
        base[s] = at
        for c in own:
            free[at + c], owner[at + c], to[at + c] = 0, s, after[s][c]
        if at + 2 * codes > len(free) - codes:
            grown = len(free)
            free += bytearray(b"\1") * grown
            owner, to = np.concatenate([owner, np.full(grown, -1, np.int32)]), np.concatenate([to, np.zeros(grown, np.int32)])
    size = int(np.flatnonzero(owner >= 0).max(initial=0)) + codes + 1
    return base, owner[:size], to[:size]


class Model:
    """Languages, the code of each character, and the automata, one after another in the same arrays."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.names = [lang for lang, _ in samples]
        texts = []
        for _, own in samples:
            held, clean = 0, []
            for t in map(letters, own):  # whole rows, until they are enough
                if held >= SAMPLE:
                    break
                clean.append(t)
                held += len(t)
            texts.append(" ".join(clean))
        known = sorted(set().union(*texts) - {" "})
        self.code = np.fromiter((RARE if chr(k).isalpha() else SPACE for k in range(0x110000)), np.uint16 if len(known) < 65_000 else np.int32, 0x110000)
        for k, c in enumerate(known):
            self.code[ord(c)] = k + 2
        width, parts, self.roots = len(known) + 2, [], []
        states = places = 0
        for t in texts:
            after = suffix_automaton(self.code[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist())
            base, owner, to = laid_over(after, width)
            root = np.zeros(width, np.int64)
            for c, s in after[0].items():
                root[c] = s
            parts.append((base + places, np.where(owner >= 0, owner + states, -1), to + states, root + states))
            self.roots.append(states)
            states, places = states + len(after), places + len(owner)
        if parts:
            base, owner, to, first = map(list, zip(*parts))
            self.base, self.owner, self.to = (np.concatenate(x).astype(np.int32) for x in (base, owner, to))
            self.first = np.stack(first).astype(np.int32)  # language x code: where a phrase that begins with it goes on

    def step(self, k: int, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase begins with this letter; after a letter of no sample the state is the root."""
        at = self.base[state] + code
        begins = (self.owner[at] != state) | (state == self.roots[k])
        return np.where(begins, self.first[k][code], self.to[at]), begins

    def parsed(self, grid: np.ndarray, follows: np.ndarray, k: int) -> np.ndarray:
        """Phrases that begin in each column of grid (code, or -1 past the end); follows: whether a column goes on with the text of the one before."""
        steps, lanes = grid.shape
        began, state = np.zeros((steps, lanes), bool), np.full(lanes, self.roots[k], np.int32)
        for t, row in enumerate(grid):
            inside = row >= 0
            if inside.all():
                state, began[t] = self.step(k, state, row)
            else:
                own = np.flatnonzero(inside)
                state[own], began[t, own] = self.step(k, state[own], row[own])
        end, count = state, began.sum(axis=0, dtype=np.int64)
        after = began[::-1].cumsum(axis=0, dtype=np.int64)[::-1]  # phrases that begin at t or later
        todo = np.flatnonzero(follows)
        while len(todo):
            own, state, new = todo, end[todo - 1], np.zeros(len(todo), np.int64)
            where, again = np.arange(len(todo)), []
            for t in range(steps):
                inside = grid[t, own] >= 0
                if not inside.all():  # the text's end
                    count[own[~inside]] = new[where[~inside]]
                    own, state, where = own[inside], state[inside], where[inside]
                if not len(own):
                    break
                state, begins = self.step(k, state, grid[t, own])
                met = begins & began[t, own]
                if met.any():
                    count[own[met]] = new[where[met]] + after[t, own[met]]
                new[where[begins]] += 1
                own, state, where = own[~met], state[~met], where[~met]
            if len(own):  # whole columns without a common beginning: the next ones begin from another state
                count[own] = new[where]
                changed = own[end[own] != state]
                end = end.copy()
                end[own] = state
                again = changed[changed + 1 < lanes] + 1
                again = again[follows[again]]
            todo = np.asarray(again, dtype=np.int64)
        return count

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and its number of characters; 0 of a text without a letter."""
        lower = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[raw]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lower])
        space = codes == SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        codes, owner = codes[keep], owner[keep]
        keep = (codes != SPACE) | np.r_[owner[1:] == owner[:-1], np.zeros(min(1, len(owner)), bool)]  # no space at a text's end
        codes, owner = codes[keep], owner[keep]
        size = np.bincount(owner, minlength=len(texts))
        blocks = -(-size // BLOCK)
        lane_of = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        within = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        lanes = int(blocks.sum())
        grid = np.full((min(BLOCK, int(size.max(initial=0))), lanes), -1, dtype=np.int32)
        grid[within % BLOCK, first[owner] + within // BLOCK] = codes
        follows = np.ones(lanes, bool)
        follows[first[blocks > 0]] = False
        total = np.stack([np.bincount(lane_of, weights=self.parsed(grid, follows, k), minlength=len(texts)) for k in range(len(self.names))], axis=1)
        has = np.bincount(owner, weights=codes != SPACE, minlength=len(texts)) > 0
        return total, np.where(has, size, 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, size = self.phrases(texts)
        best = total.argmin(axis=1)
        ordered = np.sort(total, axis=1)
        # How far the best language is from the next; alone, how far from one phrase a character.
        next_one = ordered[:, 1] if len(self.names) > 1 else np.maximum(size, 1)
        score = np.where(size > 0, 1 - ordered[:, 0] / np.maximum(next_one, 1), 0.0).clip(0, 1)
        return [self.names[b] if s else "und" for b, s in zip(best.tolist(), size.tolist())], score


def _shared(docs: DataFrame):
    """The model, built once and sent as a broadcast: some 100 KB a language."""
    return docs.sparkSession.sparkContext.broadcast(Model(learn(docs)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = _shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2):
                lang, score = model.value.predict(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents, whole rows, whose language can be told: not `und`, and a score of at least `reject`."""
    model, where = _shared(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, where):
                lang, score = model.value.predict([t or "" for t in b.column(where).to_pylist()])
                yield b.filter(pa.array([x != "und" and s >= reject for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
