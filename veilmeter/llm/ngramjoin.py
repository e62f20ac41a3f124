"""Exact self-join of documents by the Jaccard similarity of their word n-grams: token-combination prefixes, then verification.

1. A text's set of hashed n-grams is made once, where the text lies. Equal sets fall together; each different set is a node.
2. Tokens (n-grams) are counted in counters by hash, some for each FILL tokens up to 2**WIDEST. A token's class comes from how far its counter
   lies above the mean: rare tokens are taken alone, more frequent ones in pairs, the most frequent ones in threes. Order: class, then
   how many deviations the counter lies above the mean, then hash, so that a prefix begins with what a text has of its own and what many share comes
   last. Any fixed order and classes give exact results.
3. Groups of near copies are settled first. A node has STARS keys, each made of its least tokens under two permutations. It is paired with the
   least node that shares a key; what isn't verified to be similar to any is paired with BACK other nodes of each key, and what is left with
   the node of each key that has the most links by then. So a group of any size has pairs linear in it, and those verified give first components.
4. A node's prefix is extended until it holds as many tokens as two sets of the least similarity must then share there: n - t + 1
   beyond what each class of k tokens may share without sharing a combination of k, at most k - 1. By the pigeonhole principle two similar
   sets have a single rare token or a combination of one class in common. Sets of less than 8 tokens are too small for this, and take all
   tokens alone. Pairs and threes are formed within subclasses (by hash, more of
   them for larger sets, so combinations grow with the prefix and not with its square), under the set's octave of size and the one below.
5. Inside a posting list, pairs of different components are compared by length and position (for combinations, by the number of tokens that
   aren't rare), in tiles. A pair counts by the first token of the order that both have, before which they share nothing. Nodes of one component are
   never paired, so a crowded list of near copies costs nothing.
6. Candidates, where they are many, pass an exact bound, the overlap of histograms of both sets' hashes, and are then verified on the whole
   sets. Verified links and the components of step 3 give the components, by star contraction.

Each exchange of a job takes a thread of the driver for a minute, so steps with nothing to do, and counts that need an exchange, are left out.

Sets are read where they were written; joins to them are broadcast only where the other side has at most SMALL rows, by count, and
shuffled else. Sets are compared by 64-bit hashes of their n-grams.

Defined cases: null text has no words: its set is empty, is linked with nothing, and its component is its own doc_id; so is a text
without words; fewer words than n make one n-gram of all; a null doc_id is a document that names no component unless alone, where it is
null; rows that share a doc_id are documents of their own; repeated rows are repeated; ties don't matter, as a component is named by its
smallest doc_id; very long texts are taken whole; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import dropped, slices, written
from veilmeter.llm.simhash import classes
from veilmeter.llm.words import Words, kinds, mixed, runs

SIZE = 5
NUM, DEN = 80, 100
KINDS = kinds([32, *range(9, 14)])
FEWEST, WIDEST = 16, 24  # counters, as a power of two
FILL = 16  # tokens to a counter
PLAIN = 3  # octaves of sizes below which all tokens are taken alone
SEGMENT = 1 << 11  # counters in a row
CLASSES = (4, 64)  # times the mean counter from which tokens are taken in pairs, and in threes
ABOVE = np.r_[np.arange(1, 6, 0.5), np.geomspace(6, 100_000, 50)]  # deviations above the mean counter that part ranks of a class; 63 at most
OWN = 8  # tokens of a prefix in a subclass
STARS, BACK, HUBS = 4, 4, 2
GROUP = 500  # nodes of a key that are put in one order
TILE = 256
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
HELD = 200_000  # pairs of a task before they are sent on
SMALL = 2_000_000  # rows of a side of a join that is broadcast
DIRECT = 20_000  # pairs that are verified at once, without histograms before
BATCH = 1000  # rows that a task exchanges with Python at once, as sets are long
SETS = "row long, doc_id long, k1 long, k2 long, n int, tokens binary"


def required(n: int) -> int:
    """What a set of n tokens has in common at least with any similar one."""
    return -(-NUM * n // DEN)


def token_sets(words: Words, size: int = SIZE) -> Iterator[np.ndarray]:
    """Of each text, its different n-grams' hashes in rising order."""
    h = words.hashes()
    for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield np.unique(runs(h[a:z], min(size, z - a))) if z > a else h[:0]


def sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """row, doc_id, k1, k2 (128 bits of the set), n, tokens (8 bytes each, rising) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for big in batches:
            for b in slices(big, 1):
                own = [s.tobytes() for s in token_sets(Words(b.column(1), KINDS), size)]
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), ">i8").reshape(-1, 2).astype(np.int64)
                n = pa.array([len(x) // 8 for x in own], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), n, pa.array(own, pa.binary())], ["doc_id", "k1", "k2", "n", "tokens"])

    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, k1 long, k2 long, n int, tokens binary")
    return written(made.select(F.monotonically_increasing_id().alias("row"), "*"), "sets", **{"parquet.enable.dictionary": "false", "compression": "uncompressed", "parquet.block.size": str(32 << 20)})


def small(df: DataFrame, most: int = SMALL, rows: int | None = None) -> DataFrame:
    """df, to be broadcast where it has at most so many rows (of a few numbers each). rows: what it has at most, if known without a job of its own."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def token_levels(nodes: DataFrame, total: int) -> np.ndarray:
    """The class of each counter, 0 (rare), 1 or 2, in two bits, and its rank in the others. total: the tokens of all nodes."""
    bits = min(WIDEST, max(FEWEST, (total // FILL).bit_length()))
    shift, mean = np.uint64(64 - bits), max(1.0, total / (1 << bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for some in slices(b, 0, 2000, 8 << 20):
                found = np.frombuffer(b"".join(some.column(0).to_pylist()), np.uint64)
                np.add.at(counters, (found >> shift).astype(np.int64), np.uint32(1))
        parts = counters.reshape(-1, SEGMENT)
        own = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(own), 1000):
            some = own[at : at + 1000]
            sent = [(x if x.max() > 65535 else x.astype(np.uint16) if x.max() > 255 else x.astype(np.uint8)).tobytes() for x in parts[some]]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sent, pa.binary())], ["segment", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, counters = {SEGMENT: np.uint8, 2 * SEGMENT: np.uint16, 4 * SEGMENT: np.uint32}, None, None

        def out() -> pa.RecordBatch:
            rank = np.searchsorted(mean + ABOVE * np.sqrt(mean), counters, side="right").astype(np.uint8)
            level = sum((counters >= c * mean).astype(np.uint8) for c in CLASSES) + 4 * rank
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([level.tobytes()], pa.binary())], ["segment", "data"])

        for b in batches:
            for segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if segment != now:
                    if now is not None:
                        yield out()
                    now, counters = segment, np.zeros(SEGMENT, np.int64)
                counters += np.frombuffer(data, kind[len(data)])
        if now is not None:
            yield out()

    schema = "segment long, data binary"
    summed = nodes.select("tokens").mapInArrow(count, schema).repartition("segment").sortWithinPartitions("segment").mapInArrow(add, schema)
    level = np.zeros(((1 << bits) // SEGMENT, SEGMENT), np.uint8)
    for r in summed.collect():  # 2**bits bytes at most, by one job where an iterator takes one a partition
        level[r["segment"]] = np.frombuffer(r["data"], np.uint8)
    return level.ravel()


def star_keys(nodes: DataFrame) -> DataFrame:
    """node, key: STARS keys of each node, each made of its least tokens under two permutations, where another node has the key too; first, the least
    such node, and m, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, keys = [], []
            for node, data in zip(b.column(0).to_pylist(), b.column(1)):
                t = np.frombuffer(data.as_buffer(), np.uint64)
                least = np.array([mixed(t ^ np.uint64(k * 0xA0761D6478BD642F % 2**64)).min() for k in range(1, 2 * STARS + 1)])
                own += [node] * STARS
                keys += mixed(least[::2] * np.uint64(0xD6E8FEB86659FD93) + least[1::2]).astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(keys, pa.int64())], ["node", "key"])

    keyed = nodes.select("row", "tokens").mapInArrow(run, "node long, key long")
    least = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).filter("m > 1")
    return written(keyed.join(least, "key"), "star-keys")


def stars(keys: DataFrame) -> DataFrame:
    """a, b: each node with the least of those that share a key with it."""
    return keys.filter("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def neighbours(keys: DataFrame, settled: DataFrame) -> DataFrame:
    """a, b: each node that no star has settled with the BACK nodes before it, in an order by hash, that share a key. Large groups are cut, so that none
    meets in one task."""
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / GROUP))
    order = Window.partitionBy("key", "cut").orderBy(F.xxhash64("node", "key"), "node")
    done = settled.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("done", F.lit(True))
    each = keys.withColumn("cut", cut).join(small(done, rows=2 * settled.count()), "node", "left")
    before = each.select("node", "done", F.array(*[F.lag("node", k).over(order) for k in range(1, BACK + 1)]).alias("x"))
    pairs = before.filter("done IS NULL").select("node", F.explode("x").alias("x")).filter("x IS NOT NULL")
    return pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def hubs(keys: DataFrame, settled: DataFrame) -> DataFrame:
    """a, b: each node that nothing has settled with the node of each of its keys that has the most links, as the original among its copies has."""
    degree = settled.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    each = keys.join(small(degree, rows=2 * settled.count()), "node", "left")
    best = each.filter("links IS NOT NULL").groupBy("key").agg(F.max(F.struct("links", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    pairs = each.filter("links IS NULL").join(best, "key")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def settle(nodes: DataFrame) -> DataFrame:
    """a, b: verified links that settle most of each group of near copies, in number linear in it."""
    keys = star_keys(nodes)
    found = verified(stars(keys), nodes, "stars")
    for step in (neighbours, *[hubs] * HUBS):
        more = verified(step(keys, found), nodes, step.__name__)
        if more.isEmpty():
            if step is hubs:  # once more would be the same pairs
                break
            continue
        found = found.unionByName(more)
    dropped(keys)
    return found


def prefix(tokens: np.ndarray, own: np.ndarray, octave: int) -> np.ndarray:
    """For tokens in order of their class (own), then hash: the group of each up to the extended prefix's end, 0 of rare ones, else its subclass."""
    n, groups = len(tokens), max(1, (1 << (octave + 1)) * (DEN - NUM) // DEN // OWN)
    base = n - required(n) + 1
    if octave < PLAIN or not own[base - 1]:
        return np.zeros(base, np.int64)
    own = own.astype(np.int64)
    group = np.where(own > 0, own + 2 * ((tokens >> np.uint64(8)) % np.uint64(groups)).astype(np.int64), 0)
    # What may be shared before a combination is: of a group of k-token combinations, k - 1 or all it has so far.
    place = np.zeros(n, np.int64)
    by = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
    place[by] = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    slack = ((own > 0) & (place < own)).cumsum()
    enough = np.flatnonzero(np.arange(1, n + 1) - slack >= base)
    return group[: int(enough[0]) + 1 if len(enough) else n]


def signatures(tokens: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's posting lists, and the place of each in the prefix, or, of a combination, -1 less the number of tokens that aren't rare: a set
    with combinations has all its rare tokens in its prefix, so what meets it in a combination alone shares none of them. tokens: rising."""
    n, own = len(tokens), level[(tokens >> np.uint64(65 - len(level).bit_length())).astype(np.int64)]
    if own.any():
        order = np.argsort((own & 3) << 6 | own >> 2, kind="stable")
        tokens, own = tokens[order], own[order] & 3
    common = int((own > 0).sum())
    single, cells = 0, {}
    for octave in {n.bit_length() - 1, required(n).bit_length() - 1}:
        group = prefix(tokens, own, octave)
        single = max(single, int((group == 0).sum()))
        if not group[-1]:
            continue
        for g in np.unique(group[group > 0]).tolist():
            k, members = (2 if g % 2 else 3), tokens[: len(group)][group == g]
            if len(members) >= k:
                x = members[np.array(list(combinations(range(len(members)), k)))]
                h = np.full(len(x), octave * 131 + k, np.uint64)
                for j in range(k):
                    h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + x[:, j])
                cells.update(dict.fromkeys(h.astype(np.int64).tolist()))
    keys = np.concatenate([tokens[:single].astype(np.int64), np.fromiter(cells, np.int64, len(cells))])
    return keys, np.concatenate([np.arange(single), np.full(len(cells), -1 - common)])


def postings(nodes: DataFrame, level: np.ndarray) -> DataFrame:
    """key, comp, node, n, at: an entry for each signature of each node. nodes: row, comp, tokens."""
    sent = nodes.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2, 500, 8 << 20):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(2)]
                keys, places = zip(*(signatures(t, sent.value) for t in own))
                sizes = list(map(len, keys))
                each = lambda x: pa.array(np.repeat(np.asarray(x), sizes))
                columns = [pa.array(np.concatenate(keys)), each(b.column(1).to_numpy()), each(b.column(0).to_numpy()), each(np.array(list(map(len, own)), np.int32)), pa.array(np.concatenate(places).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "comp", "node", "n", "at"])

    return nodes.select("row", "comp", "tokens").mapInArrow(run, "key long, comp long, node long, n int, at int")


def _may(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether rows (comp, node, n, at) of x and y are of different components and may be similar."""
    (xc, _, xn, xa), (yc, _, yn, ya) = x, y
    ok = (xc != yc) & (xn * DEN >= yn * NUM) & (yn * DEN >= xn * NUM)
    # The first token that both have, which is in both prefixes if any is that both have alone: from it on, no more than the shorter part.
    most = np.minimum(xn - xa, yn - ya)
    most = np.where((xa < 0) & (ya < 0), np.minimum(-1 - xa, -1 - ya), most)  # a pair that shares a rare token meets by that, too
    return ok & (most * (NUM + DEN) >= (xn + yn) * NUM)


def _crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs (a, b), a < b, of rows of x and y that may be similar."""
    i, j = np.nonzero(_may([c[:, None] for c in x.T], [c[None, :] for c in y.T]) & (x[:, None, 1] < y[None, :, 1]))
    return np.stack([x[i, 1], y[j, 1]], axis=1)


def crossed_pairs(entries: DataFrame) -> DataFrame:
    """a, b: different pairs of nodes of different components that meet in a posting list and may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, fresh, out = None, [], [], []  # the list's key; its tiles so far; rows not compared yet; pairs not sent yet

        def take() -> None:
            nonlocal held, fresh
            if fresh:
                tile = np.concatenate(fresh)
                if held or not (tile[:, 0] == tile[0, 0]).all():
                    out.extend([_crossed(tile, tile), *(p for t in held for p in (_crossed(tile, t), _crossed(t, tile)))])
                held, fresh = [*held, tile], []

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            """The pairs found, if there are so many."""
            nonlocal out
            if sum(map(len, out)) >= least:
                pairs = np.concatenate(out)
                pairs, out = pairs[np.lexsort(pairs.T)], []
                pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            key, rows = b.column(0).to_numpy(), np.stack([c.to_numpy().astype(np.int64) for c in b.columns[1:]], axis=1)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, int)
            # Lists of one entry, which most are, are passed over at once, those of two are compared at once; the batch's first and last may go on
            # elsewhere.
            size = np.diff(cuts)
            edge = np.isin(np.arange(len(size)), [0, len(size) - 1])
            two = cuts[:-1][(size == 2) & ~edge]
            own = two[_may(list(rows[two].T), list(rows[two + 1].T))]
            out.append(np.sort(np.stack([rows[own, 1], rows[own + 1, 1]], axis=1), axis=1))
            whole = np.flatnonzero((size > 2) | edge)
            for a, z in zip(cuts[whole].tolist(), cuts[whole + 1].tolist()):
                if key[a] != now:
                    take()
                    now, held, fresh = key[a], [], []
                for at in range(a, z, TILE):
                    fresh.append(rows[at : min(z, at + TILE)])
                    if sum(map(len, fresh)) >= TILE:
                        take()
                        yield from sent(HELD)
            yield from sent(1)
        take()
        yield from sent(1)

    dealt = entries.repartition("key").sortWithinPartitions("key", "comp", "node")
    return dealt.select("key", "comp", "node", "n", "at").mapInArrow(run, "a long, b long").distinct()


def histogram(tokens: np.ndarray) -> bytes:
    """Tokens in ranges of their hash, so many that a range has 8 to 16."""
    bits = max(0, len(tokens).bit_length() - 4)
    return np.bincount((tokens >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), minlength=1 << bits).astype(np.uint32).tobytes()


def may_overlap(x: bytes, y: bytes) -> bool:
    """Whether two histograms allow the overlap that similar sets have."""
    a, b = np.frombuffer(x, np.uint32).astype(np.int64), np.frombuffer(y, np.uint32).astype(np.int64)
    size = a.sum() + b.sum()
    while len(a) != len(b):
        a, b = (a.reshape(-1, 2).sum(axis=1), b) if len(a) > len(b) else (a, b.reshape(-1, 2).sum(axis=1))
    return bool(np.minimum(a, b).sum() * (NUM + DEN) >= size * NUM)


def similar(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return common * (NUM + DEN) >= (len(a) + len(b)) * NUM


def _held(pairs: DataFrame, found: DataFrame, test) -> DataFrame:
    """Those of pairs (a, b) whose data in found (node, data) pass test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2, 2000, 4 << 20):
                ok = [test(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()) for x, y in zip(b.column(2), b.column(3))]
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: found.select(F.col("node").alias(c), F.col("data").alias(f"{c}_data"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_data", "b_data")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets are similar. nodes: row, tokens."""
    pairs = written(pairs, f"{name}-pairs")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([histogram(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(1)], pa.binary())], ["node", "data"])

    def of(some: DataFrame, rows: int) -> DataFrame:
        ends = small(some.select(F.explode(F.array("a", "b")).alias("row")).distinct(), rows=2 * rows)
        return nodes.join(ends, "row", "left_semi").select(F.col("row").alias("node"), F.col("tokens").alias("data"))

    count = pairs.count()
    if not count:
        return pairs
    if count <= DIRECT:
        out = written(_held(pairs, of(pairs, count), similar), f"{name}-links")
    else:
        likely = written(_held(pairs, of(pairs, count).mapInArrow(bins, "node long, data binary"), may_overlap), f"{name}-likely")
        out = written(_held(likely, of(likely, likely.count()), similar), f"{name}-links")
        dropped(likely)
    dropped(pairs)
    return out


def components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    conf = docs.sparkSession.conf
    before = conf.get(ROWS)
    conf.set(ROWS, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:  # steps with sets are written in here
        return _components(docs, size)
    finally:
        conf.set(ROWS, before)


def _components(docs: DataFrame, size: int) -> DataFrame:
    rows = sets(docs, size)
    least = written(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.first("n").cast("long").alias("n")), "nodes")
    nodes = rows.join(small(least.select("row")), "row", "left_semi").select("row", "tokens")
    settled = settle(nodes)
    first = classes(settled)
    placed = nodes.join(small(first.select(F.col("point").alias("row"), F.col("root").alias("comp"))), "row", "left")
    level = token_levels(nodes, least.agg(F.sum("n")).first()[0] or 0)
    pairs = crossed_pairs(postings(placed.select("row", F.coalesce("comp", "row").alias("comp"), "tokens"), level))
    links = verified(pairs, nodes, "crossed")
    # The first components stand for the links that made them.
    root = first if links.isEmpty() else classes(first.select(F.col("point").alias("a"), F.col("root").alias("b")).unionByName(links))
    root = root.select(F.col("point").alias("row"), "root")
    dropped(settled, links)
    named = least.join(root, "row", "left").withColumn("root", F.coalesce("root", "row"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(ids, "root").select("k1", "k2", "component_id")
    out = rows.select("doc_id", "k1", "k2", "n").join(by_set, ["k1", "k2"], "left")
    own: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
