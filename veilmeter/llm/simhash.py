"""SimHash near-duplicates: 64-bit fingerprints of word shingles, exact links within a radius, connected classes.

Fingerprints are made where the texts lie; from then on only (doc_id, fingerprint) moves. Exact copies fall together first. Then
each different fingerprint is put into cells: of RADIUS + 1 bands of its bits, two fingerprints that differ in at most RADIUS
bits agree in one, so no link is lost. A cell that many share is cut again by bands of the other bits, by the same argument.
Inside a cell, sorted by the number of set bits, tiles are compared by numpy exclusive-or and bit counts; tile pairs whose
counts differ by more than the radius are skipped. A tile pair yields a spanning forest of its links, never all pairs. Classes
come from star contractions of that graph, each round written to the shared folder.

Defined cases: null text counts as empty; no words give fingerprint 0, which links like any other; null doc_id is a document
that is no class's smallest unless alone, where the class is null; repeated rows are repeated; ties don't matter, as a class is
named by its smallest doc_id; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.llm.common import dropped, text_or_empty, written

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 1024
CELL = 4096  # members beyond which a cell is cut again
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    count, total = len(words) - k + 1, np.zeros(64, dtype=np.int64)
    starts, ends = (end - size)[:count].tolist(), end[k - 1 :].tolist()
    for at in range(0, count, 65536):
        h = np.array([digest(view[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count).view(">i8")[0])


def fingerprints(docs: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id, fp (signed long) of every whole text; kind: the type of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, f"doc_id {kind}, fp long")


def bands(width: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part."""
    cut = [width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _bits(fp, first: int, size: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1))


def cells(points: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """band, value, sub, subvalue, fp: the cells of each different fingerprint."""
    own = bands(64, radius + 1)
    fp = F.col("fp")
    first = points.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), _bits(fp, *b).alias("value")) for k, b in enumerate(own)])).alias("c")).select("fp", "c.*")
    crowded = first.groupBy("band", "value").count().filter(F.col("count") > cell).select("band", "value", F.lit(True).alias("crowded"))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
    again = None
    for k, (at, size) in enumerate(own):
        # The other bits, as one number of 64 - size bits, in radius + 1 parts.
        low, high = _bits(fp, 0, at), F.shiftrightunsigned(fp, at + size) if at + size < 64 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, at))
        parts = F.array(*[F.struct(F.lit(j).alias("sub"), _bits(rest, *b).alias("subvalue")) for j, b in enumerate(bands(64 - size, radius + 1))])
        again = F.when(F.col("band") == k, parts) if again is None else again.when(F.col("band") == k, parts)
    return first.join(crowded, ["band", "value"], "left").select("band", "value", "fp", F.explode(F.when(F.col("crowded"), again).otherwise(whole)).alias("c")).select("band", "value", "c.*", "fp")


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, smallest point of its part) that connect what links of points a to points b connect."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        near &= np.tri(len(a), dtype=bool, k=-1)
    i, j = np.nonzero(near)
    if not len(i):
        return a[:0], a[:0]
    points, at = np.unique(np.concatenate([a[i].view(np.int64), b[j].view(np.int64)]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(points))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: edges between different fingerprints that connect the same classes as all pairs within the radius do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, fresh = None, [], []  # the cell; its compared tiles that are still within reach; points not compared yet

        def close() -> tuple[list, list]:
            """Compares the fresh points with themselves and the tiles within reach."""
            nonlocal held, fresh
            tile = np.array(fresh, dtype=np.int64).view(np.uint64)
            low = int(np.bitwise_count(tile[0]))
            held = [t for t in held if int(np.bitwise_count(t[-1])) >= low - radius]
            out = [forest(tile, tile, True, radius), *(forest(tile, t, False, radius) for t in held)]
            held, fresh = [*held, tile], []
            return [x for x, _ in out if len(x)], [y for _, y in out if len(y)]

        for batch in batches:
            xs, ys = [], []

            def take() -> None:
                if fresh and len(fresh) + sum(map(len, held)) > 1:
                    x, y = close()
                    xs.extend(x)
                    ys.extend(y)

            columns = [c.to_numpy() for c in batch.columns]
            keys = np.stack(columns[:4], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                key = tuple(keys[a].tolist())
                if key != now:
                    take()
                    now, held, fresh = key, [], []
                for at in range(a, b, TILE):
                    fresh = [*fresh, *columns[4][at : min(b, at + TILE)].tolist()]
                    if len(fresh) >= TILE:
                        take()
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (xs, ys)], ["a", "b"])
        if len(fresh) + sum(map(len, held)) > 1 and fresh:
            x, y = close()
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (x, y)], ["a", "b"])

    key = ["band", "value", "sub", "subvalue"]
    placed = cells(points, radius).repartition(*key).sortWithinPartitions(*key, F.bit_count("fp"), "fp")
    return placed.select(*[F.col(k).cast("long") for k in key], "fp").mapInArrow(run, "a long, b long").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """point, root: each point of the edges with the smallest point of its class. Large and small stars in turn, until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        old, edges = edges, written(small, "edges")
        dropped(old)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first()
        if state == before:
            return edges.select(F.col("a").alias("point"), F.col("b").alias("root"))
        before = state


def _classed(points: DataFrame, radius: int) -> DataFrame:
    """points (fp, least), with the root fingerprint of each one's class."""
    root = classes(links(points.select("fp"), radius))
    return points.join(root, points["fp"] == root["point"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the class) of every document."""
    prints = written(fingerprints(docs), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    named = _classed(points, radius)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "component_id")
    out = prints.join(by_print, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document, a whole row, of each class: the smallest by doc_id, null last, and the text's hash; of rows that repeat it, one."""
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")), 256)
    prints = fingerprints(docs.select(F.struct("doc_id", digest(F.col("text")).alias("h")).alias("doc_id"), "text"), "struct<doc_id: long, h: string>")
    row = F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id.doc_id").alias("kept_id"), F.col("doc_id.h").alias("kept_h"))
    points = written(prints.groupBy("fp").agg(F.min(row).alias("least")), "points")
    kept = _classed(points, RADIUS).groupBy("root").agg(F.min("least").alias("least")).select("least.kept_id", "least.kept_h")
    kept = written(kept, "kept")
    same = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (digest(docs["text"]) == kept["kept_h"]), "left_semi")
    return same.withColumn("_sh_h", digest(F.col("text"))).dropDuplicates(["doc_id", "_sh_h"]).drop("_sh_h")
