"""Near-duplicate lines: an exact set-similarity join with prefix, positional and length filters, in DataFrame functions alone.

A line is the set of its lower-case words. A line goes if an earlier line, by (doc_id, the text's hash where
rows share the doc_id, place in the text), has the same words or a Jaccard similarity of at least 4/5. Lines without a word stay.

1. Words are counted over all texts, in BUCKETS counters by hash, so the counts are small at any size. A word's rarity is its
   counter's order of magnitude, measured from the mean counter, and orders words with their hash, rare ones first; any fixed
   order gives exact results.
2. Each line becomes one row: its set's key, size, a parity signature (each word flips one of 128 bits), and its prefix, the
   rarest n - ceil(4n/5) + 1 words, in which two similar sets must share one. Equal sets fall together to their first line,
   a head. Keys are made from the words, by two hashes of each of them, of 64 and of 32 bits, and not from their codes of 59 bits: words
   that share a code only make candidates, which are verified on the words themselves.
3. Heads that are much alike in crowds are settled first: dealt out by a few of their words, each is held against the
   first head of a word or else the last few before it. Codes that are common everywhere are salted here.
4. Prefix words of heads are dealt out by word and joined with themselves: an earlier head with a later one that isn't settled,
   under length, position and signature filters. First only a part of the heads, under words that many have, is the earlier
   side, which settles most of what is left of crowds, so these don't give all their pairs; then all heads are.
5. Candidates are verified on the words themselves, fetched from the texts.

Which texts hold wanted lines is told by a bitmap before the join that decides exactly, so few texts are shuffled.

Defined cases: null text stays null and has no lines; an empty text is one blank line; null doc_id sorts first; rows that share
a doc_id, or have none, are told apart by their text's hash; of rows equal in both, all but one lose every line that has a word;
ties of equal lines are settled by place;
very long lines are sets like others; an empty table gives an empty table; further columns are kept by `dedup_lines` and
not read. Working columns begin with `_ld_`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import dropped, written

BUCKETS = 1 << 20
BITMAP = 1 << 22
FIRST = -(2**63)
NUM, DEN = 4, 5
PASSES = 2
SHARE, CROWD = 8, 24  # of heads, those that settle crowds; how many of them make a word crowded
PICKED = 3  # words of a head's prefix, besides the rarest, by which crowds are settled first
BACK = 3  # earlier heads of a word that a head is held against besides the first
SALTED, SALTS = 11, 32  # from this level of rarity on (of 15, the mean being 5), words are salted there
ROW = ["doc", "h", "pos"]  # a line's key, by which lines are ordered
XROW = [f"x{c}" for c in ROW]


def _parts(text: Column) -> Column:
    """The words of a text in lower case, repeats and empty ones included. Only texts that hold other white space than blanks pay for its translation."""
    low = F.lower(text)
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.split(F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low), " ")


def words(line: Column) -> Column:
    """The different words of a line, in lower case."""
    return F.array_distinct(F.array_remove(_parts(line), ""))


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t\\r\\x0b\\x0c]")


def _ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc")


def row_hash(docs: DataFrame) -> Column:
    """What tells rows of one doc_id, or of none, apart: the text's hash; 0 where no other row has the doc_id, so it costs nothing there."""
    shared = docs.select(_ident()).groupBy("doc").count().filter("count > 1")
    may = _told(shared, F.xxhash64("doc"))
    return F.when(may(F.xxhash64(_ident())), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")


def _literal(packed: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>")


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Levels of the counters from 0, the rarest, to 15, 16 of them to a number: a level more for each doubling, level 5 at the mean."""
    word = docs.select(F.explode(_parts(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''")
    counted = written(word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).alias("b")).count(), "counters")
    total = counted.agg(F.sum("count")).first()[0] or 0
    least = max(0, math.ceil(math.log2(max(1, total / buckets))) - 5)
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(F.log2("count")).cast("int") - least)).cast("long")
    # Shifts by a column: level * 2 ** (4 * place), where the last place may reach the sign bit.
    at = F.expr("cast((b % 16) * 4 as int)")
    packed = counted.select((F.col("b") / 16).cast("long").alias("i"), _shift("shiftleft", level, at).alias("v")).groupBy("i").agg(F.bit_or("v").alias("v"))
    out = [0] * (buckets // 16)
    for r in packed.collect():  # buckets / 16 numbers at any size
        out[r["i"]] = r["v"]
    dropped(counted)
    return out


def lines(docs: DataFrame, h: Column) -> DataFrame:
    """doc, h, pos, line of every line."""
    return docs.select(_ident(), h.alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def line_rows(docs: DataFrame, h: Column, buckets: int = BUCKETS) -> DataFrame:
    """doc, h, pos, k1, k2 (key of the set), n, sig (parity of each of 64 classes of words), odd (of the odd half of each), prefix (codes
    of the rarest words, rarest first) of every line with a word."""
    levels = _literal(rarity(docs, buckets))

    def code(x: Column) -> Column:
        own = _shift("shiftrightunsigned", levels[F.shiftright(x.bitwiseAND(F.lit(buckets - 1)), 4).cast("int")], (x.bitwiseAND(F.lit(15)) * 4).cast("int"))
        return F.shiftleft(own.bitwiseAND(F.lit(15)), 59).bitwiseOR(F.shiftrightunsigned(x, 5))

    def parity(one) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda sig, x: sig.bitwiseXOR(_shift("shiftleft", one(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    hashed = F.array_remove(F.array_distinct(F.transform(_parts(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    other = F.array_distinct(F.transform(F.array_remove(_parts(F.col("line")), ""), lambda w: F.hash(w)))
    k2 = F.aggregate(other, F.lit(0).cast("long"), lambda total, x: total.bitwiseXOR(F.xxhash64(x)))
    own = lines(docs, h).filter(has_word(F.col("line"))).select(*ROW, F.sort_array(hashed).alias("x"), k2.alias("k2"))
    coded = own.select(*ROW, F.xxhash64("x").alias("k1"), "k2", F.sort_array(F.transform("x", code)).alias("c"))
    n = F.size("c")
    own = (n - F.ceil(n * F.lit(NUM) / F.lit(DEN)) + 1).cast("int")
    return coded.select(
        *ROW, "k1", F.xxhash64("k2", n).alias("k2"), n.alias("n"), parity(lambda x: F.lit(1).cast("long")).alias("sig"),
        parity(lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(1))).alias("odd"), F.slice("c", F.lit(1), own).alias("prefix")
    )


def _before(a: str, b: str) -> str:
    return f"({a}doc < {b}doc OR ({a}doc = {b}doc AND ({a}h < {b}h OR ({a}h = {b}h AND {a}pos < {b}pos))))"


def _need(a_n: str, b_n: str) -> str:
    """The words that two sets of similarity 4/5 have in common at least."""
    return f"cast(floor(({NUM} * ({a_n} + {b_n}) + {NUM + DEN - 1}) / {NUM + DEN}) as int)"


def _alike(a: str, b: str, a_n: str, b_n: str) -> str:
    """Length and signature: what two sets of similarity 4/5 must pass."""
    return f"{a_n} * {DEN} >= {b_n} * {NUM} AND {b_n} * {DEN} >= {a_n} * {NUM} AND bit_count({a}odd ^ {b}odd) + bit_count({a}sig ^ {a}odd ^ {b}sig ^ {b}odd) <= {a_n} + {b_n} - 2 * {_need(a_n, b_n)}"


def _placed(a: str, b: str, a_n: str, b_n: str) -> str:
    """Position: what the first word that two such sets have in common must pass."""
    return f"least({a_n} - {a}at, {b_n} - {b}at) >= {_need(a_n, b_n)}"


def bitmap(rows: DataFrame, key: Column, size: int = BITMAP) -> DataFrame:
    """i, v: the words of a bitmap of fixed size that has two bits of each of the rows' keys."""
    b = rows.select(F.explode(F.array(*_bits(key, size))).alias("b"))
    one = _shift("shiftleft", F.lit(1).cast("long"), F.expr("cast(b % 64 as int)"))
    return b.select((F.col("b") / 64).cast("long").alias("i"), one.alias("v")).groupBy("i").agg(F.bit_or("v").alias("v"))


def _bits(key: Column, size: int) -> list[Column]:
    return [F.pmod(key, F.lit(size)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(size))]


def _told(rows: DataFrame, key: Column, size: int = BITMAP):
    """A function from a key column to whether the key may be among rows; it never misses one. A bitmap mostly full tells nothing and isn't
    used. The bitmap is a table of one row, which queries read by a subquery, so that it isn't part of their plans."""
    every = rows.sparkSession.range(size // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("v"))
    whole = bitmap(rows, key, size).unionByName(every).groupBy("i").agg(F.bit_or("v").alias("v"))
    # size / 64 numbers at any size
    whole = written(whole.agg(F.sum(F.bit_count("v")).alias("full"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")), "bitmap")
    full = whole.select("full").first()[0]
    if not full:
        return lambda k: F.lit(False)
    if full > 0.8 * size:
        return lambda k: F.lit(True)
    packed = whole.select("v").scalar()

    def bit(b: Column) -> Column:
        return _shift("shiftrightunsigned", F.get(packed, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def may(k: Column) -> Column:
        first, second = _bits(k, size)
        return bit(first) & bit(second)

    return may


def _place(prefix: str = "") -> Column:
    return F.xxhash64(*[f"{prefix}{c}" for c in ROW])


def verified(docs: DataFrame, h: Column, pairs: DataFrame) -> DataFrame:
    """Those of pairs (xdoc, xh, xpos, xn, doc, h, pos, n) whose lines are similar; one row a later line (doc, h, pos)."""
    pairs = written(pairs.distinct(), "pairs", compression="zstd")
    wanted = pairs.select(*ROW).union(pairs.select(*XROW))
    may = _told(wanted, _place())
    found = lines(docs, h).filter(may(_place())).select(*ROW, "line")
    both = pairs.join(found.select(*[F.col(c).alias(f"x{c}") for c in (*ROW, "line")]), XROW).join(found, ROW)
    # Rows equal in doc_id and text have equal lines at a place, so it doesn't matter which is found.
    alike = F.size(F.array_intersect(F.array_remove(_parts(F.col("line")), ""), F.array_remove(_parts(F.col("xline")), ""))) * (NUM + DEN) >= (F.col("n") + F.col("xn")) * NUM
    out = written(both.filter(alike).select(*ROW).distinct(), "alike")
    dropped(pairs)
    return out


def entries(heads: DataFrame) -> DataFrame:
    """A row for each prefix word of each head."""
    return heads.select(*ROW, "n", "sig", "odd", F.posexplode("prefix").alias("at", "code"))


def crowds(heads: DataFrame) -> DataFrame:
    """Candidate pairs of each head with an earlier head of some words of its prefix: the word's first head or, where that can't be
    similar, the earlier one whose rarest word is the least rare, as an original's is among its copies, or one of the last few. The words are the rarest
    and those of the least hash, which copies mostly have in common."""
    hashed = F.array_sort(F.transform("prefix", lambda c: F.struct(c.bitwiseAND(F.lit((1 << 59) - 1)).alias("h"), c.alias("c"))))
    picked = F.array_distinct(F.concat(F.slice("prefix", 1, 1), F.transform(F.slice(hashed, 1, PICKED), lambda x: x["c"])))
    few = heads.select(F.shiftright(F.get("prefix", F.lit(0)), 59).alias("level"), *ROW, "n", "sig", "odd", F.explode(picked).alias("code"))
    salt = F.when(F.col("code") >= SALTED << 59, F.pmod(_place(), F.lit(SALTS))).otherwise(F.lit(0))
    order = Window.partitionBy("code", "salt").orderBy(*ROW)
    own = F.struct("level", *ROW, "n", "sig", "odd")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    others = {"first": F.first(own).over(before), "plain": F.max(own).over(before)} | {f"back{k}": F.lag(own, k).over(order) for k in range(1, BACK + 1)}
    led = few.withColumn("salt", salt).withColumns(others)
    near = lambda x: F.when(F.expr(f"{x}.doc IS NOT NULL AND {_before(f'{x}.', '')} AND {_alike(f'{x}.', '', f'{x}.n', 'n')}"), F.struct(*[F.col(f"{x}.{c}") for c in (*ROW, "n")]))
    pairs = led.select(*ROW, "n", F.coalesce(*map(near, others)).alias("x")).filter("x IS NOT NULL")
    return pairs.select(*[F.col(f"x.{c}").alias(f"x{c}") for c in (*ROW, "n")], *ROW, "n")


def signed(heads: DataFrame, settled: DataFrame) -> DataFrame:
    """heads, a settled one's size with a minus: both sides of a join then read one shuffle."""
    may = _told(settled, _place())
    hit = heads.filter(may(_place())).join(settled.withColumn("done", F.lit(True)), ROW, "left")
    return heads.filter(~may(_place())).unionByName(hit.withColumn("n", F.when(F.col("done"), -F.col("n")).otherwise(F.col("n"))).drop("done"))


def near_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Candidate pairs of entries, of an earlier head and a later one that isn't settled. Both sides keep their columns' names, so where they
    are one table they read one shuffle."""
    size = "abs(a.n)"
    near = F.expr(f"a.code = b.code AND {_placed('a.', 'b.', size, 'b.n')} AND {_alike('a.', 'b.', size, 'b.n')} AND {_before('a.', 'b.')}")
    pairs = x.alias("a").join(y.alias("b"), near)
    return written(pairs.select(*[F.col(f"a.{c}").alias(f"x{c}") for c in ROW], F.expr(size).alias("xn"), *[F.col(f"b.{c}").alias(c) for c in (*ROW, "n")]), "near", compression="zstd")


def crowded_pairs(heads: DataFrame) -> DataFrame:
    """Candidate pairs whose earlier head is one of a SHARE-th of all, by the words that many of these have. What is similar to many heads is so settled by few."""
    some = entries(heads.filter(F.pmod(F.xxhash64(*ROW, F.lit("lead")), F.lit(SHARE)) == 0))
    may = _told(some.groupBy("code").count().filter(F.col("count") >= CROWD).select("code"), F.xxhash64("code"))
    return near_pairs(some.filter(may(F.xxhash64("code"))), entries(heads).filter(F.col("n") > 0).filter(may(F.xxhash64("code"))))


def joined(heads: DataFrame, passes: int = PASSES) -> DataFrame:
    """All candidate pairs. Words are dealt with in passes, so that only a part of the entries is on disk at once."""
    parts = [entries(heads).filter(F.pmod("code", F.lit(passes)) == k) for k in range(passes)]
    return reduce(DataFrame.union, [near_pairs(part, part) for part in parts])


def removed_lines(docs: DataFrame, buckets: int = BUCKETS, h: Column | None = None) -> DataFrame:
    """doc, h (row_hash), pos of the lines that go. Rows equal in doc_id and text count as one here."""
    h = row_hash(docs) if h is None else h
    rows = written(line_rows(docs, h, buckets), "lines", compression="zstd")
    first = F.min(F.struct(*ROW, "n", "sig", "odd", "prefix")).alias("f")
    heads = written(rows.groupBy("k1", "k2").agg(first, F.count("*").alias("m")).select("k1", "k2", "f.*", "m"), "heads", compression="zstd")
    shared = heads.filter("m > 1").select("k1", "k2", F.struct(*ROW).alias("f"))
    may = _told(shared, F.col("k1"))
    same = written(rows.filter(may(F.col("k1"))).select("k1", "k2", *ROW).join(shared, ["k1", "k2"]).filter(F.struct(*ROW) != F.col("f")).select(*ROW), "same")
    dropped(rows)
    settled = verified(docs, h, crowds(heads))
    own = heads.drop("k1", "k2", "m")
    few = crowded_pairs(signed(own, settled))
    more = verified(docs, h, few)
    last = written(signed(own, settled.union(more)), "signed", compression="zstd")
    dropped(heads, few)
    rest = joined(last)
    dropped(last)
    others = verified(docs, h, rest)
    out = written(same.union(settled).union(more).union(others).distinct(), "removed")
    dropped(same, settled, more, rest, others)
    return out


def dedup_lines(docs: DataFrame, buckets: int = BUCKETS, counted: bool = False) -> DataFrame:
    """The rows of docs, text without the lines that go; counted: a column n_kept is set from n_lines."""
    h, ident = row_hash(docs), _ident()
    gone = removed_lines(docs, buckets, h)
    may, twice = _told(gone, F.xxhash64("doc", "h")), _told(docs.select(ident, h.alias("h")).groupBy("doc", "h").count().filter("count > 1"), F.xxhash64("doc", "h"))
    key = F.xxhash64(ident, h)
    by_doc = gone.groupBy(F.col("doc").alias("_ld_doc"), F.col("h").alias("_ld_h")).agg(F.collect_list("pos").alias("_ld_gone"))
    # Of rows equal in doc_id and text, told apart by a number that is written with them, the first is treated as others are.
    copies = written(docs.filter(twice(key)).withColumns({"_ld_doc": ident, "_ld_h": h, "_ld_row": F.monotonically_increasing_id()}), "copies")
    first = copies.groupBy("_ld_doc", "_ld_h").agg(F.min("_ld_row").alias("_ld_row")).select("_ld_row", F.lit(True).alias("_ld_first"))
    copies = copies.join(first, "_ld_row", "left")
    once = docs.filter(~twice(key))
    hit = once.filter(may(key)).withColumns({"_ld_doc": ident, "_ld_h": h})
    own = [*docs.columns, "_ld_doc", "_ld_h"]
    own = [c for k, c in enumerate(own) if c not in own[:k]]
    touched = hit.select(own).unionByName(copies.filter("_ld_first").select(own)).join(by_doc, ["_ld_doc", "_ld_h"], "left")
    split = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_ld_gone"))
    kept = F.transform(stay, lambda k: F.get(split, k))
    none = F.col("_ld_gone").isNull() | F.col("text").isNull()
    blank = F.filter(split, lambda line: ~has_word(line))
    whole, later = once.filter(~may(key)), copies.filter(F.col("_ld_first").isNull())
    if counted:
        whole = whole.withColumn("n_kept", F.col("n_lines"))
        touched = touched.withColumn("n_kept", F.when(none, F.col("n_lines")).otherwise(F.size(stay).cast("long")))
        later = later.withColumn("n_kept", F.when(F.col("text").isNull(), F.col("n_lines")).otherwise(F.size(blank).cast("long")))
    touched = touched.withColumn("text", F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")))
    later = later.withColumn("text", F.array_join(blank, "\n"))
    return whole.unionByName(touched.select(docs.columns)).unionByName(later.select(docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, text without the lines that go, of every document; a null text has no lines."""
    count = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    had = F.when(F.col("text").isNull(), F.lit(0)).otherwise(count)
    out = dedup_lines(docs.select("doc_id", "text", had.alias("n_lines"), F.lit(0).cast("long").alias("n_kept")), counted=True)
    return out.select("doc_id", "n_lines", "n_kept", "text")
