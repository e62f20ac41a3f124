"""Target models that are tables: smoothed class counts by key, and a unigram language model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmeter.operators.words import Words, kinds, looked_for, runs, slices
from veilmeter.sources.shared import dropped, written

CLASSES = 3
PAIRS = 2_000_000  # neighbours that are counted at once before they are rows
SLICE = 4 << 20  # bytes of text whose neighbours are taken at once
#: White space between tokens.
BLANKS = kinds([32, 9, 10, 13])


def count_model(samples: DataFrame, classes: int = CLASSES) -> DataFrame:
    """k, counts (one a class), total, of the members. A fine key remembers its members, a coarse one generalises."""
    counts = [F.sum((F.col("label") == j).cast("long")).alias(f"c{j}") for j in range(classes)]
    return samples.filter("is_member").groupBy("k").agg(*counts, F.count("*").alias("total")).select("k", F.array(*[f"c{j}" for j in range(classes)]).alias("counts"), "total")


def predict(samples: DataFrame, model: DataFrame, classes: int = CLASSES) -> DataFrame:
    """samples with proba (P(y|k) = (count + 1) / (total + classes)) and pred, the first class of the highest."""
    zero = F.array(*[F.lit(0).cast("long")] * classes)
    joined = samples.join(model, "k", "left").withColumns({"counts": F.coalesce("counts", zero), "total": F.coalesce("total", F.lit(0).cast("long"))})
    out = joined.withColumn("proba", F.transform("counts", lambda c: (c + 1).cast("double") / (F.col("total") + classes).cast("double")))
    return out.withColumn("pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))


def fit_predict(samples: DataFrame, classes: int = CLASSES) -> DataFrame:
    return predict(samples, count_model(samples, classes), classes)


def tokens(docs: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """doc_id, pos, token: lower-case words between white space."""
    words = F.filter(F.split(F.lower("text"), "[ \\t\\n\\r]+"), lambda w: w != "")
    return docs.select(F.col(id_name).alias("doc_id"), F.posexplode(words).alias("pos", "token"))


def unigram(member_tokens: DataFrame) -> DataFrame:
    return member_tokens.groupBy("token").agg(F.count("*").alias("c"))


def _lowered(docs: DataFrame, id_name: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_name).alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """token, c of the words of `tokens`: counted by parts of a task's texts before they are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 0, big.num_rows):
                known, own = looked_for(Words(b.column(0), BLANKS))
                yield pa.RecordBatch.from_arrays([known.column(), pa.array(np.bincount(own, minlength=known.size))], ["token", "c"])

    return _lowered(docs.withColumn("_", F.lit(0)), "_").select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def document_log_probs(docs: DataFrame, model: DataFrame, id_name: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """doc_id, lp: for each text, the different logp = ln((count + 1) / (total + vocabulary + 1)) of its words and how often it has each, in one row or two. The
    vocabulary's most frequent words, `most` at most, are sent to the tasks, so most words are looked up where the text lies; only others are rows."""
    model = written(model, "unigram")
    size = F.lit(model.agg((F.sum("c") + F.count("*") + 1).cast("double")).first()[0]).cast("double")
    least = _cut(model, "c", most)
    heavy = (model if least is None else model.filter(F.col("c") >= 2**least)).toArrow()
    known, own = looked_for(Words(heavy.column("token").combine_chunks(), BLANKS))
    counts = np.zeros(known.size, np.int64)
    counts[own] = heavy.column("c").to_numpy()
    sent, kind = docs.sparkSession.sparkContext.broadcast((known, counts)), docs.schema[id_name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for big in batches:
            for b in slices(big, 1, big.num_rows):
                words = Words(b.column(1), BLANKS)
                own, text = known.find(words, 0, len(words.starts), words.hashes()), words.texts()
                met = own >= 0
                other = np.flatnonzero(~met) if least is not None else np.zeros(0, np.int64)
                c = np.where(met, counts[np.where(met, own, 0)], 0) if len(counts) else np.zeros(len(own), np.int64)
                if least is not None:
                    c, text = c[met], text[met]
                key = np.sort(text << 40 | c)  # counts are below 2**40
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                text, c = key[first] >> 40, key[first] & ((1 << 40) - 1)
                pairs = pa.StructArray.from_arrays([pa.array(c), pa.array(np.diff(np.r_[first, len(key)]))], ["c", "n"])
                ends = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
                rest = pa.array([words.word(k).decode() for k in other.tolist()], pa.string())
                rest_ends = pa.array(np.searchsorted(words.texts()[other], np.arange(b.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pairs), pa.ListArray.from_arrays(rest_ends, rest)], ["doc_id", "lp", "rest"])

    found = _lowered(docs, id_name).mapInArrow(run, f"doc_id {kind}, lp array<struct<c:bigint,n:bigint>>, rest array<string>")
    each = found.select("doc_id", "lp")
    if least is not None:
        found = written(found, "found")
        light = model.filter(F.col("c") < 2**least).hint("merge")
        rest = found.select("doc_id", F.explode("rest").alias("token")).groupBy("doc_id", "token").count().join(light, "token", "left")
        rows = F.collect_list(F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.col("count").alias("n"))).alias("lp")
        each = found.select("doc_id", "lp").unionByName(rest.groupBy("doc_id").agg(rows))
    return each.select("doc_id", F.transform("lp", lambda x: F.struct(F.log((x["c"] + 1).cast("double") / size).alias("logp"), x["n"].alias("n"))).alias("lp"))


def _cut(table: DataFrame, weight: str, most: int) -> int | None:
    """The least power of two of weight from which on a table has at most `most` rows; None where it has no more in all."""
    if table.count() <= most:
        return None
    sizes = table.groupBy(F.floor(F.log2(F.col(weight))).cast("int").alias("b")).count().collect()  # a row a power of two
    above, least = 0, max(r["b"] for r in sizes) + 1
    for r in sorted(sizes, key=lambda r: -r["b"]):
        if (above := above + r["count"]) > most:
            break
        least = r["b"]
    return least


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 1_000_000) -> DataFrame:
    """rows with the columns of table, null where it has no such key, a left join. table is small or written: a large one is parted by weight, which says how often
    a key is met. Its heaviest keys, `most` at most, are broadcast, so that most rows stay where they are, and only the others are shuffled."""
    least = _cut(table, weight, most)
    if least is None:
        return rows.join(F.broadcast(table), key, "left")
    heavy, light = table.filter(F.col(weight) >= 2**least), table.filter(F.col(weight) < 2**least)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.hint("merge"), key, "left")
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def token_log_probs(all_tokens: DataFrame, model: DataFrame, most: int = 1_000_000) -> DataFrame:
    """doc_id, pos, logp = ln((count + 1) / (total + vocabulary + 1)). The vocabulary is written once, and its frequent words are broadcast."""
    model = written(model, "unigram")
    size = model.agg((F.sum("c") + F.count("*") + 1).cast("double").alias("size")).scalar()
    return looked_up(all_tokens, model, "token", "c", most).select("doc_id", "pos", F.log((F.coalesce("c", F.lit(0)) + 1).cast("double") / size).alias("logp"))


def word_salt(docs: DataFrame, code=F.xxhash64) -> int:
    """A salt by which all different words of docs have different 64-bit hashes: tried, not assumed, so a hash stands for its word exactly."""
    words = written(tokens(docs.select(F.lit(0).alias("doc_id"), "text")).select("token").distinct(), "words")
    salt = 0
    while not words.groupBy(code("token", F.lit(salt)).alias("h")).count().filter("count > 1").isEmpty():
        salt += 1
    dropped(words)
    return salt


def grams(docs: DataFrame, order: int, id_name: str = "doc_id", salt: int | None = None) -> DataFrame:
    """doc_id, pos, gram: each word with up to order - 1 words before it; the words are those of `tokens`, or with a salt their hashes by it, which are a
    third as large (see `word_salt`)."""
    words = F.filter(F.split(F.lower("text"), "[ \\t\\n\\r]+"), lambda w: w != "")
    words = words if salt is None else F.transform(words, lambda w: F.xxhash64(w, F.lit(salt)))
    own = docs.select(F.col(id_name).alias("doc_id"), words.alias("w")).filter(F.size("w") > 0)
    each = F.transform("w", lambda w, i: F.slice("w", F.greatest(i - (order - 2), F.lit(1)), F.least(i + 1, F.lit(order))))
    return own.select("doc_id", F.posexplode(each).alias("pos", "gram"))


def ngram_levels(member_grams: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """From level 1 to `order`: (gram, c), and (context, total, kinds) but for level 1. The highest level counts grams; each lower one
    counts in how many different words' company a gram is found, from the level above. Each is written once."""
    level = written(member_grams.filter(F.size("gram") == order).groupBy("gram").agg(F.count("*").alias("c")), "level")
    out: list[tuple[DataFrame, DataFrame | None]] = []
    for k in range(order, 1, -1):
        context = level.groupBy(F.slice("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        out.append((level, written(context, "context")))
        level = written(level.groupBy(F.slice("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("c")), "level")
    return [(level, None), *reversed(out)]


def ngram_log_probs(eval_grams: DataFrame, levels: list[tuple[DataFrame, DataFrame | None]], discount: float = 0.75, most: int = 500_000) -> DataFrame:
    """doc_id, pos, logp of every word but a text's first, by interpolation with an absolute discount: each level backs off to the next lower one, the
    lowest, with one added, knows every word. Different grams are looked up once, and texts join what was found. Grams meet their counts of the
    highest level by their own key, written once; of what is by a word or context, the frequent ones are broadcast."""
    lowest, order = levels[0][0], len(levels)
    size = lowest.agg((F.sum("c") + F.count("*") + 1).cast("double").alias("size")).scalar()
    distinct = eval_grams.filter("pos > 0").select("gram").distinct()
    top = levels[-1][0].withColumnRenamed("c", "c_top")
    scored = written(distinct.join(top.hint("merge"), "gram", "left") if order > 1 else distinct.withColumn("c_top", F.lit(0).cast("long")), "grams")
    own = scored.withColumn("word", F.slice("gram", -1, 1))
    scored = looked_up(own, lowest.withColumnRenamed("gram", "word"), "word", "c", most).select("gram", "c_top", ((F.coalesce("c", F.lit(0)) + 1).cast("double") / size).alias("p"))
    for k, (level, context) in enumerate(levels[1:], 2):
        long = F.size("gram") >= k
        keyed = scored.withColumns({"own": F.when(long, F.slice("gram", -k, k)), "context": F.when(long, F.slice(F.slice("gram", -k, k), 1, k - 1))})
        both = keyed.withColumn("c", F.when(long, F.col("c_top"))) if k == order else keyed.join(level.withColumnRenamed("gram", "own"), "own", "left")
        both = looked_up(both, context, "context", "total", most)
        p = F.greatest(F.coalesce("c", F.lit(0)) - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("p")
        scored = both.select("gram", "c_top", F.when(F.col("total").isNotNull(), p).otherwise(F.col("p")).alias("p"))
    return eval_grams.filter("pos > 0").join(scored.drop("c_top").hint("merge"), "gram").select("doc_id", "pos", F.log("p").alias("logp"))


def _neighbours(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word that has one before it in its text, and the 64-bit key of both."""
    later = np.ones(len(hashes), bool)
    later[words.first[:-1][words.counts > 0]] = False
    second = np.flatnonzero(later)
    return second, runs(hashes, 2)[second - 1].view(np.int64)


def pair_counts(docs: DataFrame, is_member: Column) -> DataFrame | None:
    """key, v, w, c, n of all different neighbours v, w of docs (text): how often members have them, and all. Words stand as 64-bit hashes, neighbours as one
    of both; that no two are alike is tried, and where they are there is no result. Parts of a task's texts are counted before they are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        names = ["word", "key", "v", "w", "c", "n"]

        def counted() -> pa.RecordBatch:
            key, v, w, member = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            at, n = order[first], np.diff(np.r_[first, len(key)])
            return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), *map(pa.array, (key[at], v[at], w[at], np.add.reduceat(member[order], first), n))], names)

        for big in batches:
            for b in slices(big, 0, big.num_rows, SLICE):
                words = Words(b.column(0), BLANKS)
                known, own = looked_for(words)
                if not known.size:
                    continue
                different = np.concatenate([x[0] for x in known.layers])
                none = pa.nulls(known.size, pa.int64())
                yield pa.RecordBatch.from_arrays([known.column(), pa.array(different.view(np.int64)), none, none, none, none], names)
                hashes = different[own]
                second, key = _neighbours(words, hashes)
                member = b.column(1).to_numpy(zero_copy_only=False)[words.texts()[second]].astype(np.int64)
                if len(key):
                    held.append((key, hashes[second - 1].view(np.int64), hashes[second].view(np.int64), member))
                if sum(len(x[0]) for x in held) >= PAIRS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    own = docs.select(F.coalesce(F.lower("text"), F.lit("")).alias("text"), F.coalesce(is_member, F.lit(False)).alias("is_member"))
    parts = written(own.mapInArrow(run, "word string, key long, v long, w long, c long, n long"), "pair-parts")
    differ = lambda c: F.min(c) != F.max(c)
    alike = parts.filter("word IS NOT NULL").groupBy("key").agg(differ("word").alias("alike")).filter("alike").isEmpty()
    one = parts.filter("word IS NULL").groupBy("key").agg(F.min("v").alias("v"), F.min("w").alias("w"), F.sum("c").alias("c"), F.sum("n").alias("n"), (differ("v") | differ("w")).alias("alike"))
    pairs = written(one, "pairs")
    dropped(parts)
    return pairs.drop("alike") if alike and pairs.filter("alike").isEmpty() else None


def pair_log_probs(docs: DataFrame, pairs: DataFrame, id_name: str = "doc_id", discount: float = 0.75, most: int = 2_000_000) -> DataFrame:
    """doc_id, lp: for each text, the different logp of its words but the first under the model of `ngram_log_probs` of order 2, and how often it has each, in
    one row or more. pairs: all neighbours of docs, by `pair_counts`. The most frequent ones, `most` at most, are sent to the tasks, so most are
    looked up where the text lies; only others are rows."""
    known = pairs.filter("c > 0")
    context = written(known.groupBy("v").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")), "context")
    lowest = written(known.groupBy("w").agg(F.count("*").alias("k")), "lowest")
    size = F.lit(lowest.agg((F.sum("k") + F.count("*") + 1).cast("double")).first()[0]).cast("double")
    both = looked_up(looked_up(pairs, lowest, "w", "k", 500_000), context, "v", "total", 500_000)
    low = (F.coalesce("k", F.lit(0)) + 1).cast("double") / size
    p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * low
    scored = written(both.select("key", "n", F.log(F.when(F.col("total").isNotNull(), p).otherwise(low)).alias("logp")), "scored")
    least = _cut(scored, "n", most)
    heavy = (scored if least is None else scored.filter(F.col("n") >= 2**least)).select("key", "logp").toArrow()
    keys, values = heavy.column("key").to_numpy(), heavy.column("logp").to_numpy()
    order = np.argsort(keys)
    sent, kind = docs.sparkSession.sparkContext.broadcast((keys[order], values[order])), docs.schema[id_name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        for big in batches:
            for b in slices(big, 1, big.num_rows, SLICE):
                words = Words(b.column(1), BLANKS)
                second, key = _neighbours(words, words.hashes())
                text = words.texts()[second]
                at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                met = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                own = np.sort(text[met] << 32 | at[met])  # of few million keys each has a number below 2**32
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                pairs = pa.StructArray.from_arrays([pa.array(values[own[first] & (2**32 - 1)]), pa.array(np.diff(np.r_[first, len(own)]))], ["logp", "n"])
                ends = lambda x: pa.array(np.searchsorted(x, np.arange(b.num_rows + 1)).astype(np.int32))  # noqa: B023, E731
                lists = [pa.ListArray.from_arrays(ends(own[first] >> 32), pairs), pa.ListArray.from_arrays(ends(text[~met]), pa.array(key[~met]))]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "lp", "rest"])

    found = _lowered(docs, id_name).mapInArrow(run, f"doc_id {kind}, lp array<struct<logp:double,n:bigint>>, rest array<bigint>")
    if least is None:
        return found.select("doc_id", "lp")
    found = written(found, "found")
    light = scored.filter(F.col("n") < 2**least).select("key", "logp").hint("merge")
    rest = found.select("doc_id", F.explode("rest").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n")).join(light, "key")
    return found.select("doc_id", "lp").unionByName(rest.groupBy("doc_id").agg(F.collect_list(F.struct("logp", "n")).alias("lp")))
