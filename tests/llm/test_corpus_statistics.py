"""Importance resampling, phrase mining and the n-gram join against plain versions on small and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilmeter.llm import ngramjoin, phrases, resample, words
from veilmeter.llm.common import table
from veilmeter.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, None, "en", "s", 1), (2, "", None, "s", 0), (3, " \n\n\t ", "en", None, 3), (4, "one", "en", "s", 3), (5, "12 34 !!", "en", "s", 5), (6, "a b c d e f g h. " * 3 + "\nlast line", "en", "s", None),
    (7, "a b c d e f g h. " * 3 + "\nlast line", "en", "s", 60), (7, "a b c d e f g h. " * 3 + "\nlast line", "en", "s", 60), (8, "naïve café 😀 " * 9000, "fr", "s", 1), (None, "no id but a text of its own " * 8, None, None, None),
    (9, "x" * 300_000 + " y " + "é" * 70, "de", "s", 2), (10, "A b C d E f G h. " * 3 + "\nlast LINE", "de", "s", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS n", "2 AS score", "3 AS node", "4 AS phrase", "5 AS above", "6 AS weight", "7 AS rank")


def test_words_of_a_column():
    kind = words.kinds([32, 9], b".,\n")
    texts = ["Ab ab\tAB.ab", None, "", "  ", "é é", "ab"]
    for column in (pa.array(texts), pa.array(["zz zz", *texts])[1:], pa.array(texts, pa.large_string())):
        w = words.Words(column, kind)
        assert w.counts.tolist() == [4, 0, 0, 0, 2, 1]
        h = w.hashes()
        assert len(set(h[[0, 1, 2, 3, 6]].tolist())) == 1 and h[4] == h[5] != h[0]
        assert [w.word(k).decode() for k in range(7)] == ["ab"] * 4 + ["é"] * 2 + ["ab"]
        p = w.pieces()
        assert p[0] == p[1] == p[2] != p[3] and len({p[3], p[4], p[6]}) == 3
    assert len(words.Words(pa.array([], pa.string()), kind).hashes()) == 0


def test_word_hashes_tell_words_apart_and_cross_chunks(monkeypatch):
    own = [f"{a}{b}" for a in "abcdefghij" for b in range(5000)]
    h = words.Words(pa.array([" ".join(own)]), words.kinds([32])).hashes()
    assert len(set(h.tolist())) == len(own)
    monkeypatch.setattr(words, "CHUNK", 50)
    assert (words.Words(pa.array([" ".join(own)]), words.kinds([32])).hashes() == h).all()


def plain_resample(rows, target, share=5):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    own = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: share * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_resample_equals_the_plain_version(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    target = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    got = QUERIES["op13_resample"](spark, sf_dir)
    assert rows_of(got) == plain_resample(docs, target) and any(r["rank"] for r in got.collect())


def test_resample_of_odd_rows(spark, odd):
    own = [(r[0], r[1]) for r in ODD]
    for share in (0, 5, 60, 100):
        got = resample.resample(odd, odd.filter("doc_id = 6"), share)
        assert rows_of(got) == plain_resample(own, [ODD[5][1]], share), share
    assert rows_of(resample.resample(odd, odd.filter("false"), 60)) == plain_resample(own, [], 60)
    assert resample.resample(odd.filter("false"), odd).count() == 0


def test_resample_of_many_equal_scores(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(k % 7, text) for k in range(400)] + [(k, f"{text} {k}") for k in range(7, 100)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text,)], "text string"), 50)
    assert rows_of(got) == plain_resample(rows, [text], 50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 247))


def plain_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    kept = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(g >= a and lang == x and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), g in f.items())
            if not inside:
                kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in kept.items() for r, x in enumerate(sorted(own)[:top]))


def test_phrases_of_a_small_corpus_in_every_setting(spark, odd):
    rng = np.random.default_rng(1)
    rows = [(k, "".join(rng.choice(["a b", " c", " a", "  b c d", ". ", ", A", "\té", "\n", " ab"], 60)), ["en", "de", None][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain_phrases([(r[2], r[1]) for r in rows], 10, 50)
    assert len(want) > 30
    assert sorted(map(tuple, phrases.mine(df, 10, 50).collect())) == want
    # More automata than one, and a sketch so full that all runs pass in rounds.
    assert sorted(map(tuple, phrases.mine(df, 10, 50, most=40).collect())) == want
    own = [(r[2], r[1]) for r in ODD]
    assert sorted(map(tuple, phrases.mine(odd, 3, 7).collect())) == plain_phrases(own, 3, 7)
    assert phrases.mine(odd.filter("false")).count() == 0


def test_phrases_in_rounds_and_long_texts_in_spans(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None, " ".join(rng.choice(list("abc.,"), 3000))) for _ in range(4)] + [("x", "a b " * 5000), ("x", "a b. " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = plain_phrases(rows, 100, 2000)
    w = words.Words(pa.array([t for _, t in rows]), phrases.KINDS)
    monkeypatch.setattr(phrases, "SCAN", 200)
    spans = list(phrases._spans(w.ends, w.starts, w.pieces(), w.first))
    assert len(spans) > 20 and sum(z - a for _, a, z in spans) == len(w.starts)
    monkeypatch.setattr(phrases, "FEWEST", 12)
    assert sorted(map(tuple, phrases.mine(df, widest=12).collect())) == want
    monkeypatch.setattr(phrases, "FILL", 1)
    assert sorted(map(tuple, phrases.mine(df, widest=14).collect())) == want


def test_phrases_of_many_candidates_are_counted_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], 400)) for _ in range(50)] + ["w1 w2. w3, w1 w2 w3"]
    w = words.Words(pa.array(texts), phrases.KINDS)
    runs = sorted({(i, k) for i in range(0, len(w.starts) - 5, 2) for k in range(1, 6) if w.texts()[i] == w.texts()[i + k - 1]})
    found = sorted({b" ".join(w.word(i + j) for j in range(n)).decode() for i, k in runs for n in range(1, k + 1)})
    table = pa.table({"id": pa.array(range(10, 10 + len(found)), pa.int64()), "lang": pa.array(["en"] * len(found)), "phrase": pa.array(found)})
    want = Counter(" ".join(x) for t in texts for piece in re.split("[.,]", t) for own in [piece.split()] for k in range(1, 6) for i in range(len(own) - k + 1) for x in [own[i : i + k]])
    for mask in (2**64 - 1, 7):  # then words of one hash, which are told by their bytes
        monkeypatch.setattr(phrases.Words, "hashes", lambda self, f=words.Words.hashes, mask=mask: f(self) & np.uint64(mask))
        own = phrases.compiled(table)
        got = Counter()
        for m, at in own.walk(np.zeros(len(w.starts), np.int64), w.pieces(), own.words(w, 0, len(w.starts), w.hashes())):
            got.update(found[k - 10] for k in own.ids[m][at].tolist())
        assert got == Counter({x: want[x] for x in found})
        monkeypatch.undo()
    size = sum(x.nbytes for x in [*own.steps, *own.ids])
    assert size <= 16 * len(found) and phrases.MOST >= 2_000_000  # what a task holds of 6 GB's candidates fits one pass


def test_counters_of_two_bytes_stay_at_a_bound():
    counters = np.zeros(4, np.uint16)
    for _ in range(3):
        phrases.raised(counters, np.r_[np.zeros(70_000, np.int64), np.ones(99, np.int64)])
    assert counters.tolist() == [phrases.ENOUGH, 297, 0, 0] and phrases.ENOUGH >= phrases.LEAST


def plain_components(rows, num=80, den=100):
    sets = []
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        met = Counter(j for x in s for j in holders.get(x, ()))
        for j, common in met.items():
            if den * common >= num * (len(s) + len(sets[j][1]) - common):
                parent[root(j)] = root(i)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)), key=repr)


def test_ngram_join_of_odd_rows(spark, odd):
    assert rows_of(ngramjoin.components(odd)) == plain_components([(r[0], r[1]) for r in ODD])
    assert ngramjoin.components(odd.filter("false")).count() == 0


def near_texts(seed, n=500):
    """Texts around the threshold: chains of edits, shared passages of many lengths, crowds, short ones, copies."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 4000, k)]
    passages, out = [word(int(k)) for k in (30, 60, 100, 200)], []
    bases = [word(int(k)) for k in rng.integers(1, 300, 40)]
    for _ in range(n):
        own = list(bases[int(rng.integers(len(bases)))])
        for _ in range(int(rng.integers(0, 1 + len(own) // 15))):
            own[int(rng.integers(len(own)))] = f"x{rng.integers(10**6)}"
        if rng.random() < 0.3:
            own = passages[int(rng.integers(4))] + own[: int(rng.integers(1, 60))]
        out.append(" ".join(own))
    return list(enumerate(out))


@pytest.mark.parametrize("classes", [(4, 64), (1, 1.5), (1.2, 10**9)])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, classes):
    monkeypatch.setattr(ngramjoin, "CLASSES", classes)
    if classes[0] < 4:  # so that the prefix join finds what stars would settle
        monkeypatch.setattr(ngramjoin, "settle", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    rows = near_texts(int(classes[0] * 10))
    assert rows_of(ngramjoin.components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for trial in range(400):
        level = rng.choice(np.array([0, 1, 2], np.uint8), 1 << 10, p=[0.2, 0.5, 0.3] if trial % 2 else [0, 0.5, 0.5])
        n = int(rng.choice([1, 2, 5, 7, 8, 9, 12, 20, 33, 64, 90, 300, 1000]))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.r_[rng.permutation(x)[: int(np.ceil(n * rng.uniform(0.8, 1)))], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)])
        assert ngramjoin.may_overlap(ngramjoin.histogram(x), ngramjoin.histogram(y)) or not ngramjoin.similar(x.tobytes(), y.tobytes())
        if ngramjoin.similar(x.tobytes(), y.tobytes()):
            a, b = (dict(zip(*ngramjoin.signatures(s, level))) for s in (x, y))
            met = [k for k in a if k in b]
            assert met, (trial, n)
            entry = [np.array([[k, k, len(s), d[c]] for c in met]) for k, (s, d) in enumerate(((x, a), (y, b)))]
            assert any(len(ngramjoin._crossed(entry[0][i : i + 1], entry[1][i : i + 1])) for i in range(len(met)))


def test_ngram_join_compares_lists_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TILE", 4)
    rows = [(7, c, n, 10, 0) for n, c in enumerate([1] * 9 + [2] * 3 + [3] * 5 + [4])] + [(8, 1, 1, 10, 0), (9, 5, 5, 10, 0), (9, 6, 6, 13, 0), (10, 5, 5, 10, 9), (10, 7, 7, 10, 0)]
    got = ngramjoin.crossed_pairs(spark.createDataFrame(rows, "key long, comp long, node long, n int, at int"))
    comp = {r[2]: r[1] for r in rows if r[0] == 7}
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in comp for b in comp if a < b and comp[a] != comp[b])


def test_ngram_join_of_a_shared_line_makes_few_candidates(spark):
    """Texts of words of their own and one line that all have are no candidates of one another, but for texts that are similar."""
    line, n = " ".join(f"shared{k}" for k in range(14)), 60
    texts = [" ".join(f"own{i}x{k}" for k in range(40)) + " " + line for i in range(n)]
    texts += [texts[0] + " end", texts[1] + " end"]
    rows = ngramjoin.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    level = ngramjoin.token_levels(rows, rows.selectExpr("sum(n)").first()[0])
    got = ngramjoin.crossed_pairs(ngramjoin.postings(rows.selectExpr("row", "row AS comp", "tokens"), level)).collect()
    docs = {r["row"]: r["doc_id"] for r in rows.collect()}
    found = {tuple(sorted((docs[r["a"]], docs[r["b"]]))) for r in got}
    assert {(0, n), (1, n + 1)} <= found and len(found) < 10


def test_ngram_join_takes_few_jobs_where_little_is_alike(spark):
    texts = [f"w{k} " + " ".join(f"x{(k * 7 + j) % 301}" for j in range(30)) for k in range(60)]
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    docs, before = spark.createDataFrame([*enumerate(texts), (60, texts[0] + " more"), (61, None)], "doc_id long, text string"), jobs()
    got = rows_of(ngramjoin.components(docs))
    assert got == plain_components([*enumerate(texts), (60, texts[0] + " more"), (61, None)])
    assert jobs() - before <= 110  # each exchange of a job keeps a thread of the driver for a minute


def test_ngram_join_verifies_many_pairs_as_it_does_few(spark, monkeypatch):
    texts = [" ".join(f"x{j}" for j in range(30)), " ".join(f"x{j}" for j in range(31)), " ".join(f"x{j}" for j in range(10, 50)), " ".join(f"y{j}" for j in range(30))]
    rows = ngramjoin.sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    row = {r["doc_id"]: r["row"] for r in rows.collect()}
    pairs = spark.createDataFrame([(row[a], row[b]) for a in row for b in row if a < b], "a long, b long")
    for most in (100, 0):
        monkeypatch.setattr(ngramjoin, "DIRECT", most)
        assert [tuple(r) for r in ngramjoin.verified(pairs, rows, "test").collect()] == [(row[0], row[1])]
    assert ngramjoin.verified(pairs.filter("false"), rows, "test").isEmpty()
