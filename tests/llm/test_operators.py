"""The ten operators against plain versions that look at everything, on small tables and on odd ones."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmeter.llm import ann, audio, bpe, chat, langid, linededup, packing, quality, simhash, warc
from veilmeter.llm.common import table, tokenizer_path
from veilmeter.llm.queries import ORACLE_SQL, QUERIES

ODD = [
    (1, None, "en", "s", 1), (2, "", None, "s", 0), (3, "   \n\n\t ", "en", None, 3), (4, "one", "en", "s", 3), (5, "12 34 !!", "en", "s", 5),
    (6, "Same text here, twice over.\nA second line of the text here.", "en", "s", None), (7, "Same text here, twice over.\nA second line of the text here.", "en", "s", 60),
    (7, "Same text here, twice over.\nA second line of the text here.", "en", "s", 60), (8, "naïve café 😀 " * 9000, "fr", "s", 1), (None, "no id but a text of its own", None, None, None),
    (9, "<|endoftext|> </s>[INST] don't\x1cstop\x85 ἍΛΣ İstanbul", "de", "s", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    # Further columns under names that an operator might use itself.
    return df.selectExpr("*", "1 AS fp", "2 AS grp", "3 AS doc", "4 AS row", "5 AS ids", "6 AS n_kept", "7 AS _ld_doc", "8 AS kept_id")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_sql_of_the_queries(spark, sf_dir, duck, same):
    for name, sql in ORACLE_SQL.items():
        assert same(QUERIES[name](spark, sf_dir), duck, sql) > 0, name


def test_ann_recall_and_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] is not None}
    found = defaultdict(list)
    for r in QUERIES["op1_ann"](spark, sf_dir).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in (k for k in x if k % 100 == 0):
        best = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), k) for k, v in x.items() if k != q)[:10]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((x[k] - x[q]) ** 2).sum())) < 1e-12 for _, k, s in own)
        hits += len({k for _, k in best} & {k for _, k, _ in own})
    assert hits >= 0.9 * 10 * len(found)


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS list", "2 AS v")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 7), (100, 1, 0), (100, 2, 1), (100, 3, 7)]
    assert ann.search(df.filter("false")).count() == 0


def test_ann_repeated_ids_take_one_place(spark):
    rng = np.random.default_rng(9)
    x = {k: rng.normal(size=4) for k in range(60)}
    # Every row 12 times, and further off once more.
    rows = [(k, v.tolist()) for k, v in x.items() for _ in range(12)] + [(k, (v * 1.5).tolist()) for k, v in x.items() if k]
    found = sorted((r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=512, reach=1e9).filter("query_id = 0").collect())
    far = {k: min(np.linalg.norm(v - x[0]), np.linalg.norm(1.5 * v - x[0])) for k, v in x.items() if k}
    assert [k for _, k in found] == sorted(far, key=far.get)[:10]


def test_ann_recall_with_all_lists(spark):
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(256, 16))[rng.integers(0, 256, 65_536)] + 0.5 * rng.normal(size=(65_536, 16))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    found = defaultdict(set)
    for r in ann.search(df, F.pmod("vec_id", F.lit(1000)) == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 1000):
        far = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argsort(far)[:10].tolist()))
    print("recall", hits / (10 * len(found)))
    assert len(found) == 66 and hits >= 0.9 * 10 * len(found)


def test_ann_exact_setting(spark):
    x = np.random.default_rng(11).normal(size=(3000, 8))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    found = defaultdict(dict)
    for r in ann.search(df, probes=ann.MOST_LISTS, reach=float("inf")).collect():
        found[r["query_id"]][r["rank"]] = r["vec_id"]
    for q in range(0, len(x), 100):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        assert [found[q][k] for k in range(1, 11)] == np.argsort(far)[:10].tolist()


def test_ann_walk_over_many_lists():
    x = np.random.default_rng(12).normal(size=(8000, 6))
    index = ann.Index(x, 2000)
    held, far = index.search(x[:50], len(index.means))
    exact = np.sqrt(((index.means[None] - x[:50, None]) ** 2).sum(axis=2))
    assert len(index.means) >= 2000 and (np.sort(held, axis=1) == np.arange(len(index.means))).all()
    assert np.allclose(far, np.sort(exact, axis=1))
    few = index.search(x[:50], 64)[0]
    assert np.mean([len(set(a[:8]) & set(b[:8])) / 8 for a, b in zip(few, np.argsort(exact, axis=1))]) > 0.95


def test_language_held_out(spark, sf_dir, docs, odd):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.identify(docs).collect() if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows) > 0
    got = langid.identify(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {1, 2, 3, 5}
    assert langid.identify(odd.filter("false")).count() == 0 and langid.keep_identified(odd).columns == odd.columns


def _plain_phrases(sample: str, text: str) -> int:
    at = phrases = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, phrases = at + max(1, size), phrases + 1
    return phrases


def test_phrases_are_longest_matches():
    """Several languages and scripts, letters of no sample, texts of several pieces, and pieces that lie in the sample as a whole."""
    rng = np.random.default_rng(3)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    samples = {"aa": make("abcd ", 3000), "bb": make("bcdefgh ", 3000), "cc": make("".join(map(chr, range(0x4E00, 0x4E00 + 300))), 3000), "dd": "q"}
    samples = {k: langid.letters(v) for k, v in samples.items()}
    model = langid.Model([(k, [v]) for k, v in samples.items()])
    texts = [make("abcdefgh ", n) for n in (1, 7, 511, 512, 513, 1024, 4000)] + [samples["aa"][100:2500] + "xyz" + samples["bb"][:1600], samples["cc"][5:1500], "q" * 1400, "\u0431" * 700 + "abcd" * 200, samples["aa"]]
    texts = [langid.letters(t) for t in texts]
    total, size = model.phrases(texts)
    assert size.tolist() == list(map(len, texts))
    for t, row in zip(texts, total.tolist()):
        assert row == [_plain_phrases(s, t) for s in samples.values()]


def test_language_sample_holds_whole_rows(spark):
    rows = [(k, f"{x} text {x} of many words {x} number {k % 7}", x) for x in ("la", "lb", "lc") for k in range(40)]
    learned = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=30))
    assert sorted(learned) == ["la", "lb", "lc"] and all(set(t) <= {r[1] for r in rows if r[2] == x} for x, t in learned.items())


def test_audio_round_trip(spark, docs, texts, odd):
    for df, own in ((docs, texts), (odd, None)):
        for r in audio.op3(df).collect():
            if own is None:
                continue
            raw = own[r["doc_id"]].encode()
            padded = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(padded[-32:])
    assert audio.op3(odd).count() == len(ODD) and audio.op3(odd.filter("false")).count() == 0


def test_g711_fixed_points():
    assert audio.ULAW[0xFF] == 0 and audio.ULAW[0x00] == -32124 and audio.ULAW[0x80] == 32124
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x2A] == -32256


def test_adpcm_against_one_step_at_a_time():
    raw = np.random.default_rng(1).integers(0, 256, (3, 64), dtype=np.uint8)
    got = audio.decode_adpcm(raw)
    for block, out in zip(raw, got):
        sample, index, want = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88), []
        want.append(sample)
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + step * (nibble >> 2 & 1) + (step >> 1) * (nibble >> 1 & 1) + (step >> 2) * (nibble & 1)
                sample = max(-32768, min(32767, sample - change if nibble & 8 else sample + change))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[nibble & 7])))
                want.append(sample)
        assert out.tolist() == want


def test_quality(spark, sf_dir, docs, odd):
    labels = table(spark, sf_dir, "labels")
    grade = {r["doc_id"]: r["grade"] for r in quality.graded(labels).collect()}
    rows = [(r["p_good"], grade[r["doc_id"]] == 2) for r in quality.classify(docs, labels).collect() if r["doc_id"] in grade]
    good, bad = [p for p, g in rows if g], [p for p, g in rows if not g]
    assert np.mean([a > b for a in good for b in bad]) > 0.75
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(not r["keep"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.classify(odd.filter("false"), labels.filter("false")).count() == 0
    assert all(r["p_good"] == 1 for r in quality.classify(docs, labels.filter("false")).collect() if r["doc_id"] in grade)


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.array([g * 10 + k for k in rng.integers(0, 5, 3)])) for g in grades]
    weights, cuts = quality.fit(grades, rows, np.bincount(grades).astype(float))
    assert cuts[0] < cuts[1]
    means = [np.mean([weights[r].sum() for r, x in zip(rows, grades) if x == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_fit_is_the_maximum_of_a_plain_likelihood():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(400)]
    grades = np.array([min(2, int((r.sum() + rng.integers(0, 6)) // 6)) for r in rows])
    counts = np.array([1000.0, 400.0, 700.0])
    weights, cuts = quality.fit(grades, rows, counts, rounds=3000, sparse=0, rare=0)

    def plain(w, t) -> float:
        total = 0.0
        for g, r in zip(grades, rows):
            below = [0.0, *(1 / (1 + np.exp(sum(w[f] for f in r) - x)) for x in t), 1.0]
            total += counts[g] / (grades == g).sum() * np.log(below[g + 1] - below[g])
        return total / counts.sum() - 0.5e-4 * float((w**2).sum())

    w = weights[:6]
    best = plain(w, cuts)
    for k in range(8):
        for d in (-0.05, 0.05):
            v, t = w.copy(), cuts.copy()
            (v if k < 6 else t)[k if k < 6 else k - 6] += d
            assert plain(v, t) < best + 1e-5
    grade, good = quality.grade_texts(["some words here", ""], weights, cuts)
    s = sum(weights[f] for f in quality.features(["some words here"])[0])
    tails = [1 / (1 + np.exp(x - s)) for x in cuts]
    assert np.allclose([grade[0], good[0]], [sum(tails), tails[1]]) and grade[1] == good[1] == 0


def test_quality_of_rows_not_fitted_on(spark, sf_dir):
    # sf0.001 has 43 rows to judge by, of which 8 aren't good: too few (0.61 there, 0.74 of 208 rows at sf0.01).
    large = f"{sf_dir}/../sf0.1"
    docs, labels = table(spark, large, "documents"), table(spark, large, "labels")
    part = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)) == 0
    grade = {r["doc_id"]: r["grade"] for r in quality.graded(labels.filter(~part)).collect()}
    rows = [(r["p_good"], grade[r["doc_id"]] == 2) for r in quality.classify(docs, labels.filter(part)).collect() if r["doc_id"] in grade]
    good, bad = np.array([p for p, g in rows if g]), np.array([p for p, g in rows if not g])
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    print("held-out AUC", auc, len(good), len(bad))
    assert auc > 0.85


def test_packing(docs, texts, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    for df, own in ((docs, texts), (odd, {r[0]: r[1] or "" for r in ODD})):
        ids = {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in own.items()}
        pieces, sequences = packing.pack(df).collect(), defaultdict(list)
        parts = defaultdict(set)
        for p in pieces:
            x = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert (zlib.crc32(x.tobytes()), len(ids[p["doc_id"]])) == (p["ids_crc32"], p["doc_tokens"]) and len(x) == p["length"]
            parts[p["doc_id"]].add((p["start"], p["length"]))
            sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        for k, x in ids.items():
            at = 0
            for start, length in sorted(parts[k]):
                assert start == at
                at += length
            assert at == len(x)
        for own_pieces in sequences.values():
            at = 0
            for offset, length in sorted(own_pieces):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(odd.filter("false")).count() == 0


def test_first_fit_against_a_plain_scan():
    lengths = sorted(np.random.default_rng(3).integers(1, 2049, 500).tolist(), reverse=True)
    room, want = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(2048)
        want.append((k, 2048 - room[k]))
        room[k] -= n
    assert list(zip(*packing.first_fit(lengths))) == want


def test_bpe_equals_the_library(docs, texts, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    tok.no_truncation()
    tok.no_padding()
    for df, own in ((docs, texts), (odd, {r[0]: r[1] or "" for r in ODD})):
        for r in bpe.round_trip(df).collect():
            ids = tok.encode(own[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(odd.filter("false")).count() == 0


def test_bpe_long_piece():
    model = bpe.load(tokenizer_path(bpe.VOCABULARY))
    word = ("abracadabra" * 12).encode()
    ids = [int(model.byte_id[b]) for b in word]
    rank = {(k >> 16, k & 0xFFFF): (r, int(model.merged[r])) for k, r in zip(model.keys.tolist(), model.ranks.tolist())}
    while best := min(((rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None):
        ids[best[1] : best[1] + 2] = [int(model.merged[best[0]])]
    assert np.frombuffer(model.merge_long(word), "<u4").tolist() == ids


def _components(prints: dict[int, int], radius: int) -> dict[int, int]:
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def _plain_fingerprint(text: str) -> int:
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[j : j + k]).encode(), seed=42) for j in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts, odd):
    for df, own in ((docs, texts), (odd.filter("doc_id IS NOT NULL"), {r[0]: r[1] or "" for r in ODD if r[0] is not None})):
        prints = {k: _plain_fingerprint(t) for k, t in own.items()}
        want = _components(prints, 4)
        for r in simhash.near_duplicates(df).collect():
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(odd.filter("false")).count() == 0
    assert simhash.keep_first(odd).columns == odd.columns


def test_simhash_cut_cells(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 62, 40).tolist()
    points = sorted({s ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    want = _components({p: p for p in points}, 4)
    # Cells of more than 5 members are cut again; no link may be lost.
    old, simhash.cells.__defaults__ = simhash.cells.__defaults__, (4, 5)
    try:
        got = {r["point"]: r["root"] for r in simhash.classes(simhash.links(df)).collect()}
    finally:
        simhash.cells.__defaults__ = old
    assert {p: got.get(p, p) for p in points} == want


def test_simhash_cells_that_end_with_a_tile(spark):
    rng = np.random.default_rng(6)
    # Cells by the lowest 12 bits: of one, two and almost two tiles, and small ones between them.
    points = []
    for low, size in enumerate((simhash.TILE, 2, 2 * simhash.TILE, 3, simhash.TILE + 500, 1, simhash.TILE)):
        high = rng.integers(0, 1 << 51, size - size // 4).tolist()
        high += [h ^ (1 << int(rng.integers(0, 51))) for h in high[: size // 4]]
        points += [h << 12 | low for h in high]
    points = np.array(sorted(set(points)), dtype=np.uint64)
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    far = np.concatenate([np.bitwise_count(points[k : k + 256, None] ^ points[None, :]) for k in range(0, len(points), 256)])
    want = {int(p): int(p) for p in points}
    for i, j in np.argwhere(far <= 4):  # classes here are pairs
        want[int(points[i])] = min(want[int(points[i])], int(points[j]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in ("10000", "900"):  # of batches: 900 rows cut every large cell
            spark.conf.set(name, rows)
            got = {r["point"]: r["root"] for r in simhash.classes(simhash.links(df)).collect()}
            assert {p: got.get(p, p) for p in want} == want
    finally:
        spark.conf.set(name, before)


def test_keep_first_keeps_one_row_of_each_class(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 60))
    a, b, c, d, e, f = (text() for _ in range(6))
    # Unlike texts without an id and under one id; copies of a text under an id and without one; rows that repeat.
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (None, c), (3, e), (None, e), (4, f), (4, f), (None, None), (None, "")]
    got = sorted(((r["doc_id"], r["text"] or "") for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d), (3, e), (4, f), (None, "")], key=str)


def test_chat(spark, sf_dir):
    rows, turns = table(spark, sf_dir, "conversations").collect(), defaultdict(list)
    for r in rows:
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    got = QUERIES["op8_chat_format"](spark, sf_dir).collect()
    assert len(got) == len(turns)
    for r in got:
        own = sorted(turns[r["conv_id"]], key=lambda t: t[0])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes_are_reversible(spark):
    for x in ("<|turn|>", "<\\|turn|>", "<\\\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>>", "<", "[", "a\\b", "<|im_start|><|im_start|>"):
        assert chat.unescape(chat.escape(x)) == x
        assert not any(c in chat.escape(x) for c in chat.CONTROL)
    rows = [(1, 0, None, None), (1, 0, "assistant", ""), (None, 1, "user", "x"), (2, 5, "assistant", "<|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS tie")
    assert {(r["conv_id"], r["n_turns"]) for r in chat.op8(df).collect()} == {(1, 2), (None, 1), (2, 1), (-7, 2)}
    assert chat.op8(df.filter("false")).count() == 1


def test_lines(spark, odd):
    got = {r["doc_id"]: r for r in linededup.line_report(odd).collect()}
    assert (got[1]["text"], got[1]["n_lines"], got[2]["n_lines"], got[2]["n_kept"]) == (None, 0, 1, 1)
    assert got[6]["n_kept"] == 2 and got[7]["n_kept"] == 0 and got[3]["n_kept"] == 3
    assert linededup.dedup_lines(odd).columns == odd.columns and linededup.line_report(odd.filter("false")).count() == 0


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    words, rows = [f"w{k}" for k in range(40)], []
    for doc in range(60):
        base = rng.choice(words, rng.integers(3, 14), replace=False).tolist() if doc % 3 == 0 or not rows else rows[-1][1].split("\n")[0].split(" ")
        second = [w for w in base if rng.random() > 0.08] + (["extra"] if rng.random() < 0.3 else [])
        rows.append((doc, " ".join(base) + "\n" + " ".join(rng.permutation(second or ["z"]))))
    flat = [(d, p, frozenset(line.split())) for d, t in rows for p, line in enumerate(t.split("\n"))]
    want = {(d, p) for k, (d, p, s) in enumerate(flat) if any(5 * len(s & x) >= 4 * len(s | x) for _, _, x in flat[:k])}
    for buckets in (64, 1 << 12):
        gone = linededup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), buckets)
        assert {(r["doc"], r["pos"]) for r in gone.collect()} == want


def test_lines_of_rows_without_an_id_of_their_own(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(8)) for x in "abcde")
    near = " ".join(b.split()[:7])
    # Places that go in one row stay in others; matches in every version are found; of equal rows one keeps its lines.
    rows = [(None, f"{a}\n{a}"), (None, f"{c}\n{d}"), (5, e), (5, f"{b}\nown line of the second version"), (6, f"{e}\n{near}\nlast words"), (7, "twice here\n\nand here"), (7, "twice here\n\nand here"), (8, None), (8, None)]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_kept"], r["text"]) for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(None, 2, 1, a), (None, 2, 2, f"{c}\n{d}"), (5, 1, 1, e), (5, 2, 2, f"{b}\nown line of the second version"), (6, 3, 1, "last words"), (7, 3, 3, "twice here\n\nand here"), (7, 3, 1, ""), (8, 0, 0, None), (8, 0, 0, None)]
    assert got == sorted(want, key=str)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, None, None), (4, "http://c\r\nd", "short"), (5, "u", "short"), (None, "v", "y" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS kept", "2 AS n")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.op10(pages).collect()}
    assert got == {1: ("revisit", 2, 2000), 2: ("response", None, 2000), 3: ("response", None, 0), 4: ("response", None, 5), 5: ("response", None, 5), None: ("response", None, 1200)}
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    only = warc.read(spark, path).filter("record_type = 'revisit'")
    assert [(r["page_id"], r["payload"]) for r in only.collect()] == [(1, None)]
    heads = warc.read(spark, path, ["page_id", "payload_bytes"]).filter("payload_bytes >= 1000")
    assert sorted(r["page_id"] or 0 for r in heads.collect()) == [0, 1, 2]
    assert warc.op10(pages.filter("false")).count() == 0


def test_warc_writes_add_up_and_overwriting_replaces(spark, tmp_path):
    make = lambda *ids: spark.createDataFrame([(k, f"http://{k}", f"{k} " * 9000) for k in ids], "page_id long, url string, html string")
    path = f"file://{tmp_path}/twice"
    ids = lambda **how: sorted(r["page_id"] for r in warc.read(spark, path, ["page_id", *how]).collect())
    warc.write(make(1, 2), path)
    warc.write(make(3), path)
    assert ids() == [1, 2, 3]
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, path).collect()} == {k: f"{k} " * 9000 for k in (1, 2, 3)}
    warc.records(make(4)).write.format("warc").option("path", path).mode("overwrite").save()
    assert ids() == [4]


def test_warc_of_another_writer(spark, tmp_path):
    import gzip

    def own(kind: str, more: str, block: bytes) -> bytes:
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = own("warcinfo", "", b"software: x") + own("response", "WARC-Target-URI: http://a\r\nWARC-Payload-Digest: sha1:ab\r\n", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody") + b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\n\r\n\r\n"
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign/a.warc.gz").write_bytes(gzip.compress(records))
    (tmp_path / "foreign/b.warc").write_bytes(records)
    got = [(r["record_type"], r["url"], r["payload"] and bytes(r["payload"])) for r in warc.read(spark, f"file://{tmp_path}/foreign").collect()]
    assert sorted(got, key=str) == sorted(2 * [("warcinfo", None, b"software: x"), ("response", "http://a", b"body"), ("metadata", None, b"")], key=str)
    heads = warc.read(spark, f"file://{tmp_path}/foreign", ["url", "record_type"]).filter("record_type = 'response'")
    assert [r["url"] for r in heads.collect()] == ["http://a"] * 2


def test_chat_long_runs(spark):
    encode = chat.encoding(tokenizer_path(chat.VOCABULARY)).encode_ordinary
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "don't ", " ", "  ", "\n", "\t", "12", " é", "!?", "\x1c", " "], 60))
        for most in (5, 17):
            found = list(chat.parts(text, most))
            cuts = np.cumsum(list(map(len, found)))[:-1].tolist()
            assert "".join(found) == text and all(map(len, found[:1]))
            if all(text[k] == " " and not text[k - 1].isspace() for k in cuts):
                assert [i for x in found for i in encode(x)] == encode(text)
    long = [" " * 1_000_000, "a" * 1_000_000, "word " * 200_000, "</s>" * 100_000]
    df = spark.createDataFrame([(9, k, "assistant", t) for k, t in enumerate(long)], "conv_id long, turn long, role string, text string")
    (got,) = chat.op8(df).filter("conv_id = 9").collect()
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (4, sum(map(len, long)), hashlib.sha256("".join(long).encode()).hexdigest())
    assert got["turns_sha256"] == hashlib.sha256("".join(f"assistant\n{t}\n" for t in long).encode()).hexdigest()


def test_stored_pcm_of_each_format(spark):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, 3 * 576).astype(np.uint8).tobytes()
    clips = {6: audio.wav(codes, 6), 7: audio.wav(codes, 7), 17: audio.wav(codes, 17, 576), 0: None}
    df = spark.createDataFrame([(k, v) for k, v in clips.items()], "k int, media binary")
    got = {r["k"]: r["pcm_wav"] for r in audio.store_resampled(df, "k").collect()}
    assert got.pop(0) is None
    for tag, clip in got.items():
        assert audio.parse_wav(bytes(clip))[0] == 1
        pcm, want = audio.decode_wav(bytes(clip)), audio.decode_wav(clips[tag])
        assert (pcm[::2] == want).all() and all(pcm[1 + 2 * k] == (int(want[k]) + int(want[k + 1])) >> 1 for k in range(0, len(want) - 1, 97))
    # All codes of both laws against the rule of G.711, a segment and a place in it.
    for c in range(256):
        u, a = ~c & 255, c ^ 0x55
        size = ((2 * (u & 15) + 33) << ((u >> 4) & 7)) - 33
        assert audio.ULAW[c] == (-4 * size if u & 128 else 4 * size)
        seg = (a >> 4) & 7
        size = 2 * (a & 15) + 1 if seg == 0 else (2 * (a & 15) + 33) << (seg - 1)
        assert audio.ALAW[c] == (8 * size if a & 128 else -8 * size)


def test_packing_spreads_equal_pieces(spark):
    df = spark.createDataFrame([(1, "la " * 2048 * 40)], "doc_id long, text string")
    rows = packing.pack(df, group=1).collect()
    assert len(rows) >= 40
    pieces = packing.cut(df).select("doc_id", "start", "ids_crc32", "row").withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(8)))
    assert pieces.select("g").distinct().count() == 8


def test_packing_encodes_words_apart_from_marks_once(monkeypatch):
    own = packing.WordEncoder(packing.tokenizer_path(packing.VOCABULARY))
    sent, plain = [], own._encode_plain
    monkeypatch.setattr(own, "_encode_plain", lambda words: sent.extend(words) or plain(words))
    texts = ["Word. word, wOrd! (word) word:word 'word's. 3.5 été, é× été.", "<|ENDOFTEXT|> <|endoftext|>. a\x1cb a\x0bb á, .́ ,'s"]
    want = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode_batch(texts[:1]) == want[:1] and sent.count("word") == 1 and len(sent) == len(set(sent)) and not [w for w in sent if w.startswith("word") and w != "word"]
    assert own.encode_batch(texts) == want
