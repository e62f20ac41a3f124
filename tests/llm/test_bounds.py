"""Samples and groups that stay bounded and lose nothing on tables of an odd make."""

import numpy as np
from pyspark.sql import functions as F

from veilmeter.llm import ann, langid, linededup, packing, quality


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = np.random.default_rng(0)
    words = {"en": "the of and that with from this have".split(), "de": "der und die nicht mit von das ein".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(k, say("en", 40), "en") for k in range(40)] + [(k, say("de", 2500), "de") for k in range(40, 80)] + [(k, say("de", 30), None) for k in range(80, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert all(got[k] == ("en" if k < 40 else "de") for k in got)
    texts = dict(langid.learn(df))
    assert set(texts) == {"en", "de"} and all(len(t) <= 4 * langid.SAMPLE for own in texts.values() for t in own)


def test_groups_of_packing_hold_few_pieces(spark):
    rows = [(k, "word " * 60_000) for k in range(6)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(got) == 6 * 30 and max(map(len, by.values())) <= 64 and len(by) > 2


def test_many_rows_of_one_labelled_document_stay_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "MOST", 50)
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("good text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(k, "poor text " * 9000) for k in range(2, 50)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1, 0)] + [(k, 0, 0) for k in range(2, 50)], "doc_id long, quality int, toxic int")
    grades, rows, _ = quality.sample(docs, labels)
    assert (grades == 2).sum() == 100 and 0 < (grades == 1).sum() <= quality.FEW and len(rows) == len(grades)


def test_keys_of_lines_are_made_from_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta\nbeta  ALPHA\nbeta beta alpha\nalpha gamma\n\talpha\tbeta ")], "doc_id long, text string")
    rows = linededup.line_rows(docs, F.lit(0)).collect()
    keys = [(r["k1"], r["k2"]) for r in sorted(rows, key=lambda r: r["pos"])]
    assert keys[0] == keys[1] == keys[2] == keys[4] != keys[3]
    assert keys[0][0] != keys[3][0] and keys[0][1] != keys[3][1]


def test_a_word_that_all_lines_have_and_a_text_of_many_lines(spark):
    rng = np.random.default_rng(4)
    own = ["the " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4)) for _ in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(own)), (2, "\n".join(own[:50] + ["the end of it all"] * 3))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.line_report(docs).collect()}
    assert got[1]["n_lines"] == 20_000 and got[1]["n_kept"] == len({" ".join(sorted(set(x.split()))) for x in own})
    assert got[2]["text"] == "the end of it all"


def recall(spark, x, k=10):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    found = {}
    for r in ann.search(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 100):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argpartition(far, k - 1)[:k].tolist()))
    return hits / (k * len(range(0, len(x), 100)))


def test_recall_over_many_lists_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 16)  # 1,250 lists
    assert recall(spark, np.random.default_rng(6).normal(size=(20_000, 12))) >= 0.95


def test_lists_of_more_vectors_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 60)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 6))
    x[:900] = x[0] + rng.normal(size=(900, 6)) * 1e-3  # one list's worth of near copies, and many that ask for it
    assert recall(spark, x) >= 0.95


def test_calibration_of_small_and_equal_samples():
    for x in (np.ones((5, 3)), np.random.default_rng(0).normal(size=(40, 2)), np.eye(3)):
        index = ann.Index(x, max(1, len(x) // 4))
        probes, reach = ann.calibrated(index, x)
        assert probes >= 1 and reach >= ann.REACH
