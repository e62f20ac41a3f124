"""The pipeline: each stage works on all that its predecessor kept, and its decisions take effect."""

import corpus_pipeline

from veilmeter.llm import langid, linededup, quality, simhash
from veilmeter.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs, ids = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = docs, stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        found = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            want = [r["doc_id"] for r in langid.identify(before).collect() if r["lang_pred"] != "und" and r["score"] >= langid.REJECT]
        elif name == "quality":
            want = [r["doc_id"] for r in quality.classify(before, table(spark, sf_dir, "labels")).collect() if r["keep"]]
        elif name == "line_dedup":
            want = ids
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert texts == {r["doc_id"]: r["text"] for r in linededup.line_report(before).collect()}
        elif name == "near_dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        else:
            want, found = set(ids), set(found)
        assert sorted(want) == sorted(found)
        ids = found
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_odd_and_empty_tables(spark, sf_dir, tmp_path):
    long = "the quick brown fox of the north walks over the old stone bridge and then goes home again\n" * 3000
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "12 34 !!", "en"), (5, long, "en"), (5, long, "en"), (5, "another text under one id", None), (None, "a text without an id of its own", None)]
    samples = {"en": "in the morning the old miller walks along the quiet river", "de": "am frühen morgen geht der alte müller den stillen fluss entlang"}
    rows += [(k, f"{text} number {k}", lang) for lang, text in samples.items() for k in range(10, 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars", "1 AS fp", "2 AS h", "3 AS _ld_doc", "4 AS row")
    for name, own in (("odd", docs), ("empty", docs.filter("false"))):
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, sf_dir, "labels").filter("doc_id < 0").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # Texts without a letter go in the first stage, and repeated lines and rows later.
        assert {r["doc_id"] for r in got} <= {5, None, *range(10, 18)} and len(got) == len({(r["doc_id"], r["start"], r["ids_crc32"]) for r in got})
        assert ({5, None} <= {r["doc_id"] for r in got}) == (name == "odd") and bool(got) == (name == "odd")
        assert all(r["doc_tokens"] < 100 for r in got)
