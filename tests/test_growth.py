"""Plans that must not grow in one place, and results that larger tables brought to light."""

from __future__ import annotations

import math
import statistics

from veilmeter.operators import membership


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_likelihood_ratio_counts_are_not_broadcast(spark, sf_dir):
    from veilmeter.sources import tables

    pool = tables.order_samples(spark, sf_dir)
    assert "BroadcastExchange" not in _plan(membership.lira_scores(pool, pool))


def test_likelihood_ratio_of_repeated_rows_is_of_one_sample(spark):
    rows = [(i, i % 3, i % 2, i % 2 == 0) for i in range(40)] + [(4, 2, 1, True), (4, 1, 0, True), (100, 1, None, True)]
    pool = spark.createDataFrame(rows, "sample_id long, k long, label int, is_member boolean")
    found = {r["sample_id"]: r for r in membership.lira_scores(pool, pool, shadows=6).collect()}
    assert len(found) == 41 and found[100]["score"] is None
    is_in = lambda i, s: ((i * 7919 + s * 104729) % 1000003) % 2 == 0
    log = lambda p: math.log(p / (1 - p))
    for i in (3, 4, 17):
        inn, out = [], []
        for _, k, y, _ in [r for r in rows if r[0] == i]:
            for s in range(6):
                own = int(is_in(i, s))
                n = sum(r[1] == k and is_in(r[0], s) for r in rows) - own
                c = sum(r[1] == k and r[2] == y and is_in(r[0], s) for r in rows) - own
                inn.append(log((c + 2) / (n + 4)))
                out.append(log((c + 1) / (n + 3)))
        want = [statistics.fmean(inn), statistics.pstdev(inn), statistics.fmean(out), statistics.pstdev(out), statistics.median(out)]
        assert all(abs(a - b) < 1e-8 for a, b in zip(want, [found[i][c] for c in ("mean_in", "sd_in", "mean_out", "sd_out", "seen")]))


def test_figures_in_reports_are_printed_as_sql_prints_them(spark, duck):
    from veilmeter.plans import reports

    values = [1.005, 2.675, 0.125, 0.375, 1.115, 3.0, 1234567.5, 0.0049, 9.995]
    inputs = spark.createDataFrame([(str(i), 0.5, 0.1, e, 1.0, False) for i, e in enumerate(values)], "model_id string, advantage double, threshold double, epsilon double, sigma double, inversion boolean")
    hints = {r["model_id"]: r["hint"] for r in reports.findings(inputs).filter("attack = 'dp_sgd_defense_assessment'").collect()}
    for i, e in enumerate(values):
        (shown,) = duck.execute(f"SELECT printf('Epsilon = %.2f', {e!r}::DOUBLE)").fetchone()
        assert hints[str(i)].startswith(shown + (". Target" if e > 1 else " meets"))


def test_large_vocabularies_are_looked_up_in_two_parts(spark):
    from pyspark.sql import functions as F

    from veilmeter.operators import models

    words = [f"w{i % (1 + i % 37)}" for i in range(2000)] + [f"rare{i}" for i in range(50)]
    tokens = spark.createDataFrame([(i % 20, i, w) for i, w in enumerate(words + ["new"])], "doc_id long, pos int, token string")
    model = models.unigram(tokens.filter("token <> 'new'"))
    rows = lambda most: sorted(map(tuple, models.token_log_probs(tokens, model, most).collect()))
    assert len(rows(10)) == 2051 and rows(10) == rows(10**6) == rows(1)
    often = models.looked_up(tokens, model, "token", "c", 10).filter(F.col("c") > 100)
    assert often.count() == sum(words.count(w) for w in set(words) if words.count(w) > 100)


def test_words_are_looked_up_where_their_text_lies(spark, sf_dir):
    from pyspark.sql import functions as F

    from veilmeter.operators import models
    from veilmeter.sources import tables

    rows = [(1, "A a\tb\u00c9 b\u00e9"), (2, None), (3, " \n"), (4, "new a\x0ba word \u0130"), (1, "a c"), (6, "z " * 30)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").unionByName(tables.read(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("doc_id"), "text"))
    counts = models.word_counts(odd.filter("doc_id % 2 = 0"))
    plain = models.unigram(models.tokens(odd.filter("doc_id % 2 = 0")))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    want = sorted(map(tuple, membership.min_k(models.token_log_probs(models.tokens(odd), plain), 0.3, 1).collect()))
    for most in (10**6, 50, 1):  # all words are sent, some, and none
        found = sorted(map(tuple, membership.min_k(models.document_log_probs(odd, counts, most=most), 0.3, 1).collect()))
        assert [r[:3] for r in found] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(found, want))
    assert "Generate" not in _plan(models.document_log_probs(odd, counts)) and models.document_log_probs(odd.filter("false"), counts.filter("false")).count() == 0


def test_hashes_stand_for_words_only_if_no_two_are_alike(spark):
    from pyspark.sql import functions as F

    from veilmeter.operators import models

    docs = spark.createDataFrame([("a b c",), ("b a",), (None,)], "text string")
    few = lambda w, s: F.when(s < 2, F.lit(0).cast("long")).otherwise(F.xxhash64(w, s))
    assert models.word_salt(docs) == 0 and models.word_salt(docs, few) == 2


def test_token_scores_are_computed_once_for_all_figures(spark, sf_dir):
    from veilmeter.plans.catalog import QUERIES

    for name in ("mink_evaluate", "mink_ngram_evaluate"):
        assert "Generate" not in _plan(QUERIES[name](spark, sf_dir))


def test_retrained_models_are_fitted_once_for_all_figures(spark, sf_dir):
    from veilmeter.plans.catalog import QUERIES

    assert "MapInArrow" not in _plan(QUERIES["lira_retrained_metrics"](spark, sf_dir))


def test_a_sample_of_rows_is_cut_before_it_meets_in_one_task(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from veilmeter.operators import boosting

    rows = spark.range(0, 30000, 1, 12).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("run_id"), F.col("id").alias("sample_id"))
    order = Window.partitionBy("run_id").orderBy(F.xxhash64("sample_id", F.lit(42)), "sample_id")
    want = {tuple(r) for r in rows.withColumn("n", F.row_number().over(order)).filter("n <= 3500").select("run_id", "sample_id").collect()}
    found = boosting.sampled(rows, 3500)
    assert len(want) == 6500 and {tuple(r) for r in found.collect()} == want and boosting._narrowed(rows, 3500, 42).count() < 6510
    assert boosting.sampled(rows.filter("false"), 10).count() == 0


def test_parts_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from veilmeter.plans import catalog

    monkeypatch.setattr(catalog, "shared_path", lambda spark, name: str(tmp_path / name))
    ts = F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).cast("timestamp_ntz").alias("ts")
    rows = spark.range(0, 400, 1, 4).select((F.col("id") % 5).alias("user_id"), ts, F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog.tables, "read", lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet").repartition(4))
    found = catalog.QUERIES["accountant_stream"](spark, str(tmp_path))
    assert sorted((r["event_id"], r["step"]) for r in found.collect()) == [(k, k // 5 + 1) for k in range(400)]
    assert len(list((tmp_path / "stream-events").glob("part-*"))) >= 4 * catalog.FILES


def test_users_of_a_stream_share_calls_and_states(spark, tmp_path):
    """Late and unordered events, many users, one of them null, over several batches: as a plain fold in order, in far fewer calls than users."""
    import random

    from veilmeter.streaming import ordered

    rng = random.Random(3)
    hour, day = 3600, 1_700_000_000
    events = [(None if u == 7 else u, day + k * hour + rng.randrange(hour), 100 * u + k, float(rng.randrange(5))) for u in range(40) for k in range(6)]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, s long, event_id long, value double"
    for part in [[e for e in events if (e[1] - day) // (2 * hour) == k] for k in range(3)] + [[(-1, day + 10**7, -1, 0.0)], [(-1, day + 10**8, -2, 0.0)]]:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_id", "value").coalesce(1).write.mode("append").parquet(source)
        stream = ordered.early_stopping(spark.readStream.schema("user_id long, ts timestamp, event_id long, value double").parquet(source), patience=2, min_delta=0.5, delay="3 hours")
        assert "bucket" in stream._jdf.queryExecution().logical().toString()
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = {}
    for u in {e[0] for e in events}:
        held = (float("inf"), 0, False, 0)
        for _, _, ident, v in sorted((e for e in events if e[0] == u), key=lambda e: (e[1], e[2])):
            best, counter = (v, 0) if v < held[0] - 0.5 else (held[0], held[1] + 1)
            want[ident] = held = (best, counter, held[2] or counter >= 2, held[3] + 1)
    got = spark.read.parquet(sink).filter("event_id >= 0").collect()
    assert {r["event_id"]: (r["best"], r["counter"], r["stopped"], r["n"]) for r in got} == want and len(got) == 240
    assert {r["user_id"] for r in got} == {e[0] for e in events}


def test_pairs_are_looked_up_where_their_text_lies(spark, sf_dir, monkeypatch):
    """As by rows of grams, whether all pairs are sent to the tasks, some, or none; words that are alike by hash give no counts."""
    from pyspark.sql import functions as F

    from veilmeter.operators import models
    from veilmeter.sources import tables

    rows = [(1, "A a\tbÉ bé"), (2, None), (3, " \n"), (4, "new a\x0ba word İ"), (1, "a c"), (6, "z " * 30), (8, "one"), (9, "only here twice only here twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(tables.read(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("doc_id"), "text").filter("doc_id < 70"))
    member = F.col("doc_id") % 2 == 0
    levels = models.ngram_levels(models.grams(docs.filter(member), 2), 2)
    want = sorted(map(tuple, membership.min_k(models.ngram_log_probs(models.grams(docs, 2), levels).select("doc_id", "logp"), 0.3, 1).collect()))
    pairs = models.pair_counts(docs, member)
    for most in (10**6, 60, 1):
        found = sorted(map(tuple, membership.min_k(models.pair_log_probs(docs, pairs, most=most), 0.3, 1).collect()))
        assert [r[:3] for r in found] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(found, want))
    empty = docs.filter("false")
    assert models.pair_log_probs(empty, models.pair_counts(empty, member)).count() == 0

    def one_hash(words):
        from veilmeter.operators import words as module

        known, own = module.looked_for(words)
        for hashes, starts, ends, _ in known.layers:
            hashes.flags.writeable = True
            hashes[ends - starts == 2] = 7
        return known, own

    monkeypatch.setattr(models, "looked_for", one_hash)
    assert models.pair_counts(docs, member) is None
