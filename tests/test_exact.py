"""Ranks, exact draws and order statistics, true batches, models fitted again, and the n-gram model against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmeter.operators import defenses, membership, models, preprocess, ranks, retrained, roc, selection
from veilmeter.sources.shared import dropped, written


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(v), k) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 50, 500)))] + [(None, 5, 500), (None, 4, 501)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r["id"]: (r["total"], r["place"]) for r in ranks.running(df, [F.col("g"), F.col("v"), F.col("id")], {"total": F.col("v"), "place": F.lit(1)}, within="g", parts=5).collect()}
    want, held = {}, defaultdict(lambda: [0, 0])
    for g, v, k in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        want[k] = tuple(held[g])
        held[g][0] += v
        held[g][1] += 1
    assert got == want
    assert sorted(r["place"] for r in ranks.ranked(df, [F.desc("v"), F.col("id")], "place", parts=3).collect()) == list(range(502))
    assert ranks.ranked(df.filter("false"), [F.col("v")], "place").count() == 0


def test_no_window_of_a_rank_holds_a_label(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for df in (preprocess.stratified_split(own, "o_orderstatus", "o_orderkey", 0.3), preprocess.label_encode(own, "o_orderstatus", "code"), preprocess.median_impute(own, "o_totalprice")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "Window" in x and "_rk_in_" in x]
        assert all("_rk_part" in x.split("[")[2] for x in windows if x.count("[") > 2) and "percentile" not in plan


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_draws_are_exact(spark, n):
    df = spark.range(n).select(F.col("id").alias("sample_id"))
    got = membership.with_exact_shadows(df, 3).groupBy("shadow").agg(F.sum(F.col("is_in").cast("int")).alias("k"), F.count("*").alias("n")).collect()
    assert sorted((r["shadow"], r["k"], r["n"]) for r in got) == [(s, n // 2, n) for s in range(3)]
    own = [r["sample_id"] for r in membership.drawn(df).collect()]
    assert len(own) == len(set(own)) == n // 2


def test_a_cut_through_equal_keys(spark):
    rows = [("a", 5, k) for k in range(30)] + [("a", 3, 100), ("b", 0, 1), ("b", 1048575, 2)]
    df = spark.createDataFrame(rows, "g string, key long, id long")
    wanted = spark.createDataFrame([("a", 11), ("b", 1), ("c", 4)], "g string, k long")
    got = {(r["g"], r["id"]) for r in selection.drawn(df, ["g"], "key", "id", wanted, "own").filter("own").collect()}
    assert got == {("a", 100), ("b", 1)} | {("a", k) for k in range(10)}


def test_places_and_medians(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    rng = np.random.default_rng(1)
    own = {0: rng.normal(size=1001), 1: np.r_[np.full(500, 7.0), rng.normal(size=3) * 1e300], 2: np.r_[-1e-300, 0.0, 1e-300, rng.uniform(0.7, 0.7001, 998)], 3: np.array([4.0]), 4: rng.integers(0, 3, 800).astype(float)}
    rows = [(g, float(x)) for g, v in own.items() for x in v] + [(0, None), (0, math.nan), (5, None)]
    values = spark.createDataFrame(rows, "g long, x double")
    got = selection.medians(values)
    assert got == {g: pytest.approx(float(np.median(v)), rel=1e-15) for g, v in own.items()}
    wanted = [(0, 0), (0, 1000), (1, 501), (2, 500), (4, 799)]
    assert selection.at_places(values, wanted) == {(g, p): float(np.sort(own[g])[p]) for g, p in wanted}


def test_imputed_columns_of_no_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, None, math.nan)], "id int, a double, b double")
    assert [(r["a"], r["b"]) for r in preprocess.median_impute_columns(df, ["a", "b"]).orderBy("id").collect()] == [(None, 2.0)] * 3
    arrays = spark.createDataFrame([(1, [1.0, None]), (2, [3.0, None, 5.0]), (3, [None])], "id int, v array<double>")
    assert {r["id"]: r["v"] for r in preprocess.median_impute_array(arrays, "v", "id").collect()} == {1: [1.0, None], 2: [3.0, None, 5.0], 3: [2.0]}


@pytest.mark.parametrize("n, batch", [(100, 16), (64, 64), (5, 64), (2000, 64)])
def test_batches_hold_exactly_their_rows(spark, n, batch):
    df = spark.range(n).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0)).alias("features"), F.lit(1.0).alias("y"))
    dealt = defenses.dealt_batches(df, n, [0, 1], batch, 42, 3)
    sizes = Counter((r["epoch"], r["step"]) for r in dealt.collect())
    steps = -(-n // batch)
    assert sorted(sizes) == [(e, s) for e in (0, 1) for s in range(steps)]
    assert all(c == (batch if s < steps - 1 or n % batch == 0 else n % batch) for (_, s), c in sizes.items())
    assert all(len({r["sample_id"] for r in dealt.filter(F.col("epoch") == e).collect()}) == n for e in (0, 1))
    assert len({r["chunk"] for r in dealt.collect()}) == -(-steps // 3)
    dropped(dealt)


def test_dp_sgd_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(150, 4)), rng.integers(0, 2, 150)
    rows = [(k, x[k].tolist(), int(1 - y[k])) for k in range(150)]
    samples = spark.createDataFrame(rows, "sample_id long, features array<double>, label int")
    grid = spark.createDataFrame([("none", 0.0, 1e-5), ("some", 1.5, 1e-5)], "run_id string, sigma double, delta double")
    got = {r["run_id"]: r for r in defenses.dp_sgd(samples, grid, epochs=3, batch=16, chunk=4).collect()}
    order = {e: [r["sample_id"] for r in samples.orderBy(F.xxhash64("sample_id", F.lit(e), F.lit(42))).collect()] for e in range(3)}
    w = np.zeros((2, 4))
    for e in range(3):
        for s in range(10):
            own = order[e][16 * s : 16 * s + 16]
            total = np.zeros((2, 4))
            for k in own:
                for j in range(2):
                    g = (1 / (1 + np.exp(-x[k] @ w[j])) - y[k]) * x[k]
                    total[j] += g * min(1, 1 / np.linalg.norm(g))
            noise = np.random.default_rng([42, e, s]).normal(0, 1, (2, 4)) * np.array([[0.0], [1.5]])
            w -= 0.1 * (total + noise) / len(own)
    for j, name in enumerate(("none", "some")):
        assert got[name]["accuracy"] == pytest.approx(((x @ w[j] > 0) == (y == 1)).mean())
        assert got[name]["steps"] == 30 and got[name]["sample_rate"] == 16 / 150
    assert defenses.dp_sgd(samples.filter("false"), grid).first()["accuracy"] is None


def test_retrained_models_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    make = lambda ids: [(k, rng.normal(size=3).tolist(), int(rng.integers(0, 3)) * 5, k % 2 == 0) for k in ids]
    schema = "sample_id long, features array<double>, label int, is_member boolean"
    pool, targets = make(range(21)), make(range(100, 140))
    found = retrained.lira_retrained(spark.createDataFrame(pool, schema), spark.createDataFrame(targets, schema), shadows=3)
    got = {r["sample_id"]: r for r in found.collect()}
    px, py, code = np.array([r[1] for r in pool]), np.array([r[2] // 5 for r in pool]), np.eye(3)
    for ident, x, label, member in targets:
        drawn, logit = retrained.halves(21, 42, ident, 3), np.zeros((2, 3))
        assert (drawn.sum(axis=2) == 10).all()
        for side in (0, 1):
            for m in range(3):
                a, b = px[drawn[side, m]], code[py[drawn[side, m]]]
                if side:
                    a, b = np.vstack([a, x]), np.vstack([b, code[label // 5]])
                z = np.array(x) @ np.linalg.solve(a.T @ a + np.eye(3), a.T @ b)
                p = np.exp(z[label // 5]) / np.exp(z).sum()
                logit[side, m] = np.log(p / (1 - p))
        mean, sd, seen = logit.mean(axis=1), logit.std(axis=1) + 1e-9, np.median(logit[0])
        score = [-0.5 * ((seen - mean[s]) / sd[s]) ** 2 - np.log(sd[s]) for s in (0, 1)]
        r = got[ident]
        assert r["is_member"] == member and [r["mean_in"], r["mean_out"], r["seen"], r["score"]] == pytest.approx([mean[1], mean[0], seen, score[1] - score[0]], rel=1e-6)
    assert retrained.lira_retrained(spark.createDataFrame([], schema), spark.createDataFrame(targets, schema)).filter("score IS NULL").count() == 40


def test_a_pool_beyond_its_bound_is_drawn_from_exactly(spark):
    pool = spark.range(500).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0)).alias("features"), F.lit(0).alias("label"))
    assert len(retrained.pool_rows(pool, 120)) == 120 and len(retrained.pool_rows(pool, 500)) == 500


@pytest.mark.parametrize("n", [200, 203])
def test_a_large_pool_is_used_whole_by_parts(spark, monkeypatch, n):
    """Models of a pool that no task holds are those of n // 2 of all its rows, as a plain loop fits them; a target's halves of a part differ."""
    for name, value in (("POOL", 50), ("DEALT", 16), ("PARTS", 4), ("PATTERNS", 12)):
        monkeypatch.setattr(retrained, name, value)
    rng = np.random.default_rng(9)
    make = lambda ids: [(k, rng.normal(size=3).tolist(), int(rng.integers(0, 3)), k % 2 == 0) for k in ids]
    schema = "sample_id long, features array<double>, label int, is_member boolean"
    rows, targets = make(range(n)), make(range(1000, 1012))
    pool = spark.createDataFrame(rows, schema)
    got = {r["sample_id"]: r for r in retrained.lira_retrained(pool, spark.createDataFrame(targets, schema), shadows=3).collect()}
    order = [r["sample_id"] for r in pool.orderBy(F.xxhash64("sample_id", F.lit(42)), "sample_id").collect()]
    blocks = [order[at : at + 16] for at in range(0, n, 16)]
    x, y, ever = np.array([r[1] for r in rows]), np.eye(3)[[r[2] for r in rows]], set()
    for ident, own, label, _ in targets:
        pick, logit = retrained.picked(42, ident, 3, 4, 12), np.zeros(6)
        assert all(len(set(p)) == 6 for p in pick.tolist())
        for m in range(6):
            drawn = [k for b, ids in enumerate(blocks) for k in np.array(ids)[retrained.block_halves(len(ids), 42, b, 12)[pick[b % 4, m]]].tolist()]
            assert len(drawn) == len(set(drawn)) == n // 2
            ever |= set(drawn)
            a, b = (np.vstack([x[drawn], own]), np.vstack([y[drawn], np.eye(3)[label]])) if m >= 3 else (x[drawn], y[drawn])
            z = np.array(own) @ np.linalg.solve(a.T @ a + np.eye(3), a.T @ b)
            p = np.exp(z[label]) / np.exp(z).sum()
            logit[m] = np.log(p / (1 - p))
        r = got[ident]
        assert [r["mean_out"], r["mean_in"], r["sd_in"], r["seen"]] == pytest.approx([logit[:3].mean(), logit[3:].mean(), logit[3:].std() + 1e-9, np.median(logit[:3])], rel=1e-6)
    assert ever == set(range(n))


def plain_ngram(members, others, order, d=0.75):
    split = lambda t: [w for w in (t or "").lower().split() if w]
    level = Counter(tuple(w[i : i + order]) for t in members for w in [split(t)] for i in range(len(w) - order + 1))
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    size = sum(levels[1].values()) + len(levels[1]) + 1

    def p(gram):
        if len(gram) == 1:
            return (levels[1][gram] + 1) / size
        own = {g: c for g, c in levels[len(gram)].items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * low if own else low

    return {(i, pos): math.log(p(tuple(w[max(0, pos - order + 1) : pos + 1]))) for i, t in others for w in [split(t)] for pos in range(1, len(w))}


@pytest.mark.parametrize("order", [2, 3])
def test_ngram_model(spark, order):
    rng = np.random.default_rng(order)
    rows = [(k, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 30))))) for k in range(30)] + [(30, None), (31, ""), (32, "one"), (33, "New words only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = models.ngram_levels(models.grams(docs.filter("doc_id % 2 = 0"), order), order)
    got = {(r["doc_id"], r["pos"]): r["logp"] for r in models.ngram_log_probs(models.grams(docs, order), levels).collect()}
    want = plain_ngram([t for k, t in rows if k % 2 == 0], rows, order)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "a b a c a b b a c b a")], "doc_id long, text string")
    levels = models.ngram_levels(models.grams(docs, 2), 2)
    asked = spark.createDataFrame([(k, f"a {w}") for k, w in enumerate("abc")] + [(9, "a z")], "doc_id long, text string")
    p = [math.exp(r["logp"]) for r in models.ngram_log_probs(models.grams(asked, 2), levels).collect()]
    assert sum(p) == pytest.approx(1.0)


def test_buckets_rise_with_scores_and_split_what_crowds_near_one(spark):
    rng = np.random.default_rng(5)
    x = np.unique(np.r_[rng.normal(size=2000) * 3, 1 - 10.0 ** rng.uniform(-15, 0, 4000), 0.0, 0.5, 1.0, np.nextafter(1, 0), 1e300, -1e300, 5e-324])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", roc.bucket(F.col("x")).alias("b"))
    rows = sorted((r["x"], r["b"]) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    crowd = spark.range(100_000).select(roc.bucket(1 - F.rand(1) * 1e-3).alias("b")).groupBy("b").count()
    assert crowd.agg(F.max("count")).first()[0] < 1000


def test_tables_with_folders_of_partitions(spark):
    t = written(spark.range(10).withColumn("part", F.col("id") % 3), "parted", by=("part",))
    assert sorted(r["id"] for r in t.filter("part = 1").collect()) == [1, 4, 7]
    path = t.inputFiles()[0].split("/part=")[0].removeprefix("file://")
    dropped(t)
    import os

    assert not os.path.exists(path.removeprefix("file:"))
