"""Every query of the library against its SQL; those without SQL against what must hold of their rows."""

import pytest
from pyspark.sql import functions as F

from veilmeter.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck, same):
    assert same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name]) > 0


def test_hill_climbing_beats_chance(spark, sf_dir):
    rows = QUERIES["inversion_hillclimb"](spark, sf_dir).collect()
    assert len(rows) == 5 and all(0 <= x <= 1 for r in rows for x in r["x"])
    (best,) = QUERIES["inversion_best"](spark, sf_dir).collect()
    assert best["confidence"] == max(r["confidence"] for r in rows) and best["restart"] == max(rows, key=lambda r: (r["confidence"], -r["restart"]))["restart"]


def test_dp_sgd_spends_less_with_more_noise(spark, sf_dir):
    rows = {r["run_id"]: r for r in QUERIES["dpsgd_sweep"](spark, sf_dir).collect()}
    assert rows["s4.0"]["epsilon"] < rows["s1.0"]["epsilon"] < rows["s0.7"]["epsilon"]
    assert all(0 <= r["accuracy"] <= 1 for r in rows.values())


def test_early_stopping_holds_no_array_of_a_key(spark):
    from veilmeter.operators import defenses

    rows = spark.range(50_000).selectExpr("1 AS u", "id AS i", "double(50000 - id) AS v").unionByName(spark.createDataFrame([(2, 0, 5.0), (2, 1, 6.0), (2, 2, 4.0), (None, 0, 1.0)], "u int, i long, v double"))
    out = defenses.early_stopping(rows, "u", ["i"], "v", patience=1)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1.0, 0, False, 50_000), (2, 4.0, 0, True, 3), (None, 1.0, 0, False, 1)], key=str)


def test_trained_models(spark, sf_dir):
    (extracted,) = QUERIES["extraction_mllib"](spark, sf_dir).collect()
    assert extracted["n"] > 0 and extracted["agreement"] > 0.7
    (shadow,) = QUERIES["shadow_mllib_eval"](spark, sf_dir).collect()
    assert 0.4 < shadow["auc"] <= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(isinstance(x, str) for x in e.oracle_sql().values())


def test_factories(spark, sf_dir):
    from veilmeter.operators import trained

    for make in (trained.shadow, trained.substitute, trained.boosted):
        with pytest.raises(ValueError):
            make("no such model")
    assert trained.boosted("moderate").getMaxIter() == 200 and trained.substitute("mlp", 4, 3).getLayers() == [4, 100, 3]
    (copied,) = QUERIES["extraction_mlp"](spark, sf_dir).collect()
    assert copied["n"] > 0 and copied["agreement"] > 0.7


def test_boosted_benchmark_of_all_settings(spark, sf_dir):
    rows = {(r["run_id"], r["attack"]): r for r in QUERIES["boosted_benchmark"](spark, sf_dir).collect()}
    settings = ("default", "generalised", "moderate", "overfitted")
    assert set(rows) == {(s, a) for s in settings for a in ("direct", "shadow")}
    assert rows["overfitted", "direct"]["train_accuracy"] > 0.99 and rows["overfitted", "direct"]["auc"] > rows["generalised", "direct"]["auc"] + 0.1
    assert all(0 <= r["tpr_at_01pct"] <= r["tpr_at_1pct"] <= 1 and r["n_members"] > r["n_nonmembers"] > 0 for r in rows.values())
    assert rows["overfitted", "shadow"]["auc"] > 0.5


def test_assessment_chain(spark, sf_dir):
    (r,) = QUERIES["assess_chain"](spark, sf_dir).collect()
    assert r["n_members"] + r["n_nonmembers"] == r["n_samples"] and r["n_features"] == 4 and r["train_accuracy"] > r["test_accuracy"]
    assert r["risk_level"] == ("low" if r["auc"] < 0.55 else "medium" if r["auc"] < 0.6 else "high") and 0 <= r["advantage"] <= 1


def test_curve_of_odd_scores(spark):
    """Signs, zero, huge, tiny and equal scores, against a plain count."""
    import random

    from veilmeter.operators import roc

    rng = random.Random(1)
    values = [0.0, 1.0, -1.0, 1e-9, -1e-9, 2.0, 0.5, 1e300, float("inf"), float("-inf"), -3.7, 0.3, 0.30000000000000004] + [rng.uniform(-2, 2) for _ in range(200)]
    rows = [("a", rng.random() < 0.5, rng.choice(values)) for _ in range(600)] + [("b", True, 0.5), ("b", False, None), ("b", False, float("nan"))]
    got = roc.curve(spark.createDataFrame(rows, "run_id string, is_member boolean, score double"))
    for r in got.collect():
        own = [x for x in rows if x[0] == r["run_id"] and x[2] is not None and x[2] == x[2]]
        assert r["tp"] == sum(m for _, m, s in own if s >= r["score"]) and r["fp"] == sum(not m for _, m, s in own if s >= r["score"])
        assert (r["pos"], r["neg"]) == (sum(m for _, m, _ in own), sum(not m for _, m, _ in own))
    finite = [x for x in rows if x[0] == "a" and abs(x[2]) < 1e300]
    import numpy as np

    c = roc.curve(spark.createDataFrame(finite, "run_id string, is_member boolean, score double"))
    for q in (0.0, 0.01, 0.5, 0.99, 1.0):
        for side, own in (("p", [s for _, m, s in finite if m]), ("n", [s for _, m, s in finite if not m]), ("all", [s for _, _, s in finite])):
            assert abs(roc.quantile(c, q, side).first()["threshold"] - np.quantile(own, q)) < 1e-12
    parts = [r["b"] for r in spark.createDataFrame([(x,) for x in sorted(set(values))], "x double").select(roc.bucket(F.col("x")).alias("b"), "x").orderBy("x").collect()]
    assert parts == sorted(parts)


def test_early_stopping_stream(spark, tmp_path):
    from veilmeter.streaming import state

    make = lambda rows: spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double")
    path = str(tmp_path / "in")
    make([(1, 1, 1, 5.0), (1, 2, 2, 6.0), (2, 1, 3, 1.0)]).coalesce(1).write.parquet(path)
    make([(1, 3, 4, 7.0), (1, 4, 5, 4.0)]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("user_id long, ts long, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(path)
    q = state.early_stopping_stream(stream, patience=2).writeStream.outputMode("update").format("memory").queryName("stops").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["user_id"]: r for r in sorted(spark.table("stops").collect(), key=lambda r: r["best"], reverse=True)}
    assert (last[1]["best"], last[1]["stopped"]) == (4.0, True) and (last[2]["best"], last[2]["stopped"]) == (1.0, False)


def test_small_operators(spark, tmp_path):
    from veilmeter.functions import privacy
    from veilmeter.operators import defenses, membership, preprocess
    from veilmeter.sources import tables

    assert membership.min_k_array([-0.1, -5.0, -0.2, -4.0, -0.3, -3.0, -0.4, -2.0, -0.5, -1.0], 0.2, 5) == -4.5
    with pytest.raises(ValueError):
        membership.min_k_array([-1.0, -2.0, -3.0], min_tokens=10)
    (r,) = membership.min_k_predict(spark.createDataFrame([(-2.0,)], "score double")).collect()
    assert r["is_member_pred"] and abs(r["confidence"] - 1 / (1 + 2.718281828459045**-1)) < 1e-12
    made = tables.log_probs(spark, 20, 50, -2.8, 1.5)
    assert made.count() == 1000 and made.agg(F.max("logp")).first()[0] <= -1e-6
    p = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    assert abs(sum(p.select(defenses.perturb_proba(F.col("p"), noise=0.5, seed=1)).first()[0]) - 1) < 1e-12
    with pytest.raises(ValueError):
        privacy.accountant_epsilon(tables.configs(spark), "none")
    samples = spark.range(11).select(F.col("id").alias("sample_id"))
    assert membership.drawn(samples).distinct().count() == 5
    one = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, x double")
    assert [r["z"] for r in preprocess.standard_scale(one, "x", F.lit(True), "z").collect()] == [0.0, 0.0]
    tables.write_json(one, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    two = spark.range(1).select(*[privacy.steps_epsilon(F.lit(k), 0.01, 2.0, 1e-5, a).alias(f"{a}{k}") for a in ("rdp", "gdp") for k in (10, 100)]).first()
    assert two["rdp10"] == two["rdp100"] and two["gdp10"] < two["gdp100"]
