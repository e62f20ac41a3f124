"""Sources of predictions, thresholds, and what is raised where something is missing."""

import numpy as np
import pytest

from veilmeter.functions import privacy
from veilmeter.operators import extraction, membership
from veilmeter.plans.catalog import QUERIES
from veilmeter.sources import predictions


def test_three_sources_give_equal_scores(spark, sf_dir):
    rows = {r["run_id"]: r for r in QUERIES["direct_by_source"](spark, sf_dir).collect()}
    assert set(rows) == {"mllib", "table", "function"}
    assert len({(r["auc"], r["advantage"], r["n_members"]) for r in rows.values()}) == 1


def test_a_function_is_loaded_once_a_task_and_held_to_its_rows(spark):
    df = spark.createDataFrame([(k, k % 2 == 0, 0, [float(k)]) for k in range(20)], "sample_id long, is_member boolean, label int, features array<double>").coalesce(1)

    def load():
        calls = []

        def answer(x):
            calls.append(len(x))
            return np.stack([np.full(len(x), len(calls) / 10), x[:, 0]], axis=1)

        return answer

    got = predictions.from_function(df, load, batch=8).collect()
    assert sorted({r["proba"][0] for r in got}) == [0.1, 0.2, 0.3] and all(r["pred"] == int(r["proba"][1] > r["proba"][0]) for r in got)
    with pytest.raises(Exception, match="answers of shape"):
        predictions.from_function(df, lambda: lambda x: np.zeros((1, 2))).collect()


def test_thresholds_and_errors(spark):
    scores = spark.createDataFrame([("a", 1, True, 0.9), ("a", 2, True, 0.5), ("a", 3, False, 0.4), ("a", 4, True, 0.6)], "run_id string, sample_id long, is_member boolean, score double")
    cut = lambda **how: membership.fitted_threshold(scores, **how).first()["threshold"]
    assert (cut(fixed=0.7), cut(), cut(reference=False)) == (0.7, 0.5, 0.6)
    with pytest.raises(RuntimeError):
        extraction.agreement(scores, None, "sample_id")
    with pytest.warns(UserWarning):
        privacy.gdp_epsilon(spark.createDataFrame([("a", 1.0, 0.1, 10)], "run_id string, sigma double, sample_rate double, steps long"), 1e-5)


def test_inversion_report(spark, sf_dir):
    (r,) = QUERIES["inversion_report"](spark, sf_dir).collect()
    assert r["confidence"] == round(r["confidence"], 4) and r["n_features"] == len(r["reconstructed"]) and r["target_class"] == 0


def test_documents_are_written_whole_or_not_at_all(spark, sf_dir, tmp_path):
    import json

    from veilmeter.plans import measured, reports
    from veilmeter.sources.documents import Documents

    spark.dataSource.register(Documents)
    inputs = measured.cases(spark, sf_dir)
    own = reports.report(inputs, measured.own_findings(inputs))
    write = lambda df, mode: df.write.format("documents").option("path", str(tmp_path)).option("name", "model_id").mode(mode).save()
    write(own, "append")
    rows = {r["model_id"]: r for r in own.collect()}
    files = {p.stem: json.loads(p.read_text()) for p in tmp_path.glob("*.json")}
    assert files.keys() == rows.keys() and not (tmp_path / "_parts").exists()
    assert all(f["n_findings"] == rows[k]["n_findings"] and [x["attack"] for x in f["findings"]] == [x["attack"] for x in rows[k]["findings"]] for k, f in files.items())
    with pytest.raises(Exception, match="one name"):
        write(own.unionByName(own), "append")
    assert len(list(tmp_path.glob("*.json"))) == len(rows)
    write(own.limit(2), "overwrite")
    assert len(list(tmp_path.glob("*.json"))) == 2
