"""Assessment, reports and technique mapping as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmeter.functions import privacy, risk
from veilmeter.operators import membership, models, roc

#: Articles by level, technique ids by finding type, texts of hints and mitigations.
ARTICLES = {"CRITICAL": ["Article 10", "Article 13", "Article 72"], "HIGH": ["Article 10", "Article 9"], "MEDIUM": ["Article 9"], "LOW": [], "UNKNOWN": []}
TECHNIQUES = {
    "membership_inference_success": ["T1005", "T1213.002"],
    "model_stealing_detected": ["T1005", "T1114"],
    "attribute_inference": ["T1552", "T1213"],
    "gradient_leakage": ["T1005", "T1557"],
    "model_inversion_pii": ["T1005", "T1078"],
    "differential_privacy_bypass": ["T1685", "T1565"],
    "federated_learning_poisoning": ["T1195", "T1565"],
    "api_probing_extraction": ["T1190", "T1595"],
}
LAYER_VERSIONS = {"attack": "19", "navigator": "4.9", "layer": "4.5"}
IN_RANGE = "MIA advantage within acceptable range. No immediate action required."
APPLY = "Apply DP-SGD with epsilon <= 1.0 and sigma >= 1.5"
EPOCHS = "Reduce training epochs to limit overfitting and memorization"
PERTURB = "Add output perturbation: label smoothing (smoothing=0.1) or prediction confidence thresholding (return top-k only)"
INVERTED = "Model inversion succeeded. Apply prediction confidence thresholding, output perturbation, or restrict API access to top-k predictions only."
MITIGATE = {
    "base": ["Document all privacy risk assessments in the system's risk management file.", "Re-evaluate after any model retraining or dataset update."],
    "high": [
        "Apply DP-SGD with sigma >= 4.0 (target epsilon <= 1.16 at delta=1e-5).",
        "Reduce model capacity to limit overfitting and MIA attack surface.",
        "Consider k-anonymity or synthetic data generation for training data.",
        "Implement prediction confidence rounding or output perturbation.",
    ],
    "critical": ["Conduct a Data Protection Impact Assessment (DPIA) per GDPR Article 35.", "Notify DPO and consider suspending model deployment until remediated."],
    "no_epsilon": ["No differential privacy applied  --  strongly recommended for high-risk systems."],
}


def generalization_gap(preds: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """by, train_accuracy, test_accuracy, gap. weight: for how many samples a row stands."""
    hit = F.col("pred") == F.col("label")
    rates = preds.groupBy(by).agg(roc.share(F.when(F.col("is_member"), hit), weight).alias("train_accuracy"), roc.share(F.when(~F.col("is_member"), hit), weight).alias("test_accuracy"))
    return rates.withColumn("gap", F.col("train_accuracy") - F.col("test_accuracy"))


def assess(samples: DataFrame, run_id: str = "run") -> DataFrame:
    """One row: sizes, accuracies, gap, AUC, advantage, risk."""
    preds = models.fit_predict(samples)
    found = roc.summary(roc.curve(membership.confidence_scores(preds, run_id)))
    gap = generalization_gap(preds.withColumn("run_id", F.lit(run_id)), "run_id")
    return found.join(gap, "run_id").withColumn("risk", risk.by_auc(F.col("auc")))


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _two(x: Column) -> Column:
    return privacy.fixed(x, 2)


def remediation() -> Column:
    """The hint on membership inference, from advantage, threshold and epsilon."""
    e = F.col("epsilon")
    current = F.concat(F.lit("Current epsilon "), _two(e), F.lit(" exceeds target 1.0  --  increase sigma"))
    first = F.when(e.isNull() | (e > 3), APPLY).when(e > 1, current)
    return F.when(F.col("advantage") <= F.col("threshold"), IN_RANGE).otherwise(F.concat_ws("; ", _list(first, F.lit(EPOCHS), F.lit(PERTURB))))


def recommended_defense() -> Column:
    e = F.col("epsilon")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when(F.col("advantage") <= F.col("threshold"), "No defense required  --  MIA advantage within acceptable range")
        .when(e.isNull(), "DP-SGD with epsilon <= 1.0 (not currently applied)")
        .when(e > 3, text("Increase DP-SGD sigma to achieve epsilon <= 1.0 (current epsilon: ", _two(e), ")"))
        .when(e > 1, text("Tune DP-SGD: increase sigma to reach epsilon <= 1.0 (current: ", _two(e), ")"))
        .otherwise(text("DP-SGD applied with epsilon = ", _two(e), "  --  meets target"))
    )


FINDING = "model_id string, attack string, severity string, articles string, function string, hint string"


def findings(inputs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """inputs (model_id, advantage, threshold, epsilon, sigma, inversion) -> FINDING: on membership always, on the budget where epsilon
    is given, on inversion where it succeeded; more: a caller's own findings, in the same columns. Values out of range raise."""
    ok = F.col("advantage").between(0, 1) & (F.col("threshold") > 0) & (F.col("threshold") <= 1)
    checked = inputs.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("advantage or threshold out of range")).cast("boolean")))
    e = F.col("epsilon")
    art = F.concat_ws(",", _list(F.when(F.col("advantage") > F.col("threshold"), "Art. 10"), F.when(F.col("inversion"), "Art. 15")))
    spent = F.when(e > 1, F.concat(
        F.lit("Epsilon = "), _two(e), F.lit(". Target epsilon <= 1.0 for strong privacy guarantees. Increase sigma (current: "), F.coalesce(F.col("sigma").cast("string"), F.lit("None")), F.lit(") or reduce training epochs."),
    )).otherwise(F.concat(F.lit("Epsilon = "), _two(e), F.lit(" meets the recommended threshold of <= 1.0.")))

    def row(attack: str, severity: Column, articles: Column, function: str, hint: Column, when: Column) -> Column:
        columns = {"attack": F.lit(attack), "severity": severity, "articles": articles, "function": F.lit(function), "hint": hint}
        return F.when(when, F.struct(*[c.alias(k) for k, c in columns.items()]))

    each = _list(
        row("membership_inference", risk.by_ratio(F.col("advantage"), F.col("threshold")), art, "MANAGE 2.2", remediation(), F.lit(True)),
        row("dp_sgd_defense_assessment", risk.by_epsilon_report(e), F.lit("Art. 10"), "GOVERN 1.1", spent, e.isNotNull()),
        row("model_inversion", F.lit("HIGH"), F.lit("Art. 15"), "MANAGE 4.1", F.lit(INVERTED), F.col("inversion")),
    )
    out = checked.select("model_id", F.explode(each).alias("f")).select("model_id", "f.*")
    return out if more is None else out.unionByName(more.select(out.columns))


def report(inputs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One document a model: risk_level, articles, recommended_defense, findings (in order of attack), counts by severity, and the
    different hints in order. A model's findings are few."""
    found = findings(inputs, more)
    hints = F.array_sort(F.collect_set("hint"))
    by = found.groupBy("model_id").agg(F.count("*").alias("n_findings"), hints.alias("hints"), F.array_sort(F.collect_list(F.struct("attack", "severity", "articles", "function", "hint"))).alias("findings"))
    art = F.concat_ws(",", _list(F.when(F.col("advantage") > F.col("threshold"), "Art. 10"), F.when(F.col("inversion"), "Art. 15")))
    own = inputs.select("model_id", F.bround("advantage", 4).alias("advantage"), F.bround("epsilon", 4).alias("epsilon"), risk.by_ratio(F.col("advantage"), F.col("threshold")).alias("risk_level"), art.alias("articles"), recommended_defense().alias("recommended_defense"))
    return own.join(by, "model_id").join(severity_summary(found), "model_id")


def severity_summary(found: DataFrame) -> DataFrame:
    """model_id and a count of each level, zeros too; a null severity counts as LOW, unknown ones aren't counted."""
    level = F.coalesce("severity", F.lit("LOW"))
    return found.groupBy("model_id").agg(*[F.sum((level == x).cast("long")).alias(x.lower()) for x in risk.LEVELS])


def compliance(inputs: DataFrame) -> DataFrame:
    """model_id, excess, meaningful, mia_risk, dp_risk, overall, dp_strength, articles."""
    excess = F.bround(F.col("advantage") - F.col("baseline"), 4)
    out = inputs.withColumn("excess", excess)
    out = out.withColumns({"mia_risk": risk.by_excess(F.col("excess")), "dp_risk": risk.by_epsilon(F.col("epsilon")), "meaningful": F.col("excess") > 0.05})
    strength = F.when(F.col("epsilon").isNull(), "none").when(F.col("epsilon") < 2, "strong").when(F.col("epsilon") < 5, "moderate").otherwise("weak")
    articles = F.create_map(*[F.lit(x) for k, v in ARTICLES.items() for x in (k, ",".join(v))])
    out = out.withColumns({"overall": risk.worse(F.col("mia_risk"), F.col("dp_risk")), "dp_strength": strength})
    return out.select("model_id", "excess", "meaningful", "mia_risk", "dp_risk", "overall", "dp_strength", articles[F.col("overall")].alias("articles"))


def mitigations(rows: DataFrame) -> DataFrame:
    """model_id, place (from 0), mitigation: two always, four more from HIGH, two more at CRITICAL, one more without an epsilon."""
    part = lambda name, when: F.when(when, F.array(*map(F.lit, MITIGATE[name]))).otherwise(F.array().cast("array<string>"))
    high, critical = F.col("overall").isin("HIGH", "CRITICAL"), F.col("overall") == "CRITICAL"
    whole = F.concat(part("base", F.lit(True)), part("high", high), part("critical", critical), part("no_epsilon", F.col("dp_strength") == "none"))
    return rows.select("model_id", F.posexplode(whole).alias("place", "mitigation")).withColumn("place", F.col("place").cast("long"))


def techniques(spark: SparkSession) -> DataFrame:
    """finding_type, techniques: the table of the eight types."""
    return spark.createDataFrame(list(TECHNIQUES.items()), "finding_type string, techniques array<string>")


def layer(enriched: DataFrame, name: str) -> DataFrame:
    """layer: one JSON document that a map of techniques is drawn from, techniques in the order of their first finding. There are as many as the index holds."""
    first = enriched.groupBy("technique").agg(F.min(F.struct("finding_id", "place", "confidence")).alias("b"))
    one = F.struct(F.col("technique").alias("techniqueID"), F.floor(F.col("b.confidence") * 100).cast("long").alias("score"), F.lit(f"{name} detection").alias("comment"), F.lit(True).alias("enabled"))
    all_of = first.agg(F.array_sort(F.collect_list(F.struct("b.finding_id", "b.place", one.alias("t")))).alias("s"))
    versions = F.struct(*[F.lit(v).alias(k) for k, v in LAYER_VERSIONS.items()])
    return all_of.select(F.to_json(F.struct(F.lit(f"{name} ATT&CK Coverage").alias("name"), versions.alias("versions"), F.lit("enterprise-attack").alias("domain"), F.transform("s", lambda x: x["t"]).alias("techniques"))).alias("layer"))


def enrich(found: DataFrame, index: DataFrame) -> DataFrame:
    """finding_id, place, technique, confidence: a row for each technique of a finding's type; confidence 0.5 if null; unknown types give none."""
    return found.join(index, "finding_type").select("finding_id", F.posexplode("techniques").alias("place", "technique"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def navigator(enriched: DataFrame) -> DataFrame:
    """technique, score: the first finding of each technique, its confidence in whole percent, truncated."""
    first = F.min(F.struct("finding_id", "confidence")).alias("b")
    return enriched.groupBy("technique").agg(first).select("technique", F.floor(F.col("b.confidence") * 100).cast("long").alias("score"))


def member_overlap(docs: DataFrame) -> DataFrame:
    """text_hash, n_members, n_nonmembers of normalised texts that are on both sides."""
    text = F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r]+", " "))
    even = F.col("doc_id") % 2 == 0
    by = docs.groupBy(F.md5(text).alias("text_hash")).agg(F.sum(even.cast("long")).alias("n_members"), F.sum((~even).cast("long")).alias("n_nonmembers"))
    return by.filter("n_members > 0 AND n_nonmembers > 0")
