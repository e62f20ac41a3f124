"""The registered queries: each a thin plan over the operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmeter.functions import privacy, risk
from veilmeter.operators import boosting, defenses, extraction, membership, models, preprocess, retrained, roc, selection
from veilmeter.plans import reports
from veilmeter.sources import tables
from veilmeter.sources.shared import shared_path, written
from veilmeter.streaming import ordered, state

FINE = "o_custkey"
PRIORITY = "cast(substring(o_orderpriority, 1, 1) as bigint)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def preds(spark: SparkSession, d: str, key: str = FINE) -> DataFrame:
    return models.fit_predict(tables.order_samples(spark, d, key))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return membership.confidence_scores(preds(spark, d))


def curve(spark: SparkSession, d: str) -> DataFrame:
    return roc.curve(scores(spark, d))


# --- SQL shared by the oracles -----------------------------------------------------------------------------------------
def sql_samples(key: str = "o_custkey") -> str:
    return f"""s AS (SELECT o_orderkey AS id, {key} AS k, o_orderpriority, o_custkey,
        CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, o_orderkey % 2 = 0 AS mem FROM orders)"""


def sql_preds(key: str = "o_custkey") -> str:
    return f"""{sql_samples(key)},
    c AS (SELECT k, count(*) FILTER (y=0) n0, count(*) FILTER (y=1) n1, count(*) FILTER (y=2) n2, count(*) n FROM s WHERE mem GROUP BY k),
    pr AS (SELECT s.*, (coalesce(n0,0)+1)::DOUBLE/(coalesce(n,0)+3)::DOUBLE p0, (coalesce(n1,0)+1)::DOUBLE/(coalesce(n,0)+3)::DOUBLE p1,
           (coalesce(n2,0)+1)::DOUBLE/(coalesce(n,0)+3)::DOUBLE p2 FROM s LEFT JOIN c USING (k)),
    pp AS (SELECT *, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS score, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS pred FROM pr)"""


SQL_ROC = """r AS (SELECT score, count(*) FILTER (mem) p, count(*) FILTER (NOT mem) n FROM pp GROUP BY score),
    roc AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM r
            WINDOW w AS (ORDER BY score DESC))"""
SQL_SUMMARY = """sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) AS auc, greatest(0, max(tp/pos::DOUBLE - fp/neg::DOUBLE)) AS advantage,
    coalesce(max(CASE WHEN fp/neg::DOUBLE<=0.01 THEN tp/pos::DOUBLE END),0) AS tpr_at_1pct,
    coalesce(max(CASE WHEN fp/neg::DOUBLE<=0.001 THEN tp/pos::DOUBLE END),0) AS tpr_at_01pct, max(pos)::BIGINT AS n_members, max(neg)::BIGINT AS n_nonmembers"""
W = f"WITH {sql_preds()}"
WR = f"{W}, {SQL_ROC}"
BEST = "SELECT score FROM roc ORDER BY tp*neg+(neg-fp)*pos DESC, score LIMIT 1"


# --- direct test -------------------------------------------------------------------------------------------------------
@query("direct_scores", f"{W} SELECT id AS sample_id, mem AS is_member, score FROM pp")
def direct_scores(spark, d):
    return scores(spark, d).drop("run_id")


@query("direct_scores_maxclass", f"{W} SELECT id AS sample_id, mem AS is_member, greatest(p0,p1,p2) AS score FROM pp")
def direct_scores_maxclass(spark, d):
    return membership.confidence_scores(preds(spark, d), use_true_label=False).drop("run_id")


@query("direct_threshold_median", f"{W} SELECT quantile_cont(score, 0.5) AS threshold FROM pp WHERE mem")
def direct_threshold_median(spark, d):
    return roc.median_threshold(curve(spark, d), True).select("threshold")


@query("direct_threshold_best", f"{WR} SELECT score AS threshold, (tp*neg+(neg-fp)*pos)::DOUBLE/(2*pos::DOUBLE*neg::DOUBLE) AS balanced_accuracy FROM roc ORDER BY tp*neg+(neg-fp)*pos DESC, score LIMIT 1")
def direct_threshold_best(spark, d):
    return roc.best_threshold(curve(spark, d)).drop("run_id")


@query("direct_evaluate", f"""{WR}, t AS ({BEST}) SELECT (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc) AS auc,
    (SELECT score FROM t) AS threshold, round(avg(((pp.score >= (SELECT score FROM t)) = mem)::INT::DOUBLE), 9) AS accuracy, count(*) FILTER (mem) AS n_members, count(*) FILTER (NOT mem) AS n_nonmembers FROM pp""")
def direct_evaluate(spark, d):
    return membership.direct_evaluate(scores(spark, d)).withColumn("accuracy", F.bround("accuracy", 9)).drop("run_id")


@query("direct_fixed_threshold", f"""{W} SELECT 0.6e0 AS threshold, round(avg(((score >= 0.6e0) = mem)::INT::DOUBLE), 9) AS accuracy, round(avg(CASE WHEN mem THEN (score >= 0.6e0)::INT::DOUBLE END), 9) AS tpr,
    round(avg(CASE WHEN NOT mem THEN (score >= 0.6e0)::INT::DOUBLE END), 9) AS fpr FROM pp""")
def direct_fixed_threshold(spark, d):
    found = scores(spark, d)
    return roc.at_threshold(found, membership.fitted_threshold(found, fixed=0.6)).select("threshold", *[F.bround(c, 9).alias(c) for c in ("accuracy", "tpr", "fpr")])


@query("mi_resistance", f"""{WR}, t AS ({BEST}), a AS (SELECT round(avg(((pp.score >= (SELECT score FROM t)) = mem)::INT::DOUBLE), 9) AS acc FROM pp)
    SELECT (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc) AS attack_auc, acc AS attack_accuracy, round(abs(acc-0.5e0), 9) AS advantage, (SELECT score FROM t) AS threshold FROM a""")
def mi_resistance(spark, d):
    return membership.resistance(preds(spark, d)).select("attack_auc", F.bround("attack_accuracy", 9).alias("attack_accuracy"), F.bround("advantage", 9).alias("advantage"), "threshold")


@query("roc_points", f"{WR} SELECT score AS threshold, tp/pos::DOUBLE AS tpr, fp/neg::DOUBLE AS fpr FROM roc UNION ALL SELECT 'inf'::DOUBLE, 0::DOUBLE, 0::DOUBLE")
def roc_points(spark, d):
    return roc.points(curve(spark, d)).drop("run_id")


@query("roc_points_dropped", f"""{WR}, nx AS (SELECT *, lead(p) OVER (ORDER BY score DESC) AS np, lead(n) OVER (ORDER BY score DESC) AS nn, row_number() OVER (ORDER BY score DESC) AS i FROM roc)
    SELECT score AS threshold, tp/pos::DOUBLE AS tpr, fp/neg::DOUBLE AS fpr FROM nx WHERE i = 1 OR np IS NULL OR np <> p OR nn <> n UNION ALL SELECT 'inf'::DOUBLE, 0::DOUBLE, 0::DOUBLE""")
def roc_points_dropped(spark, d):
    return roc.dropped_points(curve(spark, d)).drop("run_id")


@query("roc_summary", f"{WR} SELECT {SQL_SUMMARY} FROM roc")
def roc_summary(spark, d):
    return roc.summary(curve(spark, d)).drop("run_id")


@query("tpr_quantile_rule", f"{W}, t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM pp WHERE NOT mem) SELECT threshold, round(avg((score >= threshold)::INT::DOUBLE), 9) AS tpr FROM pp, t WHERE mem GROUP BY threshold")
def tpr_quantile_rule(spark, d):
    return roc.tpr_by_quantile(curve(spark, d), 0.01).select("threshold", F.round("tpr", 9).alias("tpr"))


@query("tpr_orderstat_rule", f"""{W}, o AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS c FROM pp WHERE NOT mem),
    t AS (SELECT score AS threshold FROM o WHERE i = greatest(0, floor(c*0.001)-1)+1) SELECT threshold, round(avg((score >= threshold)::INT::DOUBLE), 9) AS tpr FROM pp, t WHERE mem GROUP BY threshold""")
def tpr_orderstat_rule(spark, d):
    return roc.tpr_by_order(curve(spark, d)).select("threshold", F.round("tpr", 9).alias("tpr"))


@query("advantage_median", f"{W}, t AS (SELECT quantile_cont(score, 0.5) AS threshold FROM pp) SELECT threshold, round(avg(CASE WHEN mem THEN (score>=threshold)::INT::DOUBLE END) - avg(CASE WHEN NOT mem THEN (score>=threshold)::INT::DOUBLE END), 9) AS advantage FROM pp, t GROUP BY threshold")
def advantage_median(spark, d):
    s = scores(spark, d)
    return roc.at_threshold(s, roc.median_threshold(roc.curve(s), False)).select("threshold", F.round("advantage", 9).alias("advantage"))


@query("advantage_threshold", f"{WR}, t AS ({BEST}) SELECT t.score AS threshold, round(avg(CASE WHEN mem THEN (pp.score>=t.score)::INT::DOUBLE END) - avg(CASE WHEN NOT mem THEN (pp.score>=t.score)::INT::DOUBLE END), 9) AS advantage FROM pp, t GROUP BY t.score")
def advantage_threshold(spark, d):
    s = scores(spark, d)
    return roc.at_threshold(s, roc.best_threshold(roc.curve(s))).select("threshold", F.round("advantage", 9).alias("advantage"))


# --- loss test ---------------------------------------------------------------------------------------------------------
@query("yeom_losses", f"{W} SELECT id AS sample_id, mem AS is_member, round(-ln(greatest(score, 1e-12)), 9) AS loss FROM pp")
def yeom_losses(spark, d):
    return membership.losses(preds(spark, d)).select("sample_id", "is_member", F.round("loss", 9).alias("loss"))


@query("yeom_evaluate", f"""WITH {sql_preds()}, l AS (SELECT mem, round(-ln(greatest(score, 1e-12)), 9) AS loss FROM pp), t AS (SELECT round(avg(loss), 9) AS threshold FROM l WHERE mem),
    a AS (SELECT threshold, round(avg(CASE WHEN mem THEN (loss<=threshold)::INT::DOUBLE END) - avg(CASE WHEN NOT mem THEN (loss<=threshold)::INT::DOUBLE END), 6) AS advantage FROM l, t GROUP BY threshold),
    r AS (SELECT -loss AS score, count(*) FILTER (mem) p, count(*) FILTER (NOT mem) n FROM l GROUP BY loss), roc AS (SELECT *, sum(p) OVER (ORDER BY score DESC) tp, sum(p) OVER () pos, sum(n) OVER () neg FROM r)
    SELECT round(threshold, 6) AS threshold, advantage, round((SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc), 6) AS auc FROM a""")
def yeom_evaluate(spark, d):
    return membership.loss_evaluate(membership.losses(preds(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("threshold", "advantage", "auc")])


def _sliced(spark, d):
    return models.fit_predict(tables.order_samples(spark, d, FINE, F.col("o_orderpriority").alias("slice")))


# --- slices and many models --------------------------------------------------------------------------------------------
@query("generalization_gap", f"{W} SELECT o_orderpriority AS slice, round(avg(CASE WHEN mem THEN (pred=y)::INT::DOUBLE END), 9) AS train_accuracy, round(avg(CASE WHEN NOT mem THEN (pred=y)::INT::DOUBLE END), 9) AS test_accuracy FROM pp GROUP BY 1")
def generalization_gap(spark, d):
    return reports.generalization_gap(_sliced(spark, d), "slice").select("slice", F.round("train_accuracy", 9).alias("train_accuracy"), F.round("test_accuracy", 9).alias("test_accuracy"))


def _roc_by(group: str) -> str:
    return f"""r AS (SELECT {group} AS run_id, score, count(*) FILTER (mem) p, count(*) FILTER (NOT mem) n FROM pp GROUP BY 1, 2),
    roc AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY run_id) AS pos, sum(n) OVER (PARTITION BY run_id) AS neg FROM r WINDOW w AS (PARTITION BY run_id ORDER BY score DESC))"""


@query("leakage_by_slice", f"""WITH {sql_preds()}, px AS (SELECT o_orderpriority AS slice, * FROM pp UNION ALL SELECT 'all' AS slice, * FROM pp),
    {_roc_by('slice').replace('FROM pp', 'FROM px')} SELECT run_id AS slice, {SQL_SUMMARY} FROM roc GROUP BY run_id""")
def leakage_by_slice(spark, d):
    each = _sliced(spark, d).withColumn("slice", F.explode(F.array("slice", F.lit("all"))))
    found = membership.confidence_scores(each, F.col("slice"))
    return roc.summary(roc.curve(found)).withColumnRenamed("run_id", "slice")


def _grains(spark, d):
    out = None
    for name, key in (("coarse", PRIORITY), ("medium", "o_custkey % 50"), ("fine", "o_custkey")):
        one = membership.confidence_scores(preds(spark, d, key), name)
        out = one if out is None else out.unionByName(one)
    return out


def _grain_sql(name: str, key: str) -> str:
    return f"(WITH {sql_preds(key)}, {SQL_ROC} SELECT '{name}' AS run_id, {SQL_SUMMARY} FROM roc)"


@query("multi_model_benchmark", " UNION ALL ".join("SELECT * FROM " + _grain_sql(n, k) for n, k in (("coarse", "o_orderpriority"), ("medium", "o_custkey % 50"), ("fine", "o_custkey"))))
def multi_model_benchmark(spark, d):
    return roc.summary(roc.curve(_grains(spark, d)))


@query("assess_summary", f"""{WR}, a AS (SELECT {SQL_SUMMARY} FROM roc), g AS (SELECT round(avg(CASE WHEN mem THEN (pred=y)::INT::DOUBLE END), 9) AS train_accuracy, round(avg(CASE WHEN NOT mem THEN (pred=y)::INT::DOUBLE END), 9) AS test_accuracy FROM pp)
    SELECT auc, advantage, n_members, n_nonmembers, train_accuracy, test_accuracy, CASE WHEN auc<0.55 THEN 'low' WHEN auc<0.6 THEN 'medium' ELSE 'high' END AS risk FROM a, g""")
def assess_summary(spark, d):
    return reports.assess(tables.order_samples(spark, d)).select("auc", "advantage", "n_members", "n_nonmembers", F.round("train_accuracy", 9).alias("train_accuracy"), F.round("test_accuracy", 9).alias("test_accuracy"), "risk")


# --- shadow models and likelihood ratio --------------------------------------------------------------------------------
IN_SHADOW = "((id*7919 + shadow*104729) % 1000003) % 2 = 0"
SQL_SHADOW = f"""WITH {sql_samples()}, e AS (SELECT s.*, shadow, {IN_SHADOW} AS isin FROM s, (SELECT unnest(range(4)) AS shadow) WHERE id % 4 = 1),
    sc AS (SELECT shadow, k, count(*) FILTER (isin AND y=0) n0, count(*) FILTER (isin AND y=1) n1, count(*) FILTER (isin AND y=2) n2, count(*) FILTER (isin) n FROM e GROUP BY ALL),
    f AS (SELECT e.shadow, id, isin, y, [(n0+1)::DOUBLE/(n+3)::DOUBLE, (n1+1)::DOUBLE/(n+3)::DOUBLE, (n2+1)::DOUBLE/(n+3)::DOUBLE] AS pb FROM e JOIN sc USING (shadow, k)),
    ff AS (SELECT *, list_reverse_sort(pb) AS fs FROM f)"""


def _shadows(spark, d):
    return membership.shadow_features(tables.order_samples(spark, d).filter("sample_id % 4 = 1"))


@query("shadow_features", f"{SQL_SHADOW} SELECT shadow::BIGINT AS shadow, id AS sample_id, isin AS is_in, fs[1] AS f1, fs[2] AS f2, fs[3] AS f3 FROM ff")
def shadow_features(spark, d):
    return _shadows(spark, d).select(F.col("shadow").cast("long").alias("shadow"), "sample_id", "is_in", *[F.col("features")[j].alias(f"f{j + 1}") for j in range(3)])


def _sql_attack(extra_shadow: str, extra_target: str) -> str:
    key = lambda c: f"list_transform({c}, lambda x: round(x*1e6)::BIGINT)"
    return f"""{SQL_SHADOW}, tb AS (SELECT {key('list_concat(fs, ' + extra_shadow + ')')} AS fk, count(*) FILTER (isin) AS ins, count(*) AS n FROM ff GROUP BY 1),
    {sql_preds()[sql_preds().index('c AS'):]},
    q AS (SELECT mem, {key('list_concat(list_reverse_sort([p0,p1,p2]), ' + extra_target + ')')} AS fk FROM pp WHERE id % 4 <> 1),
    sco AS (SELECT mem, (coalesce(ins,0)+1)::DOUBLE/(coalesce(n,0)+2)::DOUBLE AS score FROM q LEFT JOIN tb USING (fk)),
    {SQL_ROC.replace('FROM pp', 'FROM sco')} SELECT {SQL_SUMMARY} FROM roc"""


def _attack(spark, d, labelled):
    target = preds(spark, d).filter("sample_id % 4 <> 1")
    return roc.summary(roc.curve(membership.shadow_attack(_shadows(spark, d), target, labelled))).drop("run_id")


@query("shadow_attack_eval", _sql_attack("[]::DOUBLE[]", "[]::DOUBLE[]"))
def shadow_attack_eval(spark, d):
    return _attack(spark, d, False)


@query("shadow_attack_eval_labelled", _sql_attack("[pb[y+1]]", "[score]"))
def shadow_attack_eval_labelled(spark, d):
    return _attack(spark, d, True)


@query("shadow_evaluate", _sql_attack("[]::DOUBLE[]", "[]::DOUBLE[]").split(f"SELECT {SQL_SUMMARY}")[0] + """, ev AS (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) AS auc FROM roc)
    SELECT (SELECT auc FROM ev) AS auc, round(avg(((score >= 0.5e0) = mem)::INT::DOUBLE), 9) AS accuracy, 4::BIGINT AS n_shadow, count(*) FILTER (mem) AS n_members, count(*) FILTER (NOT mem) AS n_nonmembers FROM sco""")
def shadow_evaluate(spark, d):
    target = preds(spark, d).filter("sample_id % 4 <> 1")
    return membership.shadow_evaluate(membership.shadow_attack(_shadows(spark, d), target), 4).withColumn("accuracy", F.bround("accuracy", 9)).drop("run_id")


@query("shadow_halves", """SELECT o_orderkey AS sample_id, shadow::BIGINT AS shadow, row_number() OVER (PARTITION BY shadow ORDER BY (o_orderkey*7919 + 104729*shadow) % 1000003, o_orderkey) <= count(*) OVER (PARTITION BY shadow)//2 AS is_in
    FROM orders, (SELECT unnest(range(4)) AS shadow)""")
def shadow_halves(spark, d):
    out = membership.with_exact_shadows(tables.order_samples(spark, d).select("sample_id"), 4)
    return out.select("sample_id", F.col("shadow").cast("long").alias("shadow"), "is_in")


def _retrained(spark, d):
    own = tables.embedding_samples(spark, d)
    return retrained.lira_retrained(own.filter("sample_id % 4 = 1"), own.filter("sample_id % 4 <> 1"))


@query("lira_retrained")
def lira_retrained(spark, d):
    return _retrained(spark, d).select("sample_id", "is_member", *[F.round(c, 6).alias(c) for c in ("mean_in", "sd_in", "mean_out", "sd_out", "seen", "score")])


@query("lira_retrained_metrics")
def lira_retrained_metrics(spark, d):
    found = written(_retrained(spark, d), "retrained")  # models are fitted once for all figures
    c = roc.curve(found)
    at = roc.at_threshold(found, roc.median_threshold(c, False)).select("run_id", "advantage")
    low = roc.tpr_by_order(c).select("run_id", F.col("tpr").alias("tpr_at_01pct"))
    return roc.summary(c).select("run_id", "auc", "n_members", "n_nonmembers").join(at, "run_id").join(low, "run_id").drop("run_id")


SQL_LIRA = f"""WITH {sql_samples()}, e AS (SELECT s.*, shadow, {IN_SHADOW} AS isin FROM s, (SELECT unnest(range(16)) AS shadow)),
    sc AS (SELECT shadow, k, count(*) FILTER (isin AND y=0) n0, count(*) FILTER (isin AND y=1) n1, count(*) FILTER (isin AND y=2) n2, count(*) FILTER (isin) n FROM e GROUP BY ALL),
    j AS (SELECT id, mem, CASE y WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END - isin::INT AS c, n - isin::INT AS n FROM e JOIN sc USING (shadow, k)),
    p AS (SELECT id, mem, (c+1)::DOUBLE/(n+3)::DOUBLE AS po, (c+2)::DOUBLE/(n+4)::DOUBLE AS pi FROM j),
    z AS (SELECT id, mem, avg(ln(pi/(1-pi))) mi, round(stddev_pop(ln(pi/(1-pi))), 9)+1e-9 si, avg(ln(po/(1-po))) mo, round(stddev_pop(ln(po/(1-po))), 9)+1e-9 so, quantile_cont(ln(po/(1-po)), 0.5) ob FROM p GROUP BY ALL),
    lr AS (SELECT id, mem, (-0.5*((ob-mi)/si)**2 - ln(si)) - (-0.5*((ob-mo)/so)**2 - ln(so)) AS score FROM z), l AS (SELECT id, mem, CASE WHEN abs(score) < 1e6 THEN round(score, 5) ELSE sign(score)*1e6 END AS score FROM lr)"""


def _shown(score):
    """Scores beyond a million, of samples whose deviation is none, as a million: their digits are noise."""
    return F.when(F.abs(score) < 1e6, F.round(score, 5)).otherwise(F.signum(score) * 1e6)


def _lira(spark, d):
    pool = tables.order_samples(spark, d)
    return membership.lira_scores(pool, pool).withColumn("score", _shown(F.col("score")))


@query("lira_scores", f"{SQL_LIRA} SELECT id AS sample_id, mem AS is_member, score FROM l")
def lira_scores(spark, d):
    return _lira(spark, d).select("sample_id", "is_member", "score")


@query("lira_scores_pooled", f"{SQL_LIRA}, g AS (SELECT stddev_pop(ln(po/(1-po)))+1e-9 AS s FROM p) SELECT id AS sample_id, mem AS is_member, round(-0.5*((ob-mi)/s)**2 + 0.5*((ob-mo)/s)**2, 5) AS score FROM z, g")
def lira_scores_pooled(spark, d):
    pool = tables.order_samples(spark, d)
    return membership.lira_scores(pool, pool, pooled=True).select("sample_id", "is_member", F.round("score", 5).alias("score"))


@query("lira_metrics", f"""{SQL_LIRA}, pp AS (SELECT mem, score FROM l), {SQL_ROC}, md AS (SELECT quantile_cont(score, 0.5) AS m FROM pp),
    o AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS c FROM pp WHERE NOT mem), th AS (SELECT score AS s FROM o WHERE i = greatest(0, floor(c*0.001)-1)+1)
    SELECT (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc) AS auc, round(avg(CASE WHEN mem THEN (score>=m)::INT::DOUBLE END) - avg(CASE WHEN NOT mem THEN (score>=m)::INT::DOUBLE END), 9) AS advantage,
    round(avg(CASE WHEN mem THEN (score>=s)::INT::DOUBLE END), 9) AS tpr_at_01pct, count(*) FILTER (mem) AS n_members, count(*) FILTER (NOT mem) AS n_nonmembers FROM pp, md, th""")
def lira_metrics(spark, d):
    found = written(_lira(spark, d), "lira")
    c = roc.curve(found)
    at = roc.at_threshold(found, roc.median_threshold(c, False)).select("run_id", F.round("advantage", 9).alias("advantage"))
    low = roc.tpr_by_order(c).select("run_id", F.round("tpr", 9).alias("tpr_at_01pct"))
    return roc.summary(c).select("run_id", "auc", "n_members", "n_nonmembers").join(at, "run_id").join(low, "run_id").drop("run_id")


# --- extraction and inversion ------------------------------------------------------------------------------------------
@query("extraction_agreement", f"""{W}, q AS (SELECT o_custkey % 50 AS g, pred, count(*) AS c FROM pp WHERE id % 4 = 1 GROUP BY ALL),
    b AS (SELECT g, pred AS sub FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, pred) AS i FROM q) WHERE i = 1)
    SELECT count(*) AS n, round(avg((pred = coalesce(sub, 0))::INT::DOUBLE), 9) AS agreement FROM pp LEFT JOIN b ON o_custkey % 50 = g WHERE id % 4 = 3""")
def extraction_agreement(spark, d):
    rows = preds(spark, d).withColumn("g", F.col("k") % 50)
    found = extraction.agreement(rows.filter("sample_id % 4 = 3"), extraction.extract(rows.filter("sample_id % 4 = 1"), "g"), "g")
    return found.select("n", F.round("agreement", 9).alias("agreement"))


@query("inversion_argmax", f"""WITH {sql_samples()}, c AS (SELECT k, count(*) FILTER (y=0) n0, count(*) FILTER (y=1) n1, count(*) FILTER (y=2) n2, count(*) n FROM s WHERE mem GROUP BY k),
    u AS (SELECT 0 AS label, k, (n0+1)::DOUBLE/(n+3)::DOUBLE p FROM c UNION ALL SELECT 1, k, (n1+1)::DOUBLE/(n+3)::DOUBLE FROM c UNION ALL SELECT 2, k, (n2+1)::DOUBLE/(n+3)::DOUBLE FROM c)
    SELECT label::BIGINT AS label, k, p AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p DESC, k) AS i FROM u) WHERE i = 1""")
def inversion_argmax(spark, d):
    return extraction.invert_argmax(models.count_model(tables.order_samples(spark, d)))


@query("inversion_hillclimb")
def inversion_hillclimb(spark, d):
    own = tables.embedding_samples(spark, d)
    one = own.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centroids = one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return extraction.hill_climb(centroids, 0)


@query("inversion_report")
def inversion_report(spark, d):
    return extraction.inversion_report(inversion_best(spark, d), 0, 5, 500)


@query("inversion_best")
def inversion_best(spark, d):
    return extraction.best_restart(inversion_hillclimb(spark, d))


# --- least likely tokens -----------------------------------------------------------------------------------------------
def _sql_tokens(name: str, source: str, ident: str) -> str:
    return f"{name} AS (SELECT id, w FROM (SELECT {ident} AS id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r]+')) AS w FROM {source}) WHERE w <> '')"


def _sql_mink(k: str = "0.2E0", source: str = "documents", ident: str = "doc_id") -> str:
    return f"""{_sql_tokens('tk', source, ident)}, {_sql_tokens('mt', '(SELECT * FROM documents WHERE doc_id % 2 = 0)', 'doc_id')},
    um AS (SELECT w, count(*) AS c FROM mt GROUP BY w), sz AS (SELECT (sum(c)+count(*)+1)::DOUBLE AS size FROM um),
    lp AS (SELECT id, ln((coalesce(c,0)+1)::DOUBLE/size) AS lp FROM tk LEFT JOIN um USING (w), sz),
    o AS (SELECT id, lp, row_number() OVER (PARTITION BY id ORDER BY lp) AS i, count(*) OVER (PARTITION BY id) AS n FROM lp),
    mk AS (SELECT id, n AS n_tokens, greatest(1, ceil({k}*n))::BIGINT AS n_min, avg(lp) AS score FROM o WHERE n >= 10 AND i <= greatest(1, ceil({k}*n)) GROUP BY id, n)"""


def _token_log_probs(spark, d, docs=None, id_name="doc_id"):
    own = tables.read(spark, d, "documents")
    return models.document_log_probs(own if docs is None else docs, models.word_counts(own.filter("doc_id % 2 = 0")), id_name)


def _mink(spark, d, k=0.2, docs=None, id_name="doc_id"):
    return membership.min_k(_token_log_probs(spark, d, docs, id_name), k)


def _mink_scores(found):
    return found.select(F.lit("run").alias("run_id"), F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 2 == 0).alias("is_member"), F.round("score", 6).alias("score"))


@query("mink_scores", f"WITH {_sql_mink()} SELECT id AS doc_id, n_tokens, n_min, round(score, 6) AS score FROM mk")
def mink_scores(spark, d):
    return _mink(spark, d).withColumn("score", F.round("score", 6))


@query("mink_evaluate", f"WITH {_sql_mink()}, pp AS (SELECT id % 2 = 0 AS mem, round(score, 6) AS score FROM mk), {SQL_ROC}, t AS (SELECT quantile_cont(score, 0.99) AS thr FROM pp WHERE NOT mem) SELECT (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc) AS auc, round(avg(CASE WHEN mem THEN (score >= thr)::INT::DOUBLE END), 9) AS tpr_at_1pct, count(*) FILTER (mem) AS n_members, count(*) FILTER (NOT mem) AS n_nonmembers, 'min_k_prob' AS method, 'documents' AS dataset FROM pp, t")
def mink_evaluate(spark, d):
    c = roc.curve(written(_mink_scores(_mink(spark, d)), "mink"))
    at = roc.tpr_by_quantile(c, 0.01).select("run_id", F.round("tpr", 9).alias("tpr_at_1pct"))
    found = roc.summary(c).select("run_id", "auc", "n_members", "n_nonmembers").join(at, "run_id").drop("run_id")
    return found.withColumns({"method": F.lit("min_k_prob"), "dataset": F.lit("documents")})


SQL_NGRAM = """WITH l AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents),
    b AS (SELECT id, unnest(list_zip(w[1:-2], w[2:])) AS z FROM l WHERE len(w) > 1), g AS (SELECT id, z[1] AS v, z[2] AS w FROM b),
    c2 AS (SELECT v, w, count(*) AS c FROM g WHERE id % 2 = 0 GROUP BY ALL), cx AS (SELECT v, sum(c) AS total, count(*) AS kinds FROM c2 GROUP BY v), c1 AS (SELECT w, count(*) AS k FROM c2 GROUP BY w),
    sz AS (SELECT (sum(k) + count(*) + 1)::DOUBLE AS size FROM c1),
    lp AS (SELECT g.id, ln(CASE WHEN total IS NULL THEN (coalesce(k, 0)+1)/size ELSE greatest(coalesce(c, 0) - 0.75e0, 0)/total::DOUBLE + 0.75e0*kinds/total::DOUBLE*((coalesce(k, 0)+1)/size) END) AS lp
      FROM g LEFT JOIN c1 USING (w) LEFT JOIN cx USING (v) LEFT JOIN c2 USING (v, w), sz),
    o AS (SELECT id, lp, row_number() OVER (PARTITION BY id ORDER BY lp) AS i, count(*) OVER (PARTITION BY id) AS n FROM lp),
    mk AS (SELECT id, n AS n_tokens, greatest(1, ceil(0.2e0*n))::BIGINT AS n_min, avg(lp) AS score FROM o WHERE n >= 10 AND i <= greatest(1, ceil(0.2e0*n)) GROUP BY id, n)"""


def _ngram(spark, d):
    """Scores under a model of word pairs, fitted on the members."""
    own, member = tables.read(spark, d, "documents"), F.col("doc_id") % 2 == 0
    pairs = models.pair_counts(own, member)
    if pairs is not None:
        return membership.min_k(models.pair_log_probs(own, pairs))
    salt = models.word_salt(own)  # two words have one hash of `Words`
    levels = models.ngram_levels(models.grams(own.filter(member), 2, salt=salt), 2)
    found = models.ngram_log_probs(models.grams(own, 2, salt=salt), levels).select("doc_id", "logp")
    return membership.min_k(found.repartition("doc_id"))  # a document's words come from everywhere, so they are sent to one place once


@query("mink_ngram_scores", f"{SQL_NGRAM} SELECT id AS doc_id, n_tokens, n_min, round(score, 6) AS score FROM mk")
def mink_ngram_scores(spark, d):
    return _ngram(spark, d).withColumn("score", F.round("score", 6))


@query("mink_ngram_evaluate", f"{SQL_NGRAM}, pp AS (SELECT id % 2 = 0 AS mem, round(score, 6) AS score FROM mk), {SQL_ROC}, t AS (SELECT quantile_cont(score, 0.99) AS thr FROM pp WHERE NOT mem) SELECT (SELECT sum(n*(2*(tp-p)+p))::DOUBLE/(2*max(pos)::DOUBLE*max(neg)::DOUBLE) FROM roc) AS auc, round(avg(CASE WHEN mem THEN (score >= thr)::INT::DOUBLE END), 9) AS tpr_at_1pct, count(*) FILTER (mem) AS n_members, count(*) FILTER (NOT mem) AS n_nonmembers FROM pp, t")
def mink_ngram_evaluate(spark, d):
    c = roc.curve(written(_mink_scores(_ngram(spark, d)), "mink"))
    at = roc.tpr_by_quantile(c, 0.01).select("run_id", F.round("tpr", 9).alias("tpr_at_1pct"))
    return roc.summary(c).select("run_id", "auc", "n_members", "n_nonmembers").join(at, "run_id").drop("run_id")


KS = (0.1, 0.2, 0.3, 0.5)


@query("mink_k_sweep", " UNION ALL ".join(f"SELECT * FROM (WITH {_sql_mink(f'{k}E0')} SELECT {k}::DOUBLE AS k, count(*) AS n_docs, round(avg(score), 6) AS mean_score FROM mk)" for k in KS))
def mink_k_sweep(spark, d):
    return membership.min_k_sweep(_token_log_probs(spark, d), KS).withColumn("mean_score", F.round("mean_score", 6))


@query("mink_members_vs_benchmark", f"WITH {_sql_mink(source='benchmark', ident='item_id')} SELECT id AS item_id, n_tokens, round(score, 6) AS score FROM mk")
def mink_members_vs_benchmark(spark, d):
    found = _mink(spark, d, docs=tables.read(spark, d, "benchmark"), id_name="item_id")
    return found.select(F.col("doc_id").alias("item_id"), "n_tokens", F.round("score", 6).alias("score"))


# --- defenses ----------------------------------------------------------------------------------------------------------
@query("dpsgd_first_step", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label=0 THEN 1e0 ELSE 0e0 END AS y FROM embeddings),
    g AS (SELECT vec_id, list_transform(v, lambda x: (0.5e0-y)*x) AS g FROM e), n AS (SELECT g, sqrt(list_sum(list_transform(g, lambda x: x*x))) AS nm FROM g),
    u AS (SELECT unnest(range(len(g))) AS coordinate, unnest(list_transform(g, lambda x: CASE WHEN nm > 0.4e0 THEN x*0.4e0/nm ELSE x END)) AS x FROM n)
    SELECT coordinate::BIGINT AS coordinate, round(avg(x), 6) AS gradient FROM u GROUP BY 1""")
def dpsgd_first_step(spark, d):
    return defenses.first_step(tables.embedding_samples(spark, d)).withColumn("gradient", F.round("gradient", 6))


@query("dpsgd_sweep")
def dpsgd_sweep(spark, d):
    grid = spark.createDataFrame([(f"s{s}", s, 1e-5) for s in (0.7, 1.0, 2.0, 4.0)], "run_id string, sigma double, delta double")
    fits = defenses.dp_sgd(tables.embedding_samples(spark, d), grid)
    return fits.join(privacy.compute_epsilon(fits), "run_id").select("run_id", "steps", F.round("accuracy", 4).alias("accuracy"), F.round("epsilon", 4).alias("epsilon"), "alpha")


SQL_SOFT = """WITH z AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: greatest(-10e0, least(10e0, x*5))/2e0) AS z FROM embeddings),
    e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)"""


def _perturbed(spark, d):
    scaled = F.transform("features", lambda x: x * 5)
    return tables.embedding_samples(spark, d).select("sample_id", defenses.perturb(scaled, temperature=2.0, noise=0).alias("z"))


@query("output_perturb_clean", f"{SQL_SOFT} SELECT vec_id AS sample_id, unnest(range(len(z)))::BIGINT AS i, round(unnest(z), 6) AS z FROM e")
def output_perturb_clean(spark, d):
    return _perturbed(spark, d).select("sample_id", F.posexplode("z").alias("i", "z")).select("sample_id", F.col("i").cast("long").alias("i"), F.round("z", 6).alias("z"))


@query("softmax_proba", f"{SQL_SOFT} SELECT vec_id AS sample_id, unnest(range(len(e)))::BIGINT AS i, round(unnest(list_transform(e, lambda x: x/list_sum(e))), 6) AS p FROM e")
def softmax_proba(spark, d):
    return _perturbed(spark, d).select("sample_id", F.posexplode(defenses.softmax(F.col("z"))).alias("i", "p")).select("sample_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


@query("label_smoothing_loss", """WITH e AS (SELECT vec_id, label, (embedding::DOUBLE[])[1:10] AS v FROM embeddings), t AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lse FROM e),
    u AS (SELECT vec_id, label, lse, unnest(v) AS x, unnest(range(10)) AS j FROM t) SELECT vec_id AS sample_id, round(sum((CASE WHEN j=label THEN 0.9e0 ELSE 0.1e0/9 END)*(lse-x)), 6) AS loss FROM u GROUP BY 1""")
def label_smoothing_loss(spark, d):
    e = tables.embedding_samples(spark, d)
    return e.select("sample_id", F.round(defenses.smoothed_loss(F.slice("features", 1, 10), F.col("label"), 0.1, 10), 6).alias("loss"))


SQL_STOPPING = """WITH RECURSIVE v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f(user_id, i, best, counter, stopped) AS (SELECT DISTINCT user_id, 0::BIGINT, 'inf'::DOUBLE, 0::BIGINT, false FROM v
      UNION ALL SELECT f.user_id, v.i, CASE WHEN value < best-0.5 THEN value ELSE best END, CASE WHEN value < best-0.5 THEN 0 ELSE counter+1 END, stopped OR (NOT value < best-0.5 AND counter+1 >= 3) FROM f JOIN v ON v.user_id=f.user_id AND v.i=f.i+1)
    SELECT user_id, best, counter::BIGINT AS counter, stopped, i AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM f) WHERE r=1"""


@query("early_stopping", SQL_STOPPING)
def early_stopping(spark, d):
    return defenses.early_stopping(tables.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value", patience=3, min_delta=0.5)


SQL_RUNNING = """SELECT user_id, event_id, step, round(sqrt(step)*0.01e0/2e0*4.264890793922825e0 + (sqrt(step)*0.01e0/2e0)**2/2, 6) AS epsilon FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"""


@query("accountant_running", SQL_RUNNING)
def accountant_running(spark, d):
    return state.running_accountant(tables.read(spark, d, "events"), 2.0, 500, 1e-5).withColumn("epsilon", F.round("epsilon", 6))


FILES, LATE = 6, 3600


def _streamed(spark, d, plan):
    """plan over the events as a stream that comes in FILES parts, each event up to LATE seconds late, then two events that move the watermark past all; what
    it gives is written by a streaming sink and read back. A part is written by as many tasks as the table has splits, and the stream takes up what
    has come since it last ran."""
    events = tables.read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    comes = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE))
    low, high = events.agg(F.min(comes), F.max(comes)).first()
    place = F.floor((comes - low) * FILES / (high - low + 1)) if low is not None else F.lit(0)
    source, sink, state_dir = (shared_path(spark, f"stream-{x}") for x in ("events", "out", "state"))

    def later(k):
        late = F.timestamp_seconds(F.lit((high or 0) + k * 10**8))
        return spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), late.cast(events.schema["ts"].dataType).alias("ts"), F.lit(-k).cast("long").alias("event_id"), F.lit(0.0).alias("value"))

    for part in [*[events.filter(place == k) for k in range(FILES)], later(1), later(2)]:  # one after another, as they would come
        part.write.mode("append").parquet(source)
        out = plan(spark.readStream.schema(events.schema).parquet(source))
        run = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state_dir).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink).filter("user_id >= 0")


@query("early_stopping_stream", SQL_STOPPING)
def early_stopping_stream(spark, d):
    each = _streamed(spark, d, lambda s: ordered.early_stopping(s, patience=3, min_delta=0.5, delay="2 hours"))
    last = F.max_by(F.struct("best", "counter", "stopped", "n"), "n").alias("b")
    return each.groupBy("user_id").agg(last).select("user_id", "b.*")


@query("accountant_stream", SQL_RUNNING)
def accountant_stream(spark, d):
    return _streamed(spark, d, lambda s: ordered.running_accountant(s, 2.0, 500, 1e-5, delay="2 hours")).withColumn("epsilon", F.round("epsilon", 6))


@query("batch_clip_step", """WITH e AS (SELECT embedding::DOUBLE[] AS v, CASE WHEN label=0 THEN 1e0 ELSE 0e0 END AS y FROM embeddings), u AS (SELECT unnest(range(len(v))) AS j, unnest(list_transform(v, lambda x: (0.5e0-y)*x)) AS x FROM e),
    g AS (SELECT j, avg(x) AS g FROM u GROUP BY j) SELECT j::BIGINT AS coordinate, round(g*least(1e0, 0.01e0/(sqrt((SELECT sum(g*g) FROM g))+1e-6)), 6) AS gradient FROM g""")
def batch_clip_step(spark, d):
    return defenses.batch_step(tables.embedding_samples(spark, d)).withColumn("gradient", F.round("gradient", 6))


# --- preprocessing and data quality ------------------------------------------------------------------------------------
@query("label_encode", "SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def label_encode(spark, d):
    return preprocess.label_encode(tables.read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


NULLED = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"


@query("median_impute", f"WITH c AS (SELECT c_custkey, {NULLED} AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM c)), 6) AS b FROM c")
def median_impute(spark, d):
    return preprocess.median_impute(tables.read(spark, d, "customer").select("c_custkey", F.expr(NULLED).alias("b")), "b").withColumn("b", F.round("b", 6))


@query("impute_columns", """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS b, CASE WHEN l_orderkey % 3 <> 0 THEN l_discount END AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM c)), 6) AS a, round(coalesce(b, (SELECT quantile_cont(b, 0.5) FROM c)), 6) AS b, round(coalesce(c, (SELECT quantile_cont(c, 0.5) FROM c)), 6) AS c FROM c""")
def impute_columns(spark, d):
    gap = lambda k, c: F.when(F.col("l_orderkey") % k != 0, F.col(c).cast("double"))
    own = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gap(7, "l_quantity").alias("a"), gap(5, "l_extendedprice").alias("b"), gap(3, "l_discount").alias("c"))
    return preprocess.median_impute_columns(own, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in "abc"])


@query("standard_scale", "WITH f AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, round((c_acctbal - m)/s, 6) AS z FROM customer, f")
def standard_scale(spark, d):
    return preprocess.standard_scale(tables.read(spark, d, "customer"), "c_acctbal", F.col("c_custkey") % 2 == 0, "z").select("c_custkey", F.round("z", 6).alias("z"))


@query("stratified_split", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey*7919+104729) % 1000003, o_orderkey) <= ceil(0.3e0 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM orders""")
def stratified_split(spark, d):
    return preprocess.stratified_split(tables.read(spark, d, "orders"), "o_orderstatus", "o_orderkey", 0.3).select("o_orderkey", "is_test")


@query("member_overlap_check", """SELECT md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_hash, count(*) FILTER (doc_id % 2 = 0) AS n_members, count(*) FILTER (doc_id % 2 = 1) AS n_nonmembers FROM documents GROUP BY 1 HAVING count(*) FILTER (doc_id % 2 = 0) > 0 AND count(*) FILTER (doc_id % 2 = 1) > 0""")
def member_overlap_check(spark, d):
    return reports.member_overlap(tables.read(spark, d, "documents"))


@query("impute_components", """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 5 <> 0 THEN x END AS x FROM e)
    SELECT vec_id AS sample_id, i::BIGINT AS i, round(coalesce(x, (SELECT quantile_cont(m.x, 0.5) FROM n m WHERE m.i = n.i)), 9) AS x FROM n""")
def impute_components(spark, d):
    gaps = F.transform("features", lambda x, i: F.when((F.col("sample_id") + i) % 5 != 0, x))
    out = preprocess.median_impute_array(tables.embedding_samples(spark, d).withColumn("features", gaps), "features", "sample_id")
    return out.select("sample_id", F.posexplode("features").alias("i", "x")).select("sample_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("target_derivation", """SELECT c_custkey, rtrim(trim(' ' || c_mktsegment || '. '), '.') IN ('BUILDING', 'MACHINERY') AS y FROM customer""")
def target_derivation(spark, d):
    raw = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(". "))
    return tables.read(spark, d, "customer").select("c_custkey", (preprocess.binary_target(raw, ["BUILDING", "MACHINERY"]) == 1).alias("y"))


@query("target_encode", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code FROM customer")
def target_encode(spark, d):
    own = preprocess.target_encode(tables.read(spark, d, "customer"), "c_acctbal", "whole")
    return preprocess.target_encode(own, "c_mktsegment", "code").select("c_custkey", "whole", "code")


@query("class_balance", "SELECT round(avg((o_orderstatus = 'O')::INT::DOUBLE), 9) AS balance FROM orders")
def class_balance(spark, d):
    return preprocess.class_balance(tables.order_samples(spark, d), "label").withColumn("balance", F.round("balance", 9))


# --- trained models ----------------------------------------------------------------------------------------------------
def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return tables.embedding_samples(spark, d).withColumn("features", array_to_vector("features"))


@query("extraction_mllib")
def extraction_mllib(spark, d):
    from veilmeter.operators import trained

    rows = _vectors(spark, d).withColumn("label", (F.col("label") == 0).cast("int"))
    target = trained.shadow("random_forest").setMaxDepth(10).fit(rows.filter("is_member"))
    asked = target.transform(rows).select("sample_id", "features", F.col("prediction").alias("target"))
    substitute = trained.substitute("decision_tree", labelCol="target").fit(asked.filter("sample_id % 4 = 1"))
    said = substitute.transform(asked.filter("sample_id % 4 = 3"))
    return said.agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("agreement"))


@query("extraction_mlp")
def extraction_mlp(spark, d):
    """A perceptron copies a logistic target."""
    from veilmeter.operators import trained

    rows = _vectors(spark, d).withColumn("label", (F.col("label") == 0).cast("int"))
    asked = trained.shadow("logistic_regression").fit(rows.filter("is_member")).transform(rows).select("sample_id", "features", F.col("prediction").alias("target"))
    size = len(rows.first()["features"])
    said = trained.substitute("mlp", size, 2, labelCol="target").setMaxIter(50).fit(asked.filter("sample_id % 4 = 1")).transform(asked.filter("sample_id % 4 = 3"))
    return said.agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("agreement"))


def _tabular(spark, d):
    """Orders as sample_id, label (0, 1, 2), features and side: 0 to 5 train, 6 and 7 public, 8 and 9 held out."""
    day = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double")
    features = F.array(F.col("o_custkey").cast("double"), F.col("o_totalprice").cast("double"), day, F.expr(PRIORITY).cast("double"))
    return tables.order_samples(spark, d, FINE, features.alias("features")).withColumn("side", F.pmod(F.shiftright(selection.mixed(F.col("sample_id")), 4), F.lit(10)))


def _boosted_settings():
    from veilmeter.operators import trained

    return {name: {"kind": "boosted", "trees": t, "depth": depth, "rate": rate, "leaf": leaf} for name, (t, depth, rate, leaf) in trained.BOOSTED.items()}


def _rounded(seen):
    return seen.withColumn("proba", F.transform("proba", lambda p: F.round(p, 9)))


def _shadow_scores(spark, own, target_rows, shadows=4):
    """Scores (run_id, is_member, score, n_rows) of the target's rows (run_id, is_member, proba, n_rows) by forests: the shadows' sorted probabilities, in and
    out, train the attack."""
    forest = {"kind": "forest", "trees": 100, "depth": 30}
    names = {f"shadow-{k}": forest | {"seed": 42 + k} for k in range(shadows)}
    pool = membership.with_exact_shadows(own.filter("side IN (6, 7)"), shadows)
    pool = pool.select(F.concat(F.lit("shadow-"), "shadow").alias("data"), "features", "label", F.lit(1).alias("n"), F.col("is_in").alias("is_train"))
    seen = _rounded(boosting.said(pool, names, {k: k for k in names}, 3, ["is_train"]))
    sort = F.sort_array("proba", asc=False).alias("features")
    train = seen.select(sort, F.col("is_train").cast("int").alias("label"), F.col("n_rows").alias("n"), F.lit(True).alias("is_train"), F.lit("").alias("target"), F.lit(True).alias("is_member"))
    asked = target_rows.select(sort, F.lit(None).cast("int").alias("label"), F.col("n_rows").alias("n"), F.lit(False).alias("is_train"), F.col("run_id").alias("target"), "is_member")
    rows = train.unionByName(asked).withColumn("data", F.lit("attack"))
    found = _rounded(boosting.said(rows, {"attack": forest | {"seed": 42}}, {"attack": "attack"}, 2, ["is_train", "target", "is_member"])).filter("NOT is_train")
    return found.select(F.col("target").alias("run_id"), "is_member", F.get("proba", F.lit(1)).alias("score"), "n_rows")


def _targets(rows, settings):
    """What boosted targets say of all rows (features, label, is_member), fitted on all members: run_id, is_member, label, proba, pred, n_rows."""
    own = rows.select(F.lit("members").alias("data"), "features", "label", F.lit(1).alias("n"), F.col("is_member").alias("is_train"))
    return _rounded(boosting.said(own, settings, dict.fromkeys(settings, "members"), 3, ["is_train"]).withColumnRenamed("is_train", "is_member"))


def _direct_scores(seen):
    return seen.select("run_id", "is_member", F.col("proba")[F.col("label")].alias("score"), "n_rows")


@query("boosted_benchmark")
def boosted_benchmark(spark, d):
    """A row for each boosted setting, its published trees and all, and attack: direct, and by four shadow forests and an attack forest."""
    own = _tabular(spark, d)
    seen = written(_targets(own.filter("side < 6 OR side > 7").withColumn("is_member", F.col("side") < 6), _boosted_settings()), "targets")
    gap = reports.generalization_gap(seen, "run_id", "n_rows")
    direct = _direct_scores(seen)
    shadow = written(_shadow_scores(spark, own, seen), "shadow-scores")
    found = roc.curve(direct, "n_rows")
    best = roc.at_threshold(direct, roc.best_threshold(found), "n_rows").select("run_id", "threshold", "accuracy").withColumn("attack", F.lit("direct"))
    half = roc.at_threshold(shadow, shadow.select("run_id").distinct().withColumn("threshold", F.lit(0.5)), "n_rows").select("run_id", "threshold", "accuracy").withColumn("attack", F.lit("shadow"))
    both = roc.summary(found).withColumn("attack", F.lit("direct")).unionByName(roc.summary(roc.curve(shadow, "n_rows")).withColumn("attack", F.lit("shadow")))
    return both.join(best.unionByName(half), ["run_id", "attack"]).join(gap, "run_id")


@query("direct_by_source")
def direct_by_source(spark, d):
    """The direct test on one logistic target whose answers come from a table, from MLlib, and from a function that a task loads."""
    import numpy as np

    from veilmeter.operators import trained
    from veilmeter.sources import predictions

    rows = _vectors(spark, d).withColumn("label", (F.col("label") == 0).cast("int"))
    member = rows.filter("is_member")
    model = trained.shadow("logistic_regression", rows=member.count()).fit(member)
    weights, start = model.coefficients.toArray(), model.intercept

    def load():
        def answer(x):
            p = 1 / (1 + np.exp(-(x @ weights + start)))
            return np.stack([1 - p, p], axis=1)

        return answer

    own = predictions.from_mllib(rows, model)
    plain = tables.embedding_samples(spark, d).withColumn("label", (F.col("label") == 0).cast("int"))
    each = {"mllib": own, "table": predictions.from_table(written(own, "answers")), "function": predictions.from_function(plain, load)}
    found = [membership.confidence_scores(_rounded(x), name) for name, x in each.items()]
    return roc.summary(roc.curve(found[0].unionByName(found[1]).unionByName(found[2])))


@query("assess_chain")
def assess_chain(spark, d):
    """The whole assessment of a table: encode, impute, split by label, scale by the training rows, fit the default target, attack it, report."""
    raw = tables.order_samples(spark, d, FINE, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("double")).alias("price"), "o_orderpriority", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double").alias("day"))
    table = preprocess.median_impute(preprocess.label_encode(raw, "o_orderpriority", "code"), "price")
    table = written(preprocess.stratified_split(table, "label", "sample_id", 0.3), "assessed")
    names = ["k", "price", "day", "code"]
    for name in names:
        table = preprocess.standard_scale(table, name, ~F.col("is_test"), f"z_{name}")
    rows = table.select("label", (~F.col("is_test")).alias("is_member"), F.array(*[f"z_{n}" for n in names]).alias("features"))
    seen = written(_targets(rows, {"default": _boosted_settings()["default"]}), "targets")
    found = roc.summary(roc.curve(_direct_scores(seen), "n_rows")).join(reports.generalization_gap(seen, "run_id", "n_rows"), "run_id")
    size = table.agg(F.count("*").alias("n_samples"))
    four = lambda c: F.bround(c, 4).alias(c)
    return found.select(F.lit("orders").alias("dataset"), four("train_accuracy"), four("test_accuracy"), four("gap"), four("auc"), four("advantage"), risk.by_auc(F.col("auc")).alias("risk_level"), "n_members", "n_nonmembers").withColumns({"n_samples": size.select("n_samples").scalar(), "n_features": F.lit(len(names)).cast("long")})


@query("shadow_mllib_eval")
def shadow_mllib_eval(spark, d):
    """Single trees as target and shadows: the shadows' sorted probabilities train the attack, which ranks the target's samples."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _vectors(spark, d)
    sort = lambda df: df.withColumn("f", F.sort_array(vector_to_array("probability"), asc=False))
    fit = lambda df: DecisionTreeClassifier(maxDepth=8, seed=42).fit(df)
    pool, train = rows.filter("sample_id % 4 = 1"), None
    for k in range(2):
        own = pool.withColumn("is_in", membership.in_shadow(F.col("sample_id"), F.lit(k)))
        one = sort(fit(own.filter("is_in")).transform(own)).select("f", F.col("is_in").cast("int").alias("label"))
        train = one if train is None else train.union(one)
    size = F.slice("f", 1, 3)
    attack = LogisticRegression(maxIter=50, regParam=0.01).fit(train.select(array_to_vector(size).alias("features"), "label"))
    target = fit(rows.filter("is_member"))
    seen = sort(target.transform(rows.filter("sample_id % 4 <> 1"))).select("sample_id", "is_member", array_to_vector(size).alias("features"))
    found = attack.transform(seen).select(F.lit("run").alias("run_id"), "is_member", F.round(vector_to_array("probability")[1], 9).alias("score"))
    return roc.summary(roc.curve(found)).drop("run_id")


from veilmeter.plans import measured  # noqa: E402, F401  registers the queries over measured runs
