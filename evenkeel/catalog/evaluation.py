"""Classifier tests on the labelled documents and the fidelity report."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, shuffled_sql, tidy, u_sql
from evenkeel.functions.draws import uniform
from evenkeel.operators.generator import ConditionalGenerator
from evenkeel.operators.splits import stratified_split, thin_minority
from evenkeel.plans import evaluate as op
from evenkeel.plans.sampling import sampling_plan
from evenkeel.session import reuse
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec

DOCS = FeatureSpec("good", "doc_id", ["n_chars", "n_words"], ["lang"])
FOREST = {"n_estimators": 10, "max_depth": 5, "min_samples_leaf": 5}


def _docs(spark, sf):
    """Labelled documents; poor quality is the rare class."""
    docs = load_table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"))
    labels = load_table(spark, sf, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("good"))
    return docs.join(labels, "doc_id").select(*DOCS.columns)


def _cut(spark, sf):
    both = reuse(stratified_split(_docs(spark, sf), "good", 0.33, "doc_id", seed=1))
    return (both.filter(~F.col("is_test")).drop("is_test"), both.filter("is_test").drop("is_test"))


CUT = f"""docs as (
  select d.doc_id, 1 - l.quality as good from documents d join labels l using (doc_id)),
cut as (
  select doc_id, good, {shuffled_sql('split1', 'doc_id', 'good')}
         <= round(count(*) over (partition by good) * 0.33) as is_test from docs),
sizes as (select count(*) filter (good = 1) as n1, count(*) filter (good = 0) as n0 from cut where not is_test)"""


def _checked(df, columns, *scores):
    """Scores depend on how Spark ML sums up; what must hold for them is that they lie in their range."""
    good = F.lit(True)
    for name, low, high in scores:
        good = good & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return df.select(*columns, good.alias("in_range"))


@query("classifier_scores", "N-1", f"""
with {CUT}
select doc_id, good, model, true as in_range from cut, (values ('LR'), ('RF'), ('DT')) m(model) where is_test""")
def classifier_scores(spark, sf):
    """Every held-out row is scored by each model, with a probability."""
    train, test = _cut(spark, sf)
    out = None
    for model, params in (("LR", {"C": 10}), ("RF", FOREST), ("DT", {"max_depth": 5})):
        one = op.fit_score(train, test, DOCS, model, params).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return _checked(out, ["doc_id", "good", "model"], ("score", 0, 1))


@query("input_importance", "F-3", "select i::int as place, true as in_range from range(1, 6) t(i)")
def input_importance(spark, sf):
    train, _ = _cut(spark, sf)
    top = op.rank_importance(op.fit_classifier(train, DOCS, "RF", FOREST), DOCS, 5)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return _checked(top.withColumn("place", place), ["place"], ("importance", 0, 1), ("spread", 0, 1))


@query("upsampling_test", "N-2, P-1, P-2, P-3", f"""
with {CUT}
select sampler, case sampler when 'unbalanced' then n0 + n1 when 'under' then 2 * least(n0, n1)
       else 2 * greatest(n0, n1) end::bigint as train_rows, true as in_range
from sizes, (values ('unbalanced'), ('random'), ('under'), ('SMOTE'), ('generator')) s(sampler)""")
def upsampling_test(spark, sf):
    train, test = _cut(spark, sf)
    samplers = ("unbalanced", "random", "under", "SMOTE", "generator")
    scored = op.upsampling_eval(train, test, DOCS, samplers, "LR", ("auc", "tail_lift", "f1"))
    return _checked(scored, ["sampler", "train_rows"], ("auc", 0, 1), ("tail_lift", 0, 1.12), ("f1", 0, 1))


@query("discriminator_test", "N-3")
def discriminator_test(spark, sf):
    """How well a forest tells drawn rows from real ones: AUC, accuracy and p-value."""
    df = _docs(spark, sf)
    counts = {row["good"]: row["count"] for row in df.groupBy("good").count().collect()}
    plan = sampling_plan(df, "good", counts, mode="new")
    fake = ConditionalGenerator.fit(df, DOCS).sample(plan).withColumn(
        "doc_id", F.concat_ws(":", "good", "draw_id"))
    got = op.discriminator_eval(df, fake, DOCS, "RF", FOREST)
    return spark.createDataFrame([(got["auc"], got["accuracy"], got["p_value"])],
                                 "auc double, accuracy double, p_value double")


@query("equal_tables_test", "N-3", "select 0.5::double as auc, 1::double as p_value from documents limit 1")
def equal_tables_test(spark, sf):
    """A table against itself: no classifier can tell the two apart."""
    df = _docs(spark, sf)
    got = op.discriminator_eval(df, df, DOCS, "RF", FOREST)
    return spark.createDataFrame([(got["auc"], got["p_value"])], "auc double, p_value double")


@query("predictive_test", "N-4",
       "select trained_on, true as in_range from (values ('real'), ('synthetic')) t(trained_on)")
def predictive_test(spark, sf):
    train, test = _cut(spark, sf)
    counts = {row["good"]: row["count"] for row in train.groupBy("good").count().collect()}
    plan = sampling_plan(train, "good", counts, mode="new")
    fake = ConditionalGenerator.fit(train, DOCS).sample(plan).withColumn("doc_id", F.col("draw_id"))
    return _checked(op.predictive_eval(train, fake, test, DOCS, "DT", {"max_depth": 5}),
                    ["trained_on"], ("auc", 0, 1))


@query("repeated_upsampling_test", "N-5",
       "select sampler, true as in_range from (values ('unbalanced'), ('random')) t(sampler)")
def repeated_upsampling_test(spark, sf):
    table = op.repeat_eval(_docs(spark, sf), DOCS, ["unbalanced", "random"], 3)
    return _checked(table, ["sampler"], ("auc", 0.3, 1), ("auc_sd", 0, 0.5))


CV = {"models": {"LR": {"C": [1, 10]}},
      "samplers": {"unbalanced": {}, "random": {}, "SMOTE": {"k_neighbors": [3, 5]}, "ADASYN": {}, "generator": {},
                   "tomek": {}}}


@query("nested_cross_validation", "N-7, D-10, K-11, K-13", f"""
with docs as (select d.doc_id, 1 - l.quality as good from documents d join labels l using (doc_id)),
o as (select doc_id, good, ({shuffled_sql('fold123', 'doc_id', 'good')} - 1) % 5 as outer_fold from docs),
p as (select good, outer_fold, ({shuffled_sql('inner123', 'doc_id', 'good, outer_fold')} - 1) % 5 as inner_fold from o),
k as (select f, count(*) filter (rare > 0 and rare < rows) as scored from (
        select f, inner_fold, count(*) as rows, count(*) filter (good = 0) as rare
        from p, range(5) t(f) where outer_fold <> f group by f, inner_fold) group by f),
n as (select f, count(*) filter (good = 1) as n1, count(*) filter (good = 0) as n0
      from o, range(5) t(f) where outer_fold <> f group by f)
select sampler, 'LR' as model, f::int as fold, (case sampler when 'SMOTE' then 4 else 2 end)::bigint as candidates,
       scored::int as scored_folds, case when sampler = 'unbalanced' then n0 + n1
                               when sampler not in ('ADASYN', 'tomek') then 2 * greatest(n0, n1) end as train_rows
from (values ('unbalanced'), ('random'), ('SMOTE'), ('ADASYN'), ('generator'), ('tomek')) s(sampler), n join k using (f)""")
def nested_cross_validation(spark, sf):
    """Candidates tuned in each outer fold and the rows trained on; ADASYN and Tomek links depend on neighbours."""
    scores, tuning = op.nested_cv(_docs(spark, sf), DOCS, CV, outer=5, inner=5)
    inner = tuning.groupBy("sampler", "model", "fold").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("scored_folds").alias("scored_folds"))
    rows = F.when(~F.col("sampler").isin("ADASYN", "tomek"), F.col("train_rows"))
    return scores.join(inner, ["sampler", "model", "fold"]).select(
        "sampler", "model", "fold", "candidates", "scored_folds", rows.alias("train_rows"))


EXPERIMENT = {"models": {"LR": {"C": [1, 10]}, "RF": {"min_samples_leaf": [20], "n_estimators": [10], "max_depth": [5]}},
              "samplers": {"unbalanced": {}, "SMOTE": {"k_neighbors": [5]}}}


@query("experiment_scores", "N-7")
def experiment_scores(spark, sf):
    """Scores on test and training rows of each outer fold, for regression and forest."""
    scores, _ = op.nested_cv(_docs(spark, sf), DOCS, EXPERIMENT, outer=5, inner=5, train_scores=True)
    return scores


@query("dimension_sweep", "N-8", """
select n::int as n_features, sampler, true as in_range
from (values (5), (20), (64)) a(n), (values ('unbalanced'), ('random')) b(sampler)""")
def dimension_sweep(spark, sf):
    from evenkeel.catalog.registry import vector_spec, vectors

    df = vectors(spark, sf).withColumn("y", F.when(F.col("label") == 5, 1).otherwise(0)).drop("label")
    table = op.dimension_sweep(df, vector_spec(64, "y"), [5, 20, 64], ["unbalanced", "random"])
    return _checked(table, ["n_features", "sampler"], ("auc", 0, 1))


@query("imbalance_sweep", "N-9", "select s::double as share, true as in_range from (values (0.4), (0.2), (0.1)) t(s)")
def imbalance_sweep(spark, sf):
    table = op.imbalance_sweep(_docs(spark, sf), DOCS, [0.4, 0.2, 0.1], folds=2, repeats=2, thin=thin_minority)
    return _checked(table, ["share"], ("auc", 0, 1))


@query("ratio_sweep", "N-10", "select r::double as ratio, true as in_range from (values (0.25), (0.5), (1.0)) t(r)")
def ratio_sweep(spark, sf):
    train, test = _cut(spark, sf)
    return _checked(op.ratio_sweep(train, test, DOCS, [0.25, 0.5, 1.0]), ["ratio"], ("auc", 0.3, 1))


@query("state_update_curve", "N-11", f"""
with {CUT},
seen as (select good, {u_sql('arrival', 'doc_id')} < 0.5 as early from cut where not is_test)
select step::int as step, count(*) filter (good = 1 and (early or step = 1)) as n_minority, true as in_range
from seen, range(2) t(step) group by 1""")
def state_update_curve(spark, sf):
    train, test = _cut(spark, sf)
    spec = FeatureSpec("good", "doc_id", ["n_chars", "n_words"])
    early = uniform("doc_id", "arrival") < 0.5
    curve = op.update_curve([train.filter(early), train.filter(~early)], test, spec)
    return _checked(curve, ["step", "n_minority"], ("auc", 0, 1))


REPORT = FeatureSpec("l_returnflag", "l_orderkey", ["l_quantity", "l_discount"], ["l_linestatus"])


def _report_sql() -> str:
    cols = list(REPORT.continuous)
    real, fake = "l_returnflag = 'R'", "l_returnflag = 'A'"
    pick = lambda c, w: f"case when {w} then {c} end"

    def row(check, col, a, b):
        return (f"select '{check}' as \"check\", '{col}' as col, {r(a, 'real')}, {r(b, 'synthetic')}, "
                f"{r(f'({b}) - ({a})', 'gap')} from lineitem")

    out = [row("mean", c, *(f"avg({pick(c, w)})" for w in (real, fake))) for c in cols]
    out += [row("sd", c, *(f"stddev_pop({pick(c, w)})" for w in (real, fake))) for c in cols]
    out += [row("quantile", f"{c} q{q}", *(f"quantile_cont({pick(c, w)}, {q})" for w in (real, fake)))
            for c in cols for q in (0.25, 0.5, 0.75)]
    out += [row("covariance", f"{a} x {b}",
                *(f"covar_samp({pick(a, w)}, {pick(b, w)})" for w in (real, fake)))
            for i, a in enumerate(cols) for b in cols[i:]]
    out += [row("share", f"l_linestatus={v}", *(
        f"avg(case when l_linestatus = '{v}' then 1e0 else 0e0 end) filter ({w})" for w in (real, fake)))
        for v in ("F", "O")]
    ctes = []
    for c in cols:
        ctes.append(f"""{c}_a as (select {c} as v, count(*) filter ({real}) as a, count(*) filter ({fake}) as b
  from lineitem where {real} or {fake} group by 1),
{c}_d as (select v, sum(a) over w / sum(a) over () - sum(b) over w / sum(b) over () as gap, lead(v) over (order by v) as nxt
  from {c}_a window w as (order by v))""")
        for check, expr in (("ks", "max(abs(gap))"), ("wasserstein", "sum(abs(gap) * (nxt - v))")):
            out.append(f"select '{check}', '{c}', null, null, round({expr}, 6) + 0e0 from {c}_d")
    return "with " + ",\n".join(ctes) + "\n" + "\nunion all\n".join(out).replace(" as real", ' as "real"')


@query("fidelity_report", "N-12, D-4, D-6, D-7, M-6, M-9", _report_sql())
def fidelity_report(spark, sf):
    df = load_table(spark, sf, "lineitem").select(*REPORT.columns)
    return tidy(op.fidelity_report(
        df.filter("l_returnflag = 'R'"), df.filter("l_returnflag = 'A'"), REPORT))
