"""Logistic regressions by value: the SQL runs Newton's method step by step on the same resampled rows."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, shuffled_sql, tidy, u_sql
from evenkeel.operators import metrics
from evenkeel.operators.splits import stratified_split
from evenkeel.plans import evaluate as op
from evenkeel.plans.stacked import StackedLogistic
from evenkeel.session import reuse
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec

TWO = FeatureSpec("good", "doc_id", ["n_chars", "n_words"])
WORD = r"[^\x20\x09-\x0D]+"


def _counts(spark, sf):
    """Labelled documents with two numbers each; poor quality is the rare class."""
    docs = load_table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("double").alias("n_words"))
    labels = load_table(spark, sf, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("good"))
    return docs.join(labels, "doc_id").select(*TWO.columns)


def _cut(spark, sf):
    both = reuse(stratified_split(_counts(spark, sf), "good", 0.33, "doc_id", seed=1))
    return both.filter(~F.col("is_test")).drop("is_test"), both.filter("is_test").drop("is_test")


DOCS = f"""docs as (
  select d.doc_id, 1 - l.quality as good, d.n_chars::double as a,
         coalesce(len(regexp_extract_all(d.text, '{WORD}')), 0)::double as b
  from documents d join labels l using (doc_id))"""

#: One training set (s = 0) and its test rows.
ONE_CUT = f"""{DOCS},
cut as (select *, {shuffled_sql('split1', 'doc_id', 'good')}
        <= round(count(*) over (partition by good) * 0.33) as is_test from docs),
tr as (select 0 as s, doc_id, good, a, b from cut where not is_test),
te as (select 0 as s, doc_id, good, a, b from cut where is_test)"""


def _resampled(seed: str, samplers: tuple, targets: str = "max(count(*)) over (partition by s)",
               number: str = "s") -> str:
    """From training sets ``tr`` to the rows that are fitted, by sampler: ``fit_rows``.

    ``number`` is the set number that draws depend on.
    """
    at = f"row_number() over (partition by s, cls order by {u_sql(f'idx{seed}', 'id')}, id)"
    parts = {
        "unbalanced": "select 'unbalanced' as sampler, s, y, x1, x2 from trs",
        "random": "select 'random' as sampler, s, y, x1, x2 from trs\n  union all "
                  "select 'random', s, y, x1, x2 from draws join shuffled using (s, cls, idx)",
        "under": "select 'under' as sampler, s, y, x1, x2 from spare where idx <= least"}
    return f"""rng as (select s, min(a) as a0, max(a) as a1, min(b) as b0, max(b) as b1 from tr group by s),
trs as (select s, {number} || ':' || doc_id as id, {number} || '|' || good as cls, good as y,
               (a - a0) / (a1 - a0) as x1, (b - b0) / (b1 - b0) as x2 from tr join rng using (s)),
cnt as (select s, cls, count(*) as n, {targets} - count(*) as n_new, min(count(*)) over (partition by s) as least
        from trs group by s, cls),
shuffled as (select *, {at} as idx from trs),
draws as (select s, cls, floor({u_sql(f'base{seed}', 'cls', 'd')} * n)::bigint + 1 as idx
          from (select s, cls, n, unnest(range(n_new::bigint)) as d from cnt)),
spare as (select trs.*, row_number() over (partition by trs.s, trs.cls order by {u_sql(f'under{seed}', 'id')}, id) as idx,
                 least from trs join cnt using (s, cls)),
fit_rows as materialized (
  {(chr(10) + "  union all ").join(parts[p] for p in samplers)}),
sizes as (select sampler, s, count(*) as train_rows, avg(y) as share from fit_rows group by all)"""


def _newton(candidates: str, steps: int = 12) -> str:
    """Coefficients ``fitted`` of every (sampler, s, candidate), one step a table."""
    out = [f"""t0 as materialized (select distinct sampler, s, candidate, c, 0e0 as b0, 0e0 as b1, 0e0 as b2
  from fit_rows, (values {candidates}) v(candidate, c))"""]
    for i in range(steps):
        out.append(f"""g{i} as materialized (
  select sampler, s, candidate, c, b0, b1, b2, sum(p - y) as g0, sum((p - y) * x1) + b1 / c as g1,
         sum((p - y) * x2) + b2 / c as g2, sum(w) as h00, sum(w * x1) as h01, sum(w * x2) as h02,
         sum(w * x1 * x1) + 1 / c as h11, sum(w * x1 * x2) as h12, sum(w * x2 * x2) + 1 / c as h22
  from (select *, p * (1 - p) as w from (
    select *, 1 / (1 + exp(-(b0 + x1 * b1 + x2 * b2))) as p from fit_rows join t{i} using (sampler, s)))
  group by sampler, s, candidate, c, b0, b1, b2)""")
        out.append(f"""t{i + 1} as materialized (
  select sampler, s, candidate, c,
         b0 - (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det as b0,
         b1 - (g0 * (h02 * h12 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det as b1,
         b2 - (g0 * (h01 * h12 - h02 * h11) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det as b2
  from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det
        from g{i}))""")
    return ",\n".join(out) + f",\nfitted as (select * from t{steps})"


#: Scored test rows, then the scores of every fit.
SCORED = f"""sc as materialized (
  select sampler, s, candidate, doc_id, good, 1 / (1 + exp(-(t.b0 + x1 * t.b1 + x2 * t.b2))) as score
  from (select te.*, (a - a0) / (a1 - a0) as x1, (b - b0) / (b1 - b0) as x2 from te join rng using (s))
  join fitted t using (s)),
ranked as (
  select *, rank() over (partition by sampler, s, candidate order by score)
            + (count(*) over (partition by sampler, s, candidate, score) - 1) / 2e0 as avg_rank,
         row_number() over (partition by sampler, s, candidate order by score, {u_sql('tie', 'doc_id')}, doc_id) as pos,
         count(*) over (partition by sampler, s, candidate) as n
  from sc),
scores as materialized (
  select sampler, s, candidate, any_value(train_rows) as train_rows,
         (sum(avg_rank) filter (good = 1) - sum(good) * (sum(good) + 1) / 2e0) / (sum(good) * sum(1 - good)) as auc,
         avg(good) filter (pos > floor(n * 0.1e0)) / avg(good) as tail_lift,
         2e0 * count(*) filter (score > share and good = 1)
           / (2 * count(*) filter (score > share and good = 1) + count(*) filter ((score > share) <> (good = 1))) as f1
  from ranked join sizes using (sampler, s) group by sampler, s, candidate)"""


@query("logistic_scores", "N-1", f"""
with {ONE_CUT}, {_resampled('0', ('unbalanced',))},
{_newton('(0, 10e0)')}, {SCORED}
select doc_id, good, {r('score', 'score')} from sc""")
def logistic_scores(spark, sf):
    """The probability that the regression gives each held-out row."""
    train, test = _cut(spark, sf)
    every = {0: F.lit(True)}
    models = StackedLogistic(train, TWO, every)
    models.add([models.resampled("unbalanced", {})]).fit([10.0])
    return tidy(models.score(test, every).select("doc_id", "good", "score"))


@query("upsampling_scores", "N-2, P-1, P-2, P-3", f"""
with {ONE_CUT}, {_resampled('0', ('unbalanced', 'random', 'under'))},
{_newton('(0, 1e0)')}, {SCORED}
select sampler, train_rows, {r('auc', 'auc')}, {r('tail_lift', 'tail_lift')}, {r('f1', 'f1')} from scores""")
def upsampling_scores(spark, sf):
    train, test = _cut(spark, sf)
    return tidy(op.upsampling_eval(train, test, TWO, ("unbalanced", "random", "under"), "LR",
                                   ("auc", "tail_lift", "f1")))


def _ratio_sql(ratios: tuple) -> str:
    """Each ratio is a set of its own with the same class names, so that its draws are those of one set."""
    parts = []
    for i, ratio in enumerate(ratios):
        target = (f"(case when count(*) = max(count(*)) over (partition by s) then count(*) else "
                  f"trunc(max(count(*)) over (partition by s) * {ratio}e0) end)")
        parts.append(f"""select {ratio}::double as ratio, {r('auc', 'auc')} from (
  with {_resampled('0', ('random',), target)}, {_newton('(0, 1e0)')}, {SCORED} select auc from scores)""")
    return f"with {ONE_CUT}\n" + "\nunion all\n".join(parts)


@query("ratio_scores", "N-10", _ratio_sql((0.5, 0.75, 1.0)))
def ratio_scores(spark, sf):
    train, test = _cut(spark, sf)
    return tidy(op.ratio_sweep(train, test, TWO, [0.5, 0.75, 1.0]))


REPEATS = f"""{DOCS},
cut as (select rep as s, *, {shuffled_sql("split' || rep || '", 'doc_id', 'rep, good')}
        <= round(count(*) over (partition by rep, good) * 0.33) as is_test from docs, range(3) t(rep)),
tr as (select s, doc_id, good, a, b from cut where not is_test),
te as (select s, doc_id, good, a, b from cut where is_test)"""


@query("repeated_upsampling_scores", "N-5", f"""
with {REPEATS},
{_resampled("' || s || '", ('unbalanced', 'random'), number='0')},
{_newton('(0, 1e0)')}, {SCORED}
select sampler, {r('avg(auc)', 'auc')}, {r('stddev_samp(auc)', 'auc_sd')} from scores group by sampler""")
def repeated_upsampling_scores(spark, sf):
    table = op.repeat_eval(_counts(spark, sf), TWO, ["unbalanced", "random"], 3)
    return tidy(table.select("sampler", "auc", "auc_sd"))


FOLDS, SEED = 5, 123
NESTED = f"""{DOCS},
o as (select *, ({shuffled_sql(f'fold{SEED}', 'doc_id', 'good')} - 1) % {FOLDS} as outer_fold from docs),
parts as (select *, ({shuffled_sql(f'inner{SEED}', 'doc_id', 'good, outer_fold')} - 1) % {FOLDS} as inner_fold from o),
sets as (select f * {FOLDS + 1} + i as s, f, i from range({FOLDS}) x(f), range({FOLDS + 1}) y(i)),
tr as (select s, doc_id, good, a, b from parts join sets
       on outer_fold <> f and (i = {FOLDS} or inner_fold <> i)),
te as (select s, doc_id, good, a, b from parts join sets
       on case when i = {FOLDS} then outer_fold = f else outer_fold <> f and inner_fold = i end),
{_resampled(str(SEED), ('unbalanced', 'random'))},
{_newton('(0, 1e-1), (1, 1e0), (2, 1e1)')}, {SCORED},
tuned as (select sampler, f, candidate, avg(auc) as mean_auc, stddev_samp(auc) as auc_sd
          from scores join sets using (s) where i < {FOLDS} group by all),
best as (select *, row_number() over (partition by sampler, f order by round(mean_auc, 10) desc, candidate) as place
         from tuned),
outer_scores as (
  select b.sampler, b.f, b.candidate, train_rows, auc, tail_lift, mean_auc, b.auc_sd
  from best b join sets on sets.f = b.f and i = {FOLDS}
  join scores using (s) where place = 1 and scores.sampler = b.sampler and scores.candidate = b.candidate)"""

PENALTIES = {"models": {"LR": {"C": [0.1, 1, 10]}}, "samplers": {"unbalanced": {}, "random": {}}}


@query("nested_scores", "N-7", f"""
with {NESTED}
select sampler, f::int as fold, candidate, train_rows, {r('auc', 'auc')}, {r('tail_lift', 'tail_lift')},
       {r('mean_auc', 'mean_auc')}, {r('auc_sd', 'auc_sd')} from outer_scores""")
def nested_scores(spark, sf):
    """The outer scores of the chosen candidate, with the mean and spread that chose it."""
    scores, tuning = op.nested_cv(_counts(spark, sf), TWO, PENALTIES, FOLDS, FOLDS, seed=SEED)
    why = tuning.select("sampler", "fold", "candidate", F.col("auc").alias("mean_auc"), "auc_sd")
    return tidy(scores.join(why, ["sampler", "fold", "candidate"]).drop("model"))


@query("nested_score_summary", "N-7, D-10", f"""
with {NESTED}
select sampler, {r('avg(auc)', 'auc')}, {r('stddev_pop(auc)', 'auc_sd')},
       {r('avg(tail_lift)', 'tail_lift')}, {r('stddev_pop(tail_lift)', 'tail_lift_sd')}
from outer_scores group by sampler""")
def nested_score_summary(spark, sf):
    from evenkeel.operators.profile import score_summary

    scores, _ = op.nested_cv(_counts(spark, sf), TWO, PENALTIES, FOLDS, FOLDS, seed=SEED)
    return tidy(score_summary(scores, ["sampler"], ["auc", "tail_lift"], "pop").select(
        "sampler", "auc", "auc_sd", "tail_lift", "tail_lift_sd"))


@query("rank_test", "N-3, M-1", f"""
with e as (select event_type as kind, case when user_id % 2 = 0 then 1 else 0 end as y, round(value, 0) as v from events),
c as (select kind, v, sum(y) as pos, sum(1 - y) as neg,
             coalesce(sum(sum(1 - y)) over (partition by kind order by v rows between unbounded preceding
                      and 1 preceding), 0) as below from e group by kind, v),
t as (select kind, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg, sum(pos * (below + neg / 2e0)) as won,
             sum((pos + neg)::double ** 3 - (pos + neg)) as tied from c group by kind),
x as (select *, n_pos * n_neg / 12e0 * (n_pos + n_neg + 1 - tied / ((n_pos + n_neg) * (n_pos + n_neg - 1e0))) as variance from t)
select kind, n_pos, n_neg, won, {r('variance', 'variance')},
       {r('(won - n_pos * n_neg / 2e0) / sqrt(variance)', 'z')} from x""")
def rank_test(spark, sf):
    """How far the scores of two kinds of rows are from being exchangeable, by event type."""
    df = load_table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(0).alias("y"),
        F.round("value", 0).alias("v"))
    return tidy(metrics.rank_test(df, "y", "v", ["kind"]))
