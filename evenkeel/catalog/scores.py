"""Ranks, AUC, lifts and two-sample distances on existing numbers."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import EVENTS, events, query, r, tidy, tie_rank_sql
from evenkeel.operators import metrics as op
from evenkeel.sources.files import load_table


def _lines(spark, sf):
    return load_table(spark, sf, "lineitem").select(
        "l_quantity", "l_linestatus", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


CUM = """c as (select value, sum(is_error)::bigint as pos, sum(1 - is_error)::bigint as neg from ev group by 1)"""


@query("cumulative_class_counts", "E-4", f"""
with {EVENTS}, {CUM}
select value, pos, neg, (sum(pos) over w - pos)::bigint as pos_below, (sum(neg) over w - neg)::bigint as neg_below
from c window w as (order by value)""")
def cumulative_class_counts(spark, sf):
    return op.cumulative_by_score(events(spark, sf), "is_error", "value").select(
        "value", "pos", "neg", "pos_below", "neg_below")


@query("best_and_worst_rows", "E-5", f"""
with {EVENTS}
(select 'best' as side, event_id, value from ev order by value desc, event_id limit 25)
union all
(select 'worst' as side, event_id, value from ev order by value asc, event_id limit 25)""")
def best_and_worst_rows(spark, sf):
    df = events(spark, sf).select("event_id", "value")
    return op.rank_by_score(df, "value", "event_id", 25).select(F.lit("best").alias("side"), "*").unionByName(
        op.rank_by_score(df, "value", "event_id", 25, best=False).select(F.lit("worst").alias("side"), "*"))


@query("roc_auc", "M-1", f"""
with {EVENTS}, {CUM}, b as (select *, sum(neg) over (order by value) - neg as nb from c)
select {r('sum(pos * (nb + 0.5e0 * neg)) / (sum(pos) * 1e0 * sum(neg))', 'auc', 9)} from b""")
def roc_auc(spark, sf):
    return tidy(op.auc(events(spark, sf), "is_error", "value"), 9)


@query("roc_auc_by_group_with_ties", "M-1", f"""
with c as (select l_linestatus, l_quantity, sum(case when l_returnflag = 'R' then 1 else 0 end) as pos,
           sum(case when l_returnflag = 'R' then 0 else 1 end) as neg from lineitem group by 1, 2),
b as (select *, sum(neg) over (partition by l_linestatus order by l_quantity) - neg as nb from c)
select l_linestatus, {r('sum(pos * (nb + 0.5e0 * neg)) / (sum(pos) * 1e0 * sum(neg))', 'auc', 9)} from b group by 1""")
def roc_auc_by_group_with_ties(spark, sf):
    return tidy(op.auc(_lines(spark, sf), "y", "l_quantity", ["l_linestatus"]), 9)


def _lift_sql(name: str, cond: str) -> str:
    return f"""
with {EVENTS}, k as (select *, {tie_rank_sql('value', 'event_id')} as pos, count(*) over () as n from ev)
select {r(f'avg(case when {cond} then is_error end) / avg(is_error)', name, 9)} from k"""


@query("top_lift", "M-2, F-1", _lift_sql("top_lift", "pos > n - floor(n * 0.1e0)"))
def top_lift(spark, sf):
    return tidy(op.top_lift(events(spark, sf), "is_error", "value", "event_id", 0.1), 9)


@query("tail_lift", "M-3", _lift_sql("tail_lift", "pos > floor(n * 0.1e0)"))
def tail_lift(spark, sf):
    return tidy(op.tail_lift(events(spark, sf), "is_error", "value", "event_id", 0.1), 9)


@query("top_lift_hot_ties", "M-2", f"""
with o as (select o_orderkey, o_orderstatus, case when o_orderpriority = '1-URGENT' then 1 else 0 end as y,
           case when o_totalprice < 200000 then 0e0 else 1e0 end as score from orders),
k as (select *, {tie_rank_sql('score', 'o_orderkey', 'o_orderstatus')} as pos,
      count(*) over (partition by o_orderstatus) as n from o)
select o_orderstatus, {r('avg(case when pos > n - floor(n * 0.1e0) then y end) / avg(y)', 'top_lift', 9)} from k group by 1""")
def top_lift_hot_ties(spark, sf):
    df = load_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("y"),
        F.when(F.col("o_totalprice") < 200000, 0.0).otherwise(1.0).alias("score"))
    return tidy(op.top_lift(df, "y", "score", "o_orderkey", 0.1, ["o_orderstatus"]), 9)


@query("accuracy", "M-4", f"""
with {EVENTS} select {r('avg(case when (value > 40e0) = (is_error = 1) then 1e0 else 0e0 end)', 'accuracy', 9)} from ev""")
def accuracy(spark, sf):
    return tidy(op.accuracy(events(spark, sf), "is_error", "value", 40.0), 9)


@query("f1", "M-5", f"""
with {EVENTS}, t as (select avg(is_error) * 200e0 as t from ev),
c as (select sum(case when value > t and is_error = 1 then 1 else 0 end) as hit,
             sum(case when (value > t) <> (is_error = 1) then 1 else 0 end) as wrong from ev, t)
select {r('2e0 * hit / (2e0 * hit + wrong)', 'f1', 9)} from c""")
def f1(spark, sf):
    df = events(spark, sf)
    share = df.agg(F.avg("is_error")).first()[0]
    return tidy(op.f1(df, "is_error", "value", share * 200.0), 9)


TWO = """a as (select value, count(*) filter (event_type = 'click') as a, count(*) filter (event_type = 'error') as b
  from events where event_type in ('click', 'error') group by 1),
d as (select value, sum(a) over w / sum(a) over () - sum(b) over w / sum(b) over () as gap,
             lead(value) over (order by value) as nxt, sum(a) over () as n_a, sum(b) over () as n_b
      from a window w as (order by value))"""


@query("ks_two_sample", "M-6", f"""
with {TWO}, k as (select max(abs(gap)) as ks, max(n_a)::bigint as n_a, max(n_b)::bigint as n_b from d),
l as (select *, sqrt(n_a * n_b / (n_a + n_b)) * ks as lam from k)
select {r('ks', 'ks', 9)}, n_a, n_b, {r('''case when lam < 0.04e0 then 1e0 else greatest(least((
  select sum((case when j % 2 = 1 then 2e0 else -2e0 end) * exp(-2e0 * j * j * lam * lam))
  from range(1, 101) t(j)), 1e0), 0e0) end''', 'p_value', 9)} from l""")
def ks_two_sample(spark, sf):
    return tidy(op.ks_two_sample(events(spark, sf), "value", "event_type", "click", "error"), 9)


@query("wasserstein_distance", "M-9", f"""
with {TWO} select {r('sum(abs(gap) * (nxt - value))', 'wasserstein')} from d""")
def wasserstein_distance(spark, sf):
    return tidy(op.wasserstein_1d(events(spark, sf), "value", "event_type", "click", "error"))


@query("score_gap", "M-7", f"""
with {EVENTS} select {r('avg(value) filter (is_error = 0) - avg(value) filter (is_error = 1)', 'score_gap')} from ev""")
def score_gap(spark, sf):
    return tidy(op.score_gap(events(spark, sf), "value", "is_error"))


@query("fisher_gap", "M-8", f"""
with {EVENTS} select {r('avg(value) filter (is_error = 0) - avg(value) filter (is_error = 1)', 'score_gap')},
  {r('0.5e0 * avg(value * value) filter (is_error = 0) + 0.5e0 * avg(value * value) filter (is_error = 1)', 'constraint')}
from ev""".replace(" as constraint", ' as "constraint"'))
def fisher_gap(spark, sf):
    return tidy(op.fisher_gap(events(spark, sf), "value", "is_error"))
