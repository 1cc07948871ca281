"""Class plans, random and weighted resampling, unions of real and new rows."""


from evenkeel.catalog.registry import CUSTOMERS, customers, query, r, shuffled_sql, tidy, tie_rank_sql, u_sql
from evenkeel.operators import resample as op
from evenkeel.operators.profile import class_profile
from evenkeel.plans import sampling as plans


def _cust(spark, sf):
    return customers(spark, sf).select("c_custkey", "c_acctbal", "overdrawn")


COUNTS = "n as (select overdrawn, count(*) as n from customers group by 1)"


def _plan_sql(target: str) -> str:
    return f"""
with {CUSTOMERS}, {COUNTS}, m as (select min(n) as small, max(n) as large from n),
t as (select overdrawn, n as n_current, {target}::bigint as n_target from n, m)
select overdrawn, n_current, n_target, n_target - n_current as n_new from t"""


@query("plan_to_largest_class", "K-1", _plan_sql("large"))
def plan_to_largest_class(spark, sf):
    return plans.sampling_plan(_cust(spark, sf), "overdrawn", "auto")


@query("plan_by_ratio", "K-1", _plan_sql("case when n = small then trunc(large * 0.5e0) else n end"))
def plan_by_ratio(spark, sf):
    return plans.sampling_plan(_cust(spark, sf), "overdrawn", 0.5)


@query("plan_target_totals", "K-1", _plan_sql("case when overdrawn = 1 then small + 77 else n end"))
def plan_target_totals(spark, sf):
    df = _cust(spark, sf)
    n = plans.class_counts(df, "overdrawn")[1]
    return plans.sampling_plan(df, "overdrawn", {1: n + 77})


@query("plan_new_rows", "K-2", _plan_sql("case when overdrawn = 1 then n + 300 else n end"))
def plan_new_rows(spark, sf):
    return plans.sampling_plan(_cust(spark, sf), "overdrawn", {1: 300, 0: 0}, mode="new")


@query("plan_multiple_of_minority", "K-3", _plan_sql("case when n = small then n + trunc(n * 4) else n end"))
def plan_multiple_of_minority(spark, sf):
    return plans.plan_multiple(_cust(spark, sf), "overdrawn", 4)


@query("plan_share_of_majority", "K-3", _plan_sql("case when n = small then n + trunc(large * 0.1e0) else n end"))
def plan_share_of_majority(spark, sf):
    return plans.plan_share(_cust(spark, sf), "overdrawn", 0.1)


COPIES = f"""{COUNTS}, p as (select overdrawn, n, max(n) over () - n as n_new from n),
idx as (select *, {shuffled_sql('idx0', 'c_custkey', 'overdrawn')} as idx from customers),
draws as (select overdrawn, d as draw_id, floor({u_sql('base0', 'overdrawn', 'd')} * n)::bigint + 1 as idx
          from (select overdrawn, n, unnest(range(n_new::bigint)) as d from p)),
copies as (select c_custkey, c_acctbal, overdrawn from draws join idx using (overdrawn, idx))"""


@query("random_oversampling", "K-4, G-1", f"""
with {CUSTOMERS}, {COPIES}
select c_custkey, c_acctbal, overdrawn, false as is_synthetic from customers
union all select c_custkey, c_acctbal, overdrawn, true from copies""")
def random_oversampling(spark, sf):
    df = _cust(spark, sf)
    return op.oversample_random(df, "overdrawn", "c_custkey", plans.sampling_plan(df, "overdrawn"))


@query("balanced_class_profile", "D-1, K-1, K-4, G-1, D-1", f"""
with {CUSTOMERS}, {COPIES}, z as (select overdrawn from customers union all select overdrawn from copies),
c as (select overdrawn, count(*) as n from z group by 1)
select overdrawn, n, {r('n / sum(n) over ()', 'share')}, {r('n / max(n) over ()', 'ratio')} from c""")
def balanced_class_profile(spark, sf):
    return tidy(class_profile(random_oversampling(spark, sf), "overdrawn"))


@query("random_undersampling", "K-5", f"""
with {CUSTOMERS}, x as (select c_custkey, c_acctbal, overdrawn,
  {shuffled_sql('under0', 'c_custkey', 'overdrawn')} as pos from customers), {COUNTS}
select c_custkey, c_acctbal, overdrawn from x where pos <= (select min(n) from n)""")
def random_undersampling(spark, sf):
    df = _cust(spark, sf)
    plan = plans.undersampling_plan(df, "overdrawn")
    return op.undersample_random(df, "overdrawn", "c_custkey", plan)


@query("weighted_sample", "K-6", f"""
with {CUSTOMERS}, w as (select c_custkey, c_acctbal, overdrawn,
  -ln(1e0 - {u_sql('weight0', 'c_custkey')}) * count(*) over (partition by overdrawn) as arrival from customers),
k as (select *, {tie_rank_sql('arrival', 'c_custkey')} as pos from w)
select c_custkey, c_acctbal, overdrawn from k where pos <= 200""")
def weighted_sample(spark, sf):
    return op.balanced_sample(_cust(spark, sf), "overdrawn", "c_custkey", 200)


@query("weighted_sample_with_replacement", "K-7", f"""
with {CUSTOMERS}, {COUNTS}, idx as (select *, {shuffled_sql('idx0', 'c_custkey', 'overdrawn')} as idx from customers),
d as (select d::bigint as draw_id, floor({u_sql('class0', 'd')} * 2)::int as overdrawn from range(2000) t(d)),
p as (select draw_id, overdrawn, floor({u_sql('base0', 'overdrawn', 'draw_id')} * n)::bigint + 1 as idx from d join n using (overdrawn))
select draw_id, c_custkey, c_acctbal, overdrawn from p join idx using (overdrawn, idx)""")
def weighted_sample_with_replacement(spark, sf):
    return op.balanced_sample(_cust(spark, sf), "overdrawn", "c_custkey", 2000, replace=True)


@query("unchanged_rows", "K-14", f"""
with {CUSTOMERS} select c_custkey, c_acctbal, overdrawn, false as is_synthetic from customers""")
def unchanged_rows(spark, sf):
    return op.identity(_cust(spark, sf))


def _real_and_copies(spark, sf):
    df = _cust(spark, sf)
    new = op.oversample_random(df, "overdrawn", "c_custkey", plans.sampling_plan(df, "overdrawn"), only_new=True)
    return df, new.drop("is_synthetic")


@query("stacked_with_origin", "G-2", f"""
with {CUSTOMERS}, {COPIES}
select c_custkey, c_acctbal, overdrawn, 0 as origin from customers
union all select c_custkey, c_acctbal, overdrawn, 1 from copies""")
def stacked_with_origin(spark, sf):
    return op.label_origin(*_real_and_copies(spark, sf))


@query("swapped_minority", "G-4", f"""
with {CUSTOMERS}, {COPIES}
select c_custkey, c_acctbal, overdrawn from customers where overdrawn <> 1
union all select c_custkey, c_acctbal, overdrawn from copies where overdrawn = 1""")
def swapped_minority(spark, sf):
    return op.swap_class(*_real_and_copies(spark, sf), "overdrawn", 1)
