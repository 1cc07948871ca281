"""Counts, moments, quantiles, histograms and result summaries."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import CUSTOMERS, PART_SPEC, customers, events, parts, query, r, tidy
from evenkeel.operators import levels as lv
from evenkeel.operators import profile as op
from evenkeel.sources.files import load_table

NUMBERS = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf, *extra):
    return load_table(spark, sf, "lineitem").select(*NUMBERS, *extra)


def _each(template: str, columns=NUMBERS) -> str:
    return "\nunion all\n".join(template.replace("{c}", c) for c in columns)


@query("class_profile", "D-1", f"""
with {CUSTOMERS}, n as (select overdrawn, count(*) as n from customers group by 1)
select overdrawn, n, {r('n / sum(n) over ()', 'share')}, {r('n / max(n) over ()', 'ratio')} from n""")
def class_profile(spark, sf):
    return tidy(op.class_profile(customers(spark, sf), "overdrawn"))


@query("level_counts", "D-2", "select source as level, count(*) as n from documents group by 1")
def level_counts(spark, sf):
    return lv.level_counts(load_table(spark, sf, "documents"), "source")


@query("column_profile", "D-3", """
with n as (select 'p_size' as col, 0 as cat, count(distinct p_size) as n_levels from part
union all select 'p_retailprice', 0, count(distinct p_retailprice) from part
union all select 'p_brand', 1, count(distinct p_brand) from part)
select col, case when cat = 1 then 'categorical' else 'continuous' end as role, n_levels,
       case when cat = 0 then 'continuous' when n_levels <= 2 then 'binary' else 'multi-level' end as kind,
       case when cat = 1 then least(15, ceil(n_levels / 2))::int end as width from n""")
def column_profile(spark, sf):
    return op.column_profile(parts(spark, sf), PART_SPEC)


@query("central_moments", "D-4", "with m as (select l_returnflag as f, " + ", ".join(
    f"avg({c}) as m_{c}" for c in NUMBERS) + " from lineitem group by 1)\n" + _each(f"""
select l_returnflag, '{{c}}' as col, {r('avg({c})', 'mean')},
  {r('avg(pow({c} - m_{c}, 2))', 'm2')}, {r('avg(pow({c} - m_{c}, 3))', 'm3', 5)},
  {r('avg(pow({c} - m_{c}, 4))', 'm4', 4)}
from lineitem join m on f = l_returnflag group by 1"""))
def central_moments(spark, sf):
    out = op.moments(_lines(spark, sf, "l_returnflag"), NUMBERS, ["l_returnflag"])
    return out.select("l_returnflag", "col", *[
        (F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("mean", 6), ("m2", 6), ("m3", 5), ("m4", 4))])


@query("set_means", "D-5", _each(f"""
select case when l_returnflag = 'R' then 'returned' else 'kept' end as "set", '{{c}}' as col, {r('avg({c})', 'mean')}
from lineitem group by 1"""))
def set_means(spark, sf):
    df = _lines(spark, sf, "l_returnflag")
    back = F.col("l_returnflag") == "R"
    return tidy(op.compare_means({"returned": df.filter(back), "kept": df.filter(~back)}, NUMBERS))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]


@query("covariance_matrix", "D-6", "\nunion all\n".join(
    f"select l_returnflag, '{a}' as a, '{b}' as b, {r(f'covar_samp({a}, {b})', 'cov')} from lineitem group by 1"
    for a, b in PAIRS))
def covariance_matrix(spark, sf):
    return tidy(op.covariance(_lines(spark, sf, "l_returnflag"), NUMBERS, ["l_returnflag"]))


def _cov_if(a, b, cond):
    return f"covar_samp(case when {cond} then {a} end, case when {cond} then {b} end)"


BACK, KEPT = "l_returnflag = 'R'", "l_returnflag <> 'R'"


@query("covariance_difference", "D-6", "\nunion all\n".join(
    f"select '{a}' as a, '{b}' as b, {r(_cov_if(a, b, BACK) + ' - ' + _cov_if(a, b, KEPT), 'cov_diff')}"
    " from lineitem" for a, b in PAIRS))
def covariance_difference(spark, sf):
    df = _lines(spark, sf, "l_returnflag")
    back = F.col("l_returnflag") == "R"
    return tidy(op.covariance_diff(df.filter(back), df.filter(~back), NUMBERS))


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query("quantile_grid", "D-7", "\nunion all\n".join(
    f"select event_type, 'value' as col, {q}::double as q, {r(f'quantile_cont(value, {q})', 'value')} "
    "from events group by 1" for q in PROBS))
def quantile_grid(spark, sf):
    return tidy(op.quantiles(events(spark, sf), ["value"], PROBS, ["event_type"]))


@query("column_description", "D-8", _each(f"""
select '{{c}}' as col, count({{c}}) as n, {r('avg({c})', 'mean')}, {r('stddev_samp({c})', 'sd')},
  min({{c}}) as min, {r('quantile_cont({c}, 0.25)', 'q25')}, {r('quantile_cont({c}, 0.5)', 'q50')},
  {r('quantile_cont({c}, 0.75)', 'q75')}, max({{c}}) as max from lineitem"""))
def column_description(spark, sf):
    return tidy(op.describe_columns(_lines(spark, sf), NUMBERS))


def _results(spark, sf):
    """Line items read as tuning results: two typed parameters and two scores."""
    return load_table(spark, sf, "lineitem").select(
        "l_linenumber", "l_tax", "l_discount", "l_quantity")


@query("tuning_by_parameter_set", "D-9, F-2", f"""
select l_linenumber, l_tax, {r('avg(l_discount)', 'mean_l_discount')}, {r('avg(l_quantity)', 'mean_l_quantity')}
from lineitem group by 1, 2 order by 1, 2""")
def tuning_by_parameter_set(spark, sf):
    out = op.tuning_summary(_results(spark, sf), ["l_linenumber", "l_tax"], ["l_discount", "l_quantity"])
    return tidy(out).orderBy(F.col("l_linenumber").cast("long"), "l_tax")


@query("tuning_by_single_parameter", "D-9", f"""
select 'l_linenumber' as parameter, l_linenumber::varchar as value, {r('avg(l_discount)', 'mean_l_discount')},
  {r('avg(l_quantity)', 'mean_l_quantity')} from lineitem group by 2
union all
select 'l_tax', l_tax::varchar, round(avg(l_discount), 6) + 0e0, round(avg(l_quantity), 6) + 0e0
from lineitem group by l_tax""")
def tuning_by_single_parameter(spark, sf):
    return tidy(op.tuning_by_parameter(_results(spark, sf), ["l_linenumber", "l_tax"], ["l_discount", "l_quantity"]))


@query("score_spread", "D-10", f"""
select l_returnflag, {r('avg(l_discount)', 'l_discount')}, {r('stddev_pop(l_discount)', 'l_discount_sd')}
from lineitem group by 1""")
def score_spread(spark, sf):
    return tidy(op.score_summary(_lines(spark, sf, "l_returnflag"), ["l_returnflag"], ["l_discount"]))


@query("score_spread_sample_sd", "D-10", f"""
select l_returnflag, {r('avg(l_discount)', 'l_discount')}, {r('stddev_samp(l_discount)', 'l_discount_sd')}
from lineitem group by 1""")
def score_spread_sample_sd(spark, sf):
    return tidy(op.score_summary(
        _lines(spark, sf, "l_returnflag"), ["l_returnflag"], ["l_discount"], sd="samp"))


@query("value_histogram", "D-11", f"""
with s as (select min(value) lo, max(value) hi, (max(value) - min(value)) / 20 w from events),
b as (select event_type, greatest(least(floor((value - lo) / w), 19), 0)::int as bin from events, s),
c as (select event_type, bin, count(*) as n from b group by 1, 2)
select event_type, bin, {r('lo + bin * w', 'bin_start')}, n,
       {r('n / (sum(n) over (partition by event_type) * w)', 'density')} from c, s""")
def value_histogram(spark, sf):
    return tidy(op.histogram(events(spark, sf), "value", 20, ["event_type"]))


@query("pair_histogram", "D-12", f"""
with s as (select min(l_quantity) la, (max(l_quantity) - min(l_quantity)) / 10 wa,
                  min(l_extendedprice) lb, (max(l_extendedprice) - min(l_extendedprice)) / 10 wb from lineitem),
b as (select l_returnflag, greatest(least(floor((l_quantity - la) / wa), 9), 0)::int as bin_a,
             greatest(least(floor((l_extendedprice - lb) / wb), 9), 0)::int as bin_b from lineitem, s),
c as (select l_returnflag, bin_a, bin_b, count(*) as n from b group by 1, 2, 3)
select *, {r('n / sum(n) over (partition by l_returnflag)', 'share')} from c""")
def pair_histogram(spark, sf):
    df = load_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return tidy(op.histogram2d(df, "l_quantity", "l_extendedprice", 10, ["l_returnflag"]))


@query("distinct_levels", "D-13", "select distinct p_brand as level from part")
def distinct_levels(spark, sf):
    return lv.levels(load_table(spark, sf, "part"), "p_brand")
