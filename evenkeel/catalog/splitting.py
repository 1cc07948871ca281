"""Weights, folds, splits and imbalance ladders."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import CUSTOMERS, customers, query, shuffled_sql, u_sql
from evenkeel.operators import splits as op
from evenkeel.plans.grid import candidate_folds, grid_table
from evenkeel.sources.files import load_table


def _cust(spark, sf):
    return customers(spark, sf).select("c_custkey", "overdrawn")


@query("class_weights", "E-1", f"""
with {CUSTOMERS}
select c_custkey, overdrawn, round(1e0 / count(*) over (partition by overdrawn), 9) as weight from customers""")
def class_weights(spark, sf):
    return op.class_weights(_cust(spark, sf), "overdrawn").withColumn("weight", F.round("weight", 9))


@query("stratified_folds", "E-2", f"""
with {CUSTOMERS}
select c_custkey, overdrawn, (({shuffled_sql('fold3', 'c_custkey', 'overdrawn')} - 1) % 5)::int as fold from customers""")
def stratified_folds(spark, sf):
    return op.stratified_folds(_cust(spark, sf), "overdrawn", 5, "c_custkey", seed=3)


@query("repeated_stratified_folds", "E-3", f"""
with {CUSTOMERS}, x as (select c_custkey, overdrawn, d::int as "repeat" from customers, range(3) t(d))
select c_custkey, overdrawn, "repeat",
  (({shuffled_sql('fold3', 'c_custkey', 'overdrawn, "repeat"', ('"repeat"',))} - 1) % 2)::int as fold from x""")
def repeated_stratified_folds(spark, sf):
    return op.repeated_folds(_cust(spark, sf), "overdrawn", 2, "c_custkey", 3, seed=3)


@query("class_row_index", "E-6", f"""
with {CUSTOMERS}
select c_custkey, overdrawn, row_number() over (partition by overdrawn order by c_custkey) as idx from customers""")
def class_row_index(spark, sf):
    return op.class_index(_cust(spark, sf), "overdrawn", "c_custkey")


def _split_sql(share: float) -> str:
    return f"""
with {CUSTOMERS}
select c_custkey, overdrawn, {shuffled_sql('split5', 'c_custkey', 'overdrawn')}
  <= round(count(*) over (partition by overdrawn) * {share}e0) as is_test from customers"""


@query("stratified_split_quarter", "J-1", _split_sql(0.25))
def stratified_split_quarter(spark, sf):
    return op.stratified_split(_cust(spark, sf), "overdrawn", 0.25, "c_custkey", seed=5)


@query("stratified_split_half", "J-1", _split_sql(0.5))
def stratified_split_half(spark, sf):
    return op.stratified_split(_cust(spark, sf), "overdrawn", 0.5, "c_custkey", seed=5)


@query("random_split", "J-2", f"""
select event_id, {u_sql('split5', 'event_id')} < 0.33e0 as is_test from events""")
def random_split(spark, sf):
    return op.random_split(load_table(spark, sf, "events").select("event_id"), 0.33, "event_id", seed=5)


@query("nested_folds", "J-3", f"""
with {CUSTOMERS}, o as (select c_custkey, overdrawn,
  (({shuffled_sql('fold9', 'c_custkey', 'overdrawn')} - 1) % 5)::int as outer_fold from customers)
select *, (({shuffled_sql('inner9', 'c_custkey', 'overdrawn, outer_fold')} - 1) % 5)::int as inner_fold from o""")
def nested_folds(spark, sf):
    return op.nested_folds(_cust(spark, sf), "overdrawn", 5, 5, "c_custkey", seed=9)


ORDERS = """o as (select o_orderkey, case when o_orderpriority = '1-URGENT' then 1 else 0 end as urgent from orders),
n as (select count(*) filter (urgent = 1) as p, count(*) filter (urgent = 0) as q from o),
s as (select o.*, n.*, {rank} as pos from o, n)""".replace(
    "{rank}", shuffled_sql("thin2", "o_orderkey", "urgent"))


def _orders(spark, sf):
    return load_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"))


@query("thinned_minority", "J-4", f"""
with {ORDERS}, t as (select *, trunc(least(p / 0.05e0, q / (1e0 - 0.05e0)))::bigint as total from s)
select o_orderkey, urgent from t
where pos <= case when urgent = 1 then round_even(total * 0.05e0, 0) else total - round_even(total * 0.05e0, 0) end""")
def thinned_minority(spark, sf):
    return op.thin_minority(_orders(spark, sf), "urgent", 0.05, "o_orderkey", seed=2)


@query("thinned_majority", "J-5", f"""
with {ORDERS}
select o_orderkey, urgent from s where urgent = 1 or pos <= round_even(p * (1e0 - 0.4e0) / 0.4e0, 0)""")
def thinned_majority(spark, sf):
    return op.thin_majority(_orders(spark, sf), "urgent", 0.4, "o_orderkey", seed=2)


@query("label_sorted_prefix", "J-6", f"""
with {ORDERS}, t as (select *, p + trunc(p / 0.25e0)::bigint as size from s)
select o_orderkey, urgent from t
where pos <= case when urgent = 0 then least(size, q) else greatest(size - q, 0) end""")
def label_sorted_prefix(spark, sf):
    return op.prefix_ratio(_orders(spark, sf), "urgent", 0.25, "o_orderkey", seed=2)


@query("parameter_grid", "N-6", """
with a as (select lang, list(distinct source) as sources, list(distinct n_chars % 5) as steps from documents group by 1),
b as (select lang, unnest(sources) as sources, steps from a)
select lang, sources, unnest(steps) as steps from b""")
def parameter_grid(spark, sf):
    values = load_table(spark, sf, "documents").groupBy("lang").agg(
        F.collect_set("source").alias("sources"), F.collect_set(F.col("n_chars") % 5).alias("steps"))
    return grid_table(values, ["sources", "steps"], keep=["lang"])


@query("candidate_folds", "C-8", f"""
with {CUSTOMERS}, f as (select distinct (({shuffled_sql('fold3', 'c_custkey', 'overdrawn')} - 1) % 5)::int as fold
  from customers), g as (select distinct c_mktsegment, c_nationkey from customer)
select c_mktsegment, c_nationkey, fold from g, f""")
def candidate_folds_query(spark, sf):
    folded = op.stratified_folds(_cust(spark, sf), "overdrawn", 5, "c_custkey", seed=3)
    folds = [row["fold"] for row in folded.select("fold").distinct().collect()]
    grid = customers(spark, sf).select("c_mktsegment", "c_nationkey").distinct()
    return candidate_folds(grid, folds)
