"""Projections, filters, joins on labels and levels."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import (
    CUSTOMERS,
    customers,
    events,
    parts,
    query,
    r,
    shuffled_sql,
    tidy,
    tie_rank_sql,
    u_sql,
    vector_spec,
    vectors,
)
from evenkeel.functions.draws import uniform
from evenkeel.operators import columns as op
from evenkeel.operators import levels as lv
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec

CUSTOMER_SPEC = FeatureSpec("overdrawn", "c_custkey", ["c_nationkey"], ["c_mktsegment"])


@query("ordered_features", "B-1", f"""
with {CUSTOMERS} select c_custkey, c_nationkey, c_mktsegment, overdrawn from customers""")
def ordered_features(spark, sf):
    return op.order_features(customers(spark, sf), CUSTOMER_SPEC)


@query("label_split", "B-2", f"""
with {CUSTOMERS} select c_custkey, c_nationkey, c_mktsegment, overdrawn from customers""")
def label_split(spark, sf):
    features, labels = op.split_label(customers(spark, sf), CUSTOMER_SPEC, drop=["c_acctbal"])
    return features.join(labels, "c_custkey")


@query("typed_features", "B-3", f"""
with {CUSTOMERS} select c_custkey, c_nationkey::double as c_nationkey, c_mktsegment, overdrawn
from customers""")
def typed_features(spark, sf):
    return op.cast_features(op.order_features(customers(spark, sf), CUSTOMER_SPEC), CUSTOMER_SPEC)


@query("first_features", "B-4", """
select vec_id, label, embedding[1]::double as x0, embedding[2]::double as x1, embedding[3]::double as x2
from embeddings""")
def first_features(spark, sf):
    taken, _ = op.take_features(vectors(spark, sf), vector_spec(), 3)
    return taken.select("vec_id", "label", "x0", "x1", "x2")


@query("varying_columns", "B-5", "select o_orderkey, o_totalprice from orders")
def varying_columns(spark, sf):
    df = load_table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", (F.length("o_orderstatus") - 1).alias("spent"),
        F.length("o_orderstatus").alias("ones"))
    zero_gone = op.drop_constant(df, ["o_totalprice", "spent", "ones"], value=0)
    return op.drop_constant(zero_gone, ["o_totalprice", "ones"])


@query("filled_levels", "B-6", """
select d.doc_id, coalesce(l.quality::varchar, 'NO_LABEL') as quality, coalesce(l.toxic::varchar, 'MISSING') as toxic
from documents d left join labels l on d.doc_id = l.doc_id""")
def filled_levels(spark, sf):
    labels = load_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    joined = load_table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return op.fill_level(joined, {"quality": "NO_LABEL", "toxic": "MISSING"})


@query("recoded_label", "B-7", """
select doc_id, case when quality = 1 then 1 else 0 end as y from labels""")
def recoded_label(spark, sf):
    signed = load_table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 - 1).alias("y"))
    return op.recode(signed, "y", {-1: 0})


@query("class_filter", "B-8", """
select event_id, event_type, value from events where event_type in ('error', 'purchase')""")
def class_filter(spark, sf):
    return op.filter_classes(events(spark, sf), "event_type", ["error", "purchase"]).select(
        "event_id", "event_type", "value")


@query("minority_majority_split", "B-9", f"""
with {CUSTOMERS}
select 'minority' as part, count(*) as n, {r('avg(c_acctbal)', 'mean_balance')} from customers where overdrawn = 1
union all
select 'majority', count(*), round(avg(c_acctbal), 6) + 0e0 from customers where overdrawn <> 1""")
def minority_majority_split(spark, sf):
    minority, majority = op.split_by_class(customers(spark, sf), "overdrawn")
    agg = [F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean_balance")]
    return tidy(minority.agg(*agg).select(F.lit("minority").alias("part"), "*").unionByName(
        majority.agg(*agg).select(F.lit("majority").alias("part"), "*")))


@query("label_sorted_range", "B-10", f"""
with {CUSTOMERS}, o as (select c_custkey, overdrawn, {tie_rank_sql('overdrawn', 'c_custkey')} - 1 as pos,
                        count(*) over () as n from customers)
select c_custkey, overdrawn from o where pos >= n - 150 and pos < n - 10""")
def label_sorted_range(spark, sf):
    df = customers(spark, sf).select("c_custkey", "overdrawn")
    return op.row_range(df, "overdrawn", "c_custkey", -150, -10)


@query("prefix_train_split", "B-11", """
select o_orderkey, row_number() over (order by o_orderkey) <= 1000 as is_train from orders""")
def prefix_train_split(spark, sf):
    df = load_table(spark, sf, "orders").select("o_orderkey")
    return op.prefix_split(df, "o_orderkey", "o_orderkey", 1000)


@query("row_sample", "B-12", f"""
with s as (select event_id, value, {shuffled_sql('sample7', 'event_id')} as pos from events)
select event_id, value from s where pos <= 500""")
def row_sample(spark, sf):
    return op.sample_rows(events(spark, sf).select("event_id", "value"), 500, "event_id", seed=7)


@query("row_sample_with_replacement", "B-12", f"""
with s as (select event_id, value, {shuffled_sql('sample7', 'event_id')} as pos, count(*) over () as n from events),
d as (select d::bigint as draw_id, floor({u_sql('pick7', 'd')} * (select count(*) from events))::bigint + 1 as pos
      from range(500) t(d))
select draw_id, event_id, value from d join s using (pos)""")
def row_sample_with_replacement(spark, sf):
    return op.sample_rows(events(spark, sf).select("event_id", "value"), 500, "event_id", seed=7, replace=True)


@query("derived_norm", "B-13", """
select vec_id, round(sqrt(list_sum([x::double * x::double for x in embedding])), 4) + 0e0 as norm from embeddings""")
def derived_norm(spark, sf):
    return op.with_norm(vectors(spark, sf), [f"x{i}" for i in range(64)]).select("vec_id", "norm")


# ---- joins ---------------------------------------------------------------------

@query("labelled_documents", "C-1", """
select d.doc_id, d.lang, d.n_chars, l.quality from documents d join labels l on d.doc_id = l.doc_id""")
def labelled_documents(spark, sf):
    x = load_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return lv.attach_label(x, load_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def _two_parts(spark, sf):
    cut = parts(spark, sf).select("p_partkey", "p_brand", "p_type").withColumn(
        "test", uniform("p_partkey", "cut") < 0.25)
    return cut.filter(~F.col("test")).drop("test"), cut.filter("test").drop("test")


TWO_PARTS = f"""cut as (select p_partkey, p_brand, p_type, {u_sql('cut', 'p_partkey')} < 0.25e0 as test from part),
train as (select * from cut where not test), tst as (select * from cut where test)"""


@query("levels_only_in_test", "C-2, G-3", """
with e as (select user_id, value >= (select avg(value) from events) as high from events)
select distinct user_id as level from e where high and user_id not in (select user_id from e where not high)""")
def levels_only_in_test(spark, sf):
    df = events(spark, sf)
    cut = df.agg(F.avg("value")).first()[0]
    return lv.unseen_levels(df.filter(F.col("value") < cut), df.filter(F.col("value") >= cut), "user_id")


@query("pooled_levels", "C-3", f"""
with {TWO_PARTS}, kept as (select p_brand from train group by 1 having count(*) >= 60)
select p_partkey, case when p_brand in (select p_brand from kept) then p_brand else '___' end as p_brand,
       test as is_test
from cut""")
def pooled_levels(spark, sf):
    train, test = lv.pool_levels(*_two_parts(spark, sf), ["p_brand"])
    return train.select("p_partkey", "p_brand", F.lit(False).alias("is_test")).unionByName(
        test.select("p_partkey", "p_brand", F.lit(True).alias("is_test")))


@query("coded_levels", "C-4, I-5", f"""
with {TWO_PARTS}, f as (select p_brand, min(p_partkey) as first from train where p_type <> 'PROMO' group by 1),
codes as (select p_brand, (row_number() over (order by first) - 1)::int as code from f)
select t.p_partkey, c.code as p_brand from tst t left join codes c using (p_brand)""")
def coded_levels(spark, sf):
    from evenkeel.operators.encode import appearance_codes

    train, test = _two_parts(spark, sf)
    codes = appearance_codes(train.filter(F.col("p_type") != "PROMO"), "p_brand", "p_partkey")
    return lv.apply_codes(test, "p_brand", codes).select("p_partkey", "p_brand")
