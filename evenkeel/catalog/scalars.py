"""Scalar functions, encoders and the order-table recipe."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import events, parts, query, r, tidy, u_sql, vectors
from evenkeel.functions import (
    clamp,
    date_parts,
    day_diff,
    fallback,
    normal,
    onehot,
    onehot_to_label,
    parse_date,
    sample_category,
    softmax,
    uniform,
)
from evenkeel.functions.scalars import interpolate_arrays
from evenkeel.operators import encode as op
from evenkeel.plans.recipe import order_features_recipe
from evenkeel.session import reuse
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec

# ---- dates -----------------------------------------------------------------------


@query("parsed_dates", "H-1", """
with t as (select o_orderkey, case when o_orderkey % 7 = 0 then '0000-99-99'
                                   else strftime(o_orderdate, '%Y-%m-%d') end as txt from orders)
select o_orderkey, try_strptime(txt, '%Y-%m-%d')::date as parsed from t""")
def parsed_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("0000-99-99")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return load_table(spark, sf, "orders").select("o_orderkey", parse_date(text, "yyyy-MM-dd").cast("date").alias("parsed"))


def _order_dates(spark, sf):
    ship = load_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("promised"), F.max("l_shipdate").alias("delivered"))
    orders = load_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    return orders.join(ship, "o_orderkey", "left")


ORDER_DATES = """ship as (select l_orderkey as o_orderkey, min(l_shipdate) as promised, max(l_shipdate) as delivered
  from lineitem group by 1),
od as (select o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderpriority, o.o_totalprice, promised, delivered
  from orders o left join ship using (o_orderkey))"""


@query("date_fallback", "H-2", f"""
with {ORDER_DATES} select o_orderkey, coalesce(promised, delivered, o_orderdate)::date as promised from od""")
def date_fallback(spark, sf):
    return _order_dates(spark, sf).select(
        "o_orderkey", fallback("promised", "delivered", "o_orderdate").cast("date").alias("promised"))


@query("date_parts", "H-3", """
select o_orderkey, month(o_orderdate)::int as month, day(o_orderdate)::int as day,
       (isodow(o_orderdate) - 1)::int as weekday from orders""")
def date_parts_query(spark, sf):
    return load_table(spark, sf, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in date_parts("o_orderdate").items()])


@query("day_differences", "H-4", f"""
with {ORDER_DATES}
select o_orderkey, date_diff('day', o_orderdate::date, delivered::date)::int as delay,
       date_diff('day', promised::date, delivered::date)::int as spread from od""")
def day_differences(spark, sf):
    return _order_dates(spark, sf).select(
        "o_orderkey", day_diff("delivered", "o_orderdate").alias("delay"),
        day_diff("delivered", "promised").alias("spread"))


# ---- arrays ------------------------------------------------------------------------

@query("onehot_to_label", "H-5", """
select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as code from embeddings""")
def onehot_to_label_query(spark, sf):
    return vectors(spark, sf).select("vec_id", onehot_to_label([f"x{i}" for i in range(64)]).alias("code"))


@query("label_to_onehot", "H-6", """
select vec_id, i::int as level, case when label = i then 1e0 else 0e0 end as hot
from embeddings, range(10) t(i)""")
def label_to_onehot(spark, sf):
    return vectors(spark, sf, 1).select(
        "vec_id", F.posexplode(onehot("label", 10)).alias("level", "hot"))


@query("category_draw", "H-7", f"""
with e as (select vec_id, [abs(v::double) for v in embedding] as w,
                  {u_sql('cat', 'vec_id')} as u from embeddings),
x as (select vec_id, u, w, unnest(w) as v, generate_subscripts(w, 1) as i from e),
c as (select vec_id, i, u * sum(v) over (partition by vec_id) as target,
             sum(v) over (partition by vec_id order by i) as mass from x)
select vec_id, least(count(*) filter (where mass <= target), 63)::int as code from c group by 1""")
def category_draw(spark, sf):
    weights = F.array(*[F.abs(f"x{i}") for i in range(64)])
    return vectors(spark, sf).select(
        "vec_id", sample_category(weights, uniform("vec_id", "cat")).alias("code"))


@query("softmax", "H-8", f"""
with x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i
           from embeddings)
select vec_id, (i - 1)::int as pos,
       {r('exp(v - max(v) over w) / sum(exp(v)) over w * exp(max(v) over w)', 'share')}
from x window w as (partition by vec_id)""")
def softmax_query(spark, sf):
    scores = F.array(*[f"x{i}" for i in range(64)])
    return tidy(vectors(spark, sf).select("vec_id", F.posexplode(softmax(scores)).alias("pos", "share")))


@query("weighted_level_vectors", "H-9", f"""
with x as (select label, vec_id % 7 + 1 as w, unnest(embedding)::double as v,
                  generate_subscripts(embedding, 1) - 1 as pos from embeddings)
select label, pos::int as pos, {r('sum(w * v) / sum(w)', 'value')} from x group by 1, 2""")
def weighted_level_vectors(spark, sf):
    from evenkeel.operators.profile import weighted_embedding

    df = load_table(spark, sf, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1)
    return tidy(weighted_embedding(df, "w", "embedding", ["label"]))


@query("convex_combination", "H-10", f"""
with p as (select a.vec_id, a.embedding as x, b.embedding as y, {u_sql('mix', 'a.vec_id')} as gap
           from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
z as (select vec_id, gap, unnest(x)::double as x, unnest(y)::double as y,
             generate_subscripts(x, 1) - 1 as pos from p)
select vec_id, pos::int as pos, {r('x + gap * (y - x)', 'value')} from z""")
def convex_combination(spark, sf):
    e = load_table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("y"))
    mixed = interpolate_arrays("x", "y", uniform("vec_id", "mix"))
    return tidy(a.join(b, "vec_id").select("vec_id", F.posexplode(mixed).alias("pos", "value")))


@query("clamped_values", "H-11", """
select event_id, greatest(least(value, 60e0), 5e0) as value from events""")
def clamped_values(spark, sf):
    return events(spark, sf).select("event_id", clamp("value", 5.0, 60.0).alias("value"))


@query("keyed_draws", "H-12", f"""
select event_id, {r(u_sql('7', 'event_id'), 'u', 9)},
  {r(f"sqrt(-2e0 * ln(1e0 - {u_sql('7r', 'event_id')})) * cos(2e0 * pi() * {u_sql('7a', 'event_id')})", 'z', 9)}
from events""")
def keyed_draws(spark, sf):
    return tidy(events(spark, sf).select(
        "event_id", uniform("event_id", 7).alias("u"), normal("event_id", 7).alias("z")), 9)


# ---- encoders ------------------------------------------------------------------------

@query("min_max_scaling", "I-1", f"""
with s as (select min(value) lo, max(value) hi from events where event_type = 'click')
select event_id, {r('(value - lo) / (hi - lo)', 'value')} from events, s""")
def min_max_scaling(spark, sf):
    df = events(spark, sf)
    scaler = op.MinMax.fit(df.filter("event_type = 'click'"), ["value"])
    return tidy(scaler.transform(df).select("event_id", "value"))


@query("standard_scaling", "I-2", f"""
with s as (select avg(value) m, stddev_pop(value) sd from events)
select event_id, {r('(value - m) / sd', 'value')} from events, s""")
def standard_scaling(spark, sf):
    df = events(spark, sf)
    return tidy(op.Standard.fit(df, ["value"]).transform(df).select("event_id", "value"))


@query("onehot_encoding", "I-3", """
with lv as (select p_type, row_number() over (order by p_type) - 1 as code
            from (select distinct p_type from part where p_type <> 'PROMO'))
select p_partkey, l.code::int as pos, case when p.p_type = l.p_type then 1e0 else 0e0 end as hot
from part p, lv l""")
def onehot_encoding(spark, sf):
    df = parts(spark, sf)
    enc = op.OneHot.fit(df.filter("p_type <> 'PROMO'"), ["p_type"])
    return enc.transform(df).select("p_partkey", F.posexplode("p_type_onehot").alias("pos", "hot"))


@query("sorted_level_codes", "I-4", """
select p_brand as level, (row_number() over (order by p_brand) - 1)::int as code
from (select distinct p_brand from part)""")
def sorted_level_codes(spark, sf):
    return op.ordinal_codes(parts(spark, sf), "p_brand")


@query("first_seen_codes", "I-5", """
select p_brand as level, (row_number() over (order by min(p_partkey)) - 1)::int as code from part group by 1""")
def first_seen_codes(spark, sf):
    return op.appearance_codes(parts(spark, sf), "p_brand", "p_partkey")


@query("quantile_bins", "I-6", """
with q as (select quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) as e from events where event_type <> 'error')
select event_id, len([c for c in e if value >= c])::int as value from events, q""")
def quantile_bins(spark, sf):
    df = events(spark, sf)
    return op.QuantileBins.fit(df.filter("event_type <> 'error'"), ["value"]).transform(df).select(
        "event_id", "value")


@query("encoder_round_trip", "I-8", """
select p_partkey, p_size::double as p_size, round(p_retailprice, 6) as p_retailprice, p_brand, p_type from part""")
def encoder_round_trip(spark, sf):
    spec = FeatureSpec("p_type", "p_partkey", ["p_size", "p_retailprice"], ["p_brand"])
    df = parts(spark, sf)
    prep = op.Preprocess(spec, [(op.MinMax, ["p_size"]), (op.Standard, ["p_retailprice"]), (op.OneHot, ["p_brand"])])
    prep.fit(df)
    return tidy(prep.inverse(prep.transform(df).drop("p_brand")))


RECIPE_MIN = 300


@query("order_feature_recipe", "I-9", f"""
with {ORDER_DATES},
f as (select o_custkey, min(o_orderdate) as created from orders group by 1),
base as (select od.o_orderkey, o_orderdate, f.created, promised, delivered, o_totalprice,
                c_nationkey::varchar as nation, case when c_mktsegment = 'MACHINERY' then 'MISSING' else c_mktsegment end as segment,
                case when o_orderpriority = '1-URGENT' then 1 else 0 end as target,
                {u_sql('recipe', 'od.o_orderkey')} < 0.3e0 as is_test
         from od join f using (o_custkey) join customer c on c.c_custkey = od.o_custkey),
p1 as (select * replace (coalesce(promised, delivered) as promised) from base),
p2 as (select * replace (coalesce(delivered, promised) as delivered) from p1),
p3 as (select * replace (coalesce(promised, o_orderdate) as promised, coalesce(delivered, o_orderdate) as delivered) from p2),
d as (select *, month(o_orderdate)::int as first_order_month, month(delivered)::int as delivered_month,
             day(delivered)::int as delivered_day, (isodow(promised) - 1)::int as delivered_weekday,
             date_diff('day', created::date, delivered::date)::int as account_age,
             date_diff('day', created::date, o_orderdate::date)::int as order_delay,
             date_diff('day', promised::date, delivered::date)::int as delivery_delay from p3),
kept as (select nation from d where not is_test group by 1 having count(*) >= {RECIPE_MIN}),
pooled as (select * replace (case when nation in (select nation from kept) then nation else '___' end as nation) from d),
cn as (select nation, row_number() over (order by min(o_orderkey)) - 1 as code from pooled where not is_test group by 1),
cs as (select segment, row_number() over (order by min(o_orderkey)) - 1 as code from pooled where not is_test group by 1),
cw as (select delivered_weekday as w, row_number() over (order by min(o_orderkey)) - 1 as code from pooled where not is_test group by 1)
select o_orderkey, o_totalprice, cn.code::int as nation, cs.code::int as segment, target, is_test,
       first_order_month, delivered_month, delivered_day, cw.code::int as delivered_weekday,
       account_age, order_delay, delivery_delay
from pooled left join cn using (nation) left join cs using (segment) left join cw on cw.w = delivered_weekday""")
def order_feature_recipe(spark, sf):
    orders = _order_dates(spark, sf)
    first = load_table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"))
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    who = load_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("nation"),
        segment.alias("segment"))
    base = reuse(orders.join(first, "o_custkey").join(who, "o_custkey").select(
        "o_orderkey", "o_orderdate", "created", "promised", "delivered", "o_totalprice", "nation", "segment",
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("target"),
        (uniform("o_orderkey", "recipe") < 0.3).alias("is_test")))
    train, test = order_features_recipe(
        base.filter(~F.col("is_test")), base.filter("is_test"),
        dates={"ordered": "o_orderdate", "created": "created", "promised": "promised", "delivered": "delivered"},
        missing={"segment": "MISSING"}, pooled=["nation"], coded=["nation", "segment", "delivered_weekday"],
        order="o_orderkey", min_count=RECIPE_MIN)
    return train.unionByName(test)
