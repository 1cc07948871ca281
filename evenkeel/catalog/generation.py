"""The class-conditional generator and its mergeable state."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.catalog.registry import parts, query, tidy, u_sql
from evenkeel.functions.draws import uniform
from evenkeel.operators import generator as op
from evenkeel.operators.profile import class_profile
from evenkeel.plans.sampling import sampling_plan
from evenkeel.session import scratch_path
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec
from evenkeel.streaming.state import class_counts_of, read_state, stream_update

LINE_SPEC = FeatureSpec("l_returnflag", "l_orderkey", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"])
PART = FeatureSpec("p_type", "p_partkey", ["p_size", "p_retailprice"], ["p_brand"])


def _grown(spark, sf):
    df = parts(spark, sf)
    return df, sampling_plan(df, "p_type", {"PROMO": 400, "SMALL": 250}, mode="new")


def _states(fitted, spark):
    rows = [(g, s.n, len(s.grids), sum(len(lv) for lv in s.levels)) for g, s in fitted.states.items()]
    return spark.createDataFrame(rows, "p_type string, n bigint, grids int, levels int")


@query("generator_fit", "L-1", """
select p_type, count(*) as n, 2 as grids, count(distinct p_brand)::int as levels from part group by 1""")
def generator_fit(spark, sf):
    path = scratch_path(spark, "generator")
    op.ConditionalGenerator.fit(parts(spark, sf), PART).write(spark, path)
    return _states(op.ConditionalGenerator.read(spark, path), spark)


def _plausible(new, df):
    """Generated rows hold values and levels that rows of their class have."""
    known = df.groupBy("p_type").agg(
        F.min("p_size").alias("s0"), F.max("p_size").alias("s1"), F.min("p_retailprice").alias("r0"),
        F.max("p_retailprice").alias("r1"), F.collect_set("p_brand").alias("brands"))
    inside = (F.col("p_size").between(F.col("s0"), F.col("s1"))
              & F.col("p_retailprice").between(F.col("r0") - 1e-6, F.col("r1") + 1e-6)
              & F.array_contains("brands", F.col("p_brand")))
    return new.join(known, "p_type").withColumn("in_class", inside)


@query("generator_sample", "L-2", """
select 'PROMO' as p_type, unnest(range(400))::bigint as draw_id, true as in_class
union all select 'SMALL', unnest(range(250)), true""")
def generator_sample(spark, sf):
    df, plan = _grown(spark, sf)
    return _plausible(op.ConditionalGenerator.fit(df, PART).sample(plan, seed=1), df).select(
        "p_type", "draw_id", "in_class")


@query("generator_sample_profile", "L-2, L-3", """
select p_type, case when p_type in ('PROMO') then count(*) + 400 when p_type = 'SMALL' then count(*) + 250
       else count(*) end::bigint as n from part group by 1""")
def generator_sample_profile(spark, sf):
    df = parts(spark, sf)
    counts = {row["p_type"]: row["n"] for row in class_profile(df, "p_type").collect()}
    target = {c: n + {"PROMO": 400, "SMALL": 250}.get(c, 0) for c, n in counts.items()}
    grown = op.fit_resample(df, PART, target)
    return class_profile(grown, "p_type").select("p_type", "n")


@query("generator_resample", "L-3", """
with n as (select p_type, count(*) as n from part group by 1)
select p_type, p_partkey, p_size::double as p_size, p_retailprice, p_brand, true as in_class from part
union all
select p_type, null, null, null, null, true from (
  select p_type, unnest(range((select max(n) from n) - n)) from n)""")
def generator_resample(spark, sf):
    """Real rows come back as they are; a new row shows that it fits its class."""
    df = parts(spark, sf)
    rows = _plausible(op.fit_resample(df, PART, "auto"), df)
    real = ~F.col("is_synthetic")
    return rows.select(
        "p_type", "p_partkey", F.when(real, F.col("p_size").cast("double")).alias("p_size"),
        F.when(real, F.col("p_retailprice")).alias("p_retailprice"), F.when(real, F.col("p_brand")).alias("p_brand"),
        "in_class")


@query("generator_chosen_classes", "L-4", """
select p_type, count(*) as n, 2 as grids, count(distinct p_brand)::int as levels from part
where p_type in ('PROMO', 'SMALL') group by 1""")
def generator_chosen_classes(spark, sf):
    return _states(op.ConditionalGenerator.fit(parts(spark, sf), PART, classes=["PROMO", "SMALL"]), spark)


@query("generator_unconditional", "L-5, L-7", "select 'PROMO' as p_type, 400::bigint as n union all select 'SMALL', 250")
def generator_unconditional(spark, sf):
    df, plan = _grown(spark, sf)
    fitted = op.ConditionalGenerator.fit(df, PART, conditional=False)
    fitted.check_columns(df)
    return fitted.sample(plan, seed=1).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("independent_marginals", "L-8", f"""
with g as (select p_type, quantile_cont(p_size, {[i / 100 for i in range(101)]}) as gs,
                  quantile_cont(p_retailprice, {[i / 100 for i in range(101)]}) as gp from part group by 1),
lv as (select p_type, p_brand, count(*)::double / sum(count(*)) over (partition by p_type) as share from part group by 1, 2),
cum as (select p_type, p_brand, sum(share) over (partition by p_type order by p_brand) as hi,
               row_number() over (partition by p_type order by p_brand) as i,
               count(*) over (partition by p_type) as k, sum(share) over (partition by p_type) as total from lv),
d as (select p_type, draw_id, {u_sql('gen1.0', 'p_type', 'draw_id')} as u0, {u_sql('gen1.1', 'p_type', 'draw_id')} as u1,
             {u_sql('gen1.2', 'p_type', 'draw_id')} as u2
      from (select 'PROMO' as p_type, unnest(range(400)) as draw_id union all select 'SMALL', unnest(range(250)))),
s as (select d.*, least(floor(u0 * 100), 99)::int as i0, least(floor(u1 * 100), 99)::int as i1, gs, gp from d join g using (p_type)),
c as (select d.p_type, d.draw_id, min(i) as i from d join cum on cum.p_type = d.p_type and (hi > u2 * total or i = k) group by 1, 2)
select s.draw_id, s.p_type, round(gs[i0 + 1] + (gs[i0 + 2] - gs[i0 + 1]) * (u0 * 100 - i0), 4)::double as p_size,
       round(gp[i1 + 1] + (gp[i1 + 2] - gp[i1 + 1]) * (u1 * 100 - i1), 4) as p_retailprice, cum.p_brand
from s join c using (p_type, draw_id) join cum on cum.p_type = s.p_type and cum.i = c.i""")
def independent_marginals(spark, sf):
    df = parts(spark, sf).withColumn("p_size", F.col("p_size").cast("double"))
    plan = sampling_plan(df, "p_type", {"PROMO": 400, "SMALL": 250}, mode="new")
    fitted = op.ConditionalGenerator.fit(df, PART, exact=True, correlation=False)
    return tidy(fitted.sample(plan, seed=1, correlation=False), 4)


REALISTIC = 100


@query("most_realistic_rows", "L-9", f"""
select 'PROMO' as p_type, i::int as place, true as in_class, true as in_order from range(1, {REALISTIC + 1}) t(i)""")
def most_realistic_rows(spark, sf):
    """The rows, with all features, that a discriminator trained on other rows takes for real ones."""
    df = parts(spark, sf)
    plan = sampling_plan(df, "p_type", {"PROMO": 20 * REALISTIC}, mode="new")
    fake = op.ConditionalGenerator.fit(df, PART, classes=["PROMO"]).sample(plan)
    kept = op.most_realistic(df.filter("p_type = 'PROMO'"), fake, PART, REALISTIC,
                             {"n_estimators": 10, "max_depth": 5})
    order = Window.orderBy("score", "draw_id")
    ranked = kept.withColumn("place", F.row_number().over(order)).withColumn(
        "in_order", F.col("score").between(0, 1) & (F.col("score") >= F.coalesce(F.lag("score").over(order), F.lit(0.0))))
    return _plausible(ranked, df).select("p_type", "place", "in_class", "in_order")


# ---- mergeable state --------------------------------------------------------------

BINS = 16


def _state_sql() -> str:
    cols = list(LINE_SPEC.continuous)
    parts_ = ["select l_returnflag as g, 'n' as kind, '' as a, '' as b, count(*)::double as value from lineitem group by 1"]
    parts_ += [f"select l_returnflag, 'sum', '{c}', '', round(sum({c}), 6) from lineitem group by 1" for c in cols]
    parts_ += [f"select l_returnflag, 'cross', '{a}', '{b}', round(sum({a} * {b}), 6) from lineitem group by 1"
               for i, a in enumerate(cols) for b in cols[i:]]
    parts_ += [f"""select l_returnflag, 'bin', '{c}', greatest(least(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / {BINS})), {BINS - 1}), 0)::int::varchar,
  count(*)::double from lineitem, s group by 1, 4""" for c in cols]
    parts_.append("select l_returnflag, 'level', 'l_linestatus', l_linestatus, count(*)::double from lineitem group by 1, 4")
    edges = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in cols)
    return f"with s as (select {edges} from lineitem)\n" + "\nunion all\n".join(parts_)


@query("updated_generator_state", "L-6", _state_sql())
def updated_generator_state(spark, sf):
    df = load_table(spark, sf, "lineitem").select(*LINE_SPEC.columns)
    from evenkeel.operators.profile import value_range

    ranges = value_range(df, LINE_SPEC.continuous)
    early = uniform("l_orderkey", "arrival") < 0.6
    state, _ = op.fit_state(df.filter(early), LINE_SPEC, ranges, BINS)
    return tidy(op.update_state(state, df.filter(~early), LINE_SPEC, ranges, BINS))


@query("streamed_class_profile", "O-1", "select event_type as label, count(*) as n from events group by 1")
def streamed_class_profile(spark, sf):
    spec = FeatureSpec("event_type", "event_id", ["value"])
    folder = scratch_path(spark, "arrivals")
    table = load_table(spark, sf, "events").select(*spec.columns)
    table.repartition(4, "event_id").write.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    path = scratch_path(spark, "stream-state")
    stream_update(stream, spec, path, {"value": (0.0, 500.0)}, scratch_path(spark, "checkpoint"),
                  BINS).awaitTermination()
    return class_counts_of(read_state(spark, path))
