"""Scans and sinks: the tables are written in each format and read back."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import query, r, tidy
from evenkeel.operators.encode import MinMax, Preprocess, Standard
from evenkeel.operators.profile import class_profile
from evenkeel.plans.grid import experiment_table
from evenkeel.session import scratch_path
from evenkeel.sources.files import (
    load_table,
    read_column_json,
    read_delimited,
    read_experiment,
    write_report,
)
from evenkeel.spec import FeatureSpec


@query("tab_separated_scan", "A-1",
       "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def tab_separated_scan(spark, sf):
    path = scratch_path(spark, "tabs")
    cols = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
    load_table(spark, sf, "customer").select(*cols).write.option("sep", "\t").csv(path)
    return read_delimited(
        spark, path, "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("semicolon_header_scan", "A-2",
       "select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_totalprice, "
       "o_orderstatus from orders")
def semicolon_header_scan(spark, sf):
    path = scratch_path(spark, "semicolons")
    load_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"
    ).write.option("sep", ";").option("header", True).csv(path)
    return read_delimited(
        spark, path, "o_orderkey string, o_custkey string, o_totalprice double, o_orderstatus string",
        sep=";", header=True)


@query("label_file_scan", "A-3", "select doc_id as id, quality as target from labels")
def label_file_scan(spark, sf):
    path = scratch_path(spark, "labels")
    load_table(spark, sf, "labels").select("doc_id", "quality").write.option("sep", ";").csv(path)
    return read_delimited(spark, path, "id bigint, target int", sep=";")


@query("column_json_scan", "A-4", """
select case when o_orderpriority = '1-URGENT' then 1 else -1 end::bigint as label,
       o_totalprice as f0, o_custkey::double as f1,
       (row_number() over (partition by o_orderkey // 100 order by o_orderkey) - 1)::int as pos
from orders""")
def column_json_scan(spark, sf):
    path = scratch_path(spark, "columns")
    block = F.floor(F.col("o_orderkey") / 100)
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(-1)
    packed = load_table(spark, sf, "orders").groupBy(block.alias("b")).agg(
        F.sort_array(F.collect_list(F.struct(
            "o_orderkey", flag.alias("y"), F.col("o_totalprice").alias("f0"),
            F.col("o_custkey").cast("double").alias("f1")))).alias("rows"))
    packed.select(
        F.array(F.col("rows.y")).alias("Y"), F.array("rows.f0", "rows.f1").alias("Xcat")
    ).write.json(path)
    return read_column_json(spark, path, multi_line=False).drop("block")


@query("parquet_scan", "A-5",
       "select doc_id, lang, source, n_chars from documents where n_chars > 500")
def parquet_scan(spark, sf):
    return load_table(spark, sf, "documents").filter("n_chars > 500").select(
        "doc_id", "lang", "source", "n_chars")


@query("report_sink", "A-6", f"""
with p as (select c_mktsegment, count(*) as n, {r('count(*) / sum(count(*)) over ()', 'share')},
                  {r('count(*) / max(count(*)) over ()', 'ratio')} from customer group by 1)
select 'segments' as report, * from p
union all (select 'largest', * from p order by n desc, c_mktsegment limit 1)""")
def report_sink(spark, sf):
    """Both tables of the report, as they are read back."""
    path = scratch_path(spark, "report")
    profile = class_profile(load_table(spark, sf, "customer"), "c_mktsegment")
    tables = {"segments": profile, "largest": profile.orderBy(F.desc("n"), "c_mktsegment").limit(1)}
    write_report(tables, path)
    back = [read_delimited(spark, f"{path}/{name}", "c_mktsegment string, n bigint, share double, ratio double",
                           sep=",", header=True).select(F.lit(name).alias("report"), "*") for name in tables]
    return tidy(back[0].unionByName(back[1]))


@query("experiment_config", "A-7", """
with n as (select c_mktsegment as sampler, count(*) as n from customer group by 1)
select sampler, 'LR' as model, parameter,
       case when parameter = 'classifier__C' then (select count(*) from n) else n.n end::double as number
from n, (values ('classifier__C'), ('sampler__target')) as p(parameter)""")
def experiment_config(spark, sf):
    import json

    sizes = class_profile(load_table(spark, sf, "customer"), "c_mktsegment").collect()
    config = {"models": {"LR": {"C": [len(sizes)]}},
              "samplers": {row["c_mktsegment"]: {"target": [row["n"]]} for row in sizes}}
    path = scratch_path(spark, "config")
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(path)
    return experiment_table(spark, read_experiment(spark, path)).select(
        "sampler", "model", "parameter", "number")


@query("fitted_state_round_trip", "A-8, I-7", f"""
with s as (select min(o_totalprice) lo, max(o_totalprice) hi, avg(o_custkey) m, stddev_pop(o_custkey) sd
           from orders)
select o_orderkey, o_orderstatus, {r('(o_totalprice - lo) / (hi - lo)', 'o_totalprice')},
       {r('(o_custkey - m) / sd', 'o_custkey')}
from orders, s""")
def fitted_state_round_trip(spark, sf):
    spec = FeatureSpec("o_orderstatus", "o_orderkey", ["o_totalprice", "o_custkey"])
    df = load_table(spark, sf, "orders").select(*spec.columns)
    path = scratch_path(spark, "state")
    steps = [(MinMax, ["o_totalprice"]), (Standard, ["o_custkey"])]
    Preprocess(spec, steps).fit(df).write(spark, path)
    return tidy(Preprocess.read(spark, path, spec).transform(df))
