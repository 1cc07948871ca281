"""Nearest neighbours, Tomek links and the SMOTE family."""

from pyspark.sql import functions as F

from evenkeel.catalog.registry import (
    PART_SPEC,
    parts,
    query,
    r,
    shuffled_sql,
    tidy,
    u_sql,
    vector_spec,
    vectors,
    vectors_sql,
)
from evenkeel.operators import neighbors as nb
from evenkeel.operators import synthetic as op
from evenkeel.plans.sampling import sampling_plan

K = 5


def knn_sql(width: int, within: bool, only: str = "") -> str:
    """Ranked neighbours ``nn(vec_id, label, neighbor, neighbor_label, rank, distance)``."""
    same = "a.label = b.label and" if within else ""
    return f"""pairs as (select a.vec_id, a.label, b.vec_id as neighbor, b.label as neighbor_label,
  list_distance(a.e, b.e) as distance from vec a join vec b on {same} a.vec_id <> b.vec_id {only}),
nn as (select *, row_number() over (partition by vec_id order by distance, neighbor) as rank from pairs
       qualify rank <= {K})"""


@query("nearest_within_class", "C-5", f"""
with {vectors_sql()}, {knn_sql(64, True)}
select vec_id, rank::int as rank, neighbor, neighbor_label, {r('distance', 'distance')} from nn""")
def nearest_within_class(spark, sf):
    return tidy(nb.knn(vectors(spark, sf), vector_spec(), K))


@query("nearest_any_class", "C-6", f"""
with {vectors_sql()}, {knn_sql(64, False)}
select vec_id, rank::int as rank, neighbor, neighbor_label, {r('distance', 'distance')} from nn""")
def nearest_any_class(spark, sf):
    return tidy(nb.knn(vectors(spark, sf), vector_spec(), K, within_class=False))


@query("nearest_any_class_by_cells", "C-6", f"""
with {vectors_sql()}, {knn_sql(64, False)}
select vec_id, rank::int as rank, neighbor, neighbor_label, {r('distance', 'distance')} from nn""")
def nearest_any_class_by_cells(spark, sf):
    df, spec = vectors(spark, sf), vector_spec()
    return tidy(nb.knn(df, spec, K, within_class=False, block_points=64))


@query("tomek_links", "C-7", f"""
with {vectors_sql()}, {knn_sql(64, False)}, one as (select * from nn where rank = 1)
select a.vec_id as a, a.neighbor as b, a.label as label_a, a.neighbor_label as label_b
from one a join one b on a.neighbor = b.vec_id and b.neighbor = a.vec_id
where a.vec_id < a.neighbor and a.label <> a.neighbor_label""")
def tomek_links(spark, sf):
    return nb.tomek_links(vectors(spark, sf), vector_spec())


@query("tomek_cleaning", "K-12", f"""
with {vectors_sql()}, {knn_sql(64, False)}, one as (select * from nn where rank = 1),
small as (select label from vec group by 1 order by count(*), label::varchar limit 1),
spent as (select a.vec_id from one a join one b on a.neighbor = b.vec_id and b.neighbor = a.vec_id
          where a.label <> a.neighbor_label and a.label <> (select label from small))
select vec_id, label from vec where vec_id not in (select vec_id from spent)""")
def tomek_cleaning(spark, sf):
    return op.clean_tomek(vectors(spark, sf), vector_spec()).select("vec_id", "label")


PENALTY = """pen as (select (stddev_pop(p_size) + stddev_pop(p_retailprice)) / 2 as pen from part where {who})"""


def mixed_pairs_sql(on: str) -> str:
    return f"""pairs as (select a.p_partkey, a.p_type, b.p_partkey as neighbor, b.p_type as neighbor_type,
  (a.p_size - b.p_size) * (a.p_size - b.p_size)
  + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)
  + case when a.p_brand <> b.p_brand then pen * pen else 0e0 end as d2
  from part a join part b on {on} a.p_partkey <> b.p_partkey, pen)"""


SMALL_TYPE = "(select p_type from part group by 1 order by count(*), p_type limit 1)"


@query("tomek_cleaning_mixed", "K-13", f"""
with {PENALTY.format(who='p_type = ' + SMALL_TYPE)}, {mixed_pairs_sql('')},
one as (select * from pairs qualify row_number() over (partition by p_partkey order by d2, neighbor) = 1),
spent as (select a.p_partkey from one a join one b on a.neighbor = b.p_partkey and b.neighbor = a.p_partkey
          where a.p_type <> a.neighbor_type and a.p_type <> {SMALL_TYPE})
select p_partkey, p_type from part where p_partkey not in (select p_partkey from spent)""")
def tomek_cleaning_mixed(spark, sf):
    return op.clean_tomek(parts(spark, sf), PART_SPEC).select("p_partkey", "p_type")


# ---- SMOTE ------------------------------------------------------------------------

SMOTE_W = 64
DRAWS = f"""n as (select label, count(*) as n from vec group by 1),
p as (select label, n, max(n) over () - n as n_new from n),
idx as (select vec_id, label, {shuffled_sql('idx0', 'base', 'label').replace('base', 'vec_id')} as idx from vec),
d as (select label, draw_id, floor({u_sql('base0', 'label', 'draw_id')} * n)::bigint + 1 as idx,
             (floor({u_sql('slot0', 'label', 'draw_id')} * least({K}, n - 1)) + 1)::int as rank,
             {u_sql('gap0', 'label', 'draw_id')} as gap
      from (select label, n, unnest(range(n_new::bigint)) as draw_id from p)),
pick as (select d.label, draw_id, idx.vec_id as base, nn.neighbor, gap
         from d join idx using (label, idx) join nn on nn.vec_id = idx.vec_id and nn.rank = d.rank)"""
NEW_ROWS = ", ".join(
    r(f"a.e[{i + 1}] + gap * (b.e[{i + 1}] - a.e[{i + 1}])", f"x{i}") for i in range(SMOTE_W))


@query("draw_pairs", "C-9", f"""
with {vectors_sql(SMOTE_W)}, {knn_sql(SMOTE_W, True)}, {DRAWS}
select label, draw_id, base, neighbor, {r('gap', 'gap', 9)} from pick""")
def draw_pairs(spark, sf):
    df, spec = vectors(spark, sf, SMOTE_W), vector_spec(SMOTE_W)
    near = nb.knn(df, spec, K)
    return tidy(op.draw_pairs(df, spec, sampling_plan(df, "label"), near, K), 9)


@query("smote", "K-8, H-10", f"""
with {vectors_sql(SMOTE_W)}, {knn_sql(SMOTE_W, True)}, {DRAWS}
select vec_id, {', '.join(r(f'e[{i + 1}]', f'x{i}') for i in range(SMOTE_W))}, label, false as is_synthetic from vec
union all
select null, {NEW_ROWS}, pick.label, true from pick join vec a on a.vec_id = base join vec b on b.vec_id = neighbor""")
def smote(spark, sf):
    df, spec = vectors(spark, sf, SMOTE_W), vector_spec(SMOTE_W)
    return tidy(op.smote(df, spec, sampling_plan(df, "label"), K))


@query("smote_new_rows", "K-9", f"""
with {vectors_sql(SMOTE_W)}, {knn_sql(SMOTE_W, True)}, {DRAWS}
select draw_id, {NEW_ROWS}, pick.label, true as is_synthetic
from pick join vec a on a.vec_id = base join vec b on b.vec_id = neighbor""")
def smote_new_rows(spark, sf):
    df, spec = vectors(spark, sf, SMOTE_W), vector_spec(SMOTE_W)
    return tidy(op.smote(df, spec, sampling_plan(df, "label"), K, only_new=True))


@query("smote_mixed", "K-10", f"""
with n as (select p_type, count(*) as n from part group by 1),
p as (select p_type, n, max(n) over () - n as n_new from n),
{PENALTY.format(who='p_type in (select p_type from p where n_new > 0)')},
{mixed_pairs_sql('a.p_type = b.p_type and')},
nn as (select *, row_number() over (partition by p_partkey order by d2, neighbor) as rank from pairs qualify rank <= {K}),
idx as (select p_partkey, p_type, {shuffled_sql('idx0', 'p_partkey', 'p_type')} as idx from part),
d as (select p_type, draw_id, floor({u_sql('base0', 'p_type', 'draw_id')} * n)::bigint + 1 as idx,
             (floor({u_sql('slot0', 'p_type', 'draw_id')} * {K}) + 1)::int as rank, {u_sql('gap0', 'p_type', 'draw_id')} as gap
      from (select p_type, n, unnest(range(n_new::bigint)) as draw_id from p)),
votes as (select nn.p_partkey as base, b.p_brand from nn join part b on b.p_partkey = nn.neighbor group by 1, 2
          qualify row_number() over (partition by base order by count(*) desc, p_brand) = 1)
select draw_id, round(a.p_size + gap * (b.p_size - a.p_size), 6) as p_size,
       round(a.p_retailprice + gap * (b.p_retailprice - a.p_retailprice), 6) as p_retailprice, v.p_brand, d.p_type, true as is_synthetic
from d join idx using (p_type, idx) join nn on nn.p_partkey = idx.p_partkey and nn.rank = d.rank
join part a on a.p_partkey = idx.p_partkey join part b on b.p_partkey = nn.neighbor join votes v on v.base = idx.p_partkey""")
def smote_mixed(spark, sf):
    df = parts(spark, sf).withColumn("p_size", F.col("p_size").cast("double"))
    return tidy(op.smote_nc(df, PART_SPEC, sampling_plan(df, "p_type"), K, only_new=True))


@query("adasyn", "K-11", f"""
with {vectors_sql(SMOTE_W)}, nn_all as (select * from (select a.vec_id, b.label as other_label,
    row_number() over (partition by a.vec_id order by list_distance(a.e, b.e), b.vec_id) as rank
  from vec a join vec b on a.vec_id <> b.vec_id where a.label = 5) where rank <= {K}),
total as (select sum((label <> 5)::int)::double - 2 * sum((label = 5)::int) as n_new, sum((label = 5)::int) as n from vec),
o as (select vec_id, count(*) filter (other_label <> 5) as other from nn_all group by 1),
s as (select vec_id as base, round_even(other * (select n_new from total) / (select sum(other) from o)::double, 0)::bigint as n_new from o),
near as (select a.vec_id, b.vec_id as neighbor,
    row_number() over (partition by a.vec_id order by list_distance(a.e, b.e), b.vec_id) as rank
  from vec a join vec b on a.vec_id <> b.vec_id where a.label = 5 and b.label = 5 qualify rank <= {K}),
d as (select base, draw_id, (floor({u_sql('slot0', 'base', 'draw_id')} * {K}) + 1)::int as rank,
             {u_sql('gap0', 'base', 'draw_id')} as gap
      from (select base, unnest(range(n_new)) as draw_id from s))
select draw_id, {NEW_ROWS}, 1 as y, true as is_synthetic
from d join near on near.vec_id = d.base and near.rank = d.rank
join vec a on a.vec_id = d.base join vec b on b.vec_id = near.neighbor""")
def adasyn(spark, sf):
    df = vectors(spark, sf, SMOTE_W).withColumn("y", F.when(F.col("label") == 5, 1).otherwise(0)).drop("label")
    spec = vector_spec(SMOTE_W, "y")
    counts = {row["y"]: row["count"] for row in df.groupBy("y").count().collect()}
    plan = sampling_plan(df, "y", {1: counts[0] - counts[1]})
    return tidy(op.adasyn(df, spec, plan, K, only_new=True))
