"""The registered queries of this folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog.registry import u_sql
from evenkeel.llm import (
    centroids,
    cuckoo,
    jaccard,
    languages,
    licenses,
    lines,
    mixing,
    negatives,
    packing,
    pages,
    quality,
    suffixes,
    superkmers,
)
from evenkeel.sources.files import load_table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op3_quality_rules")
def op3_quality_rules(spark, sf):
    return quality.rate(load_table(spark, sf, "documents")).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "quality")


def _fill_sql(mark: str, room: str, eligible: str, names: str, first: str, turns: int) -> str:
    """Rounds that mark rows which fit into ``room`` one after another in the order of the draw."""
    out, table = [], first
    for i in range(turns):
        out.append(f"""{names}l{i} as (select *, {room} - sum(case when {mark} then size else 0 end)
              over (partition by source) as space from {table})""")
        out.append(f"""{names}e{i} as (select *, {eligible} and not {mark} and size > 0 and size <= space + 1e-6 as fits
              from {names}l{i})""")
        table = f"{names}f{i}"
        out.append(f"""{table} as (select * exclude ({mark}, space, fits), {mark} or (fits and
              sum(case when fits then size else 0 end) over (partition by source order by u, doc_id
              rows unbounded preceding) <= space + 1e-6) as {mark} from {names}e{i})""")
    return ",\n".join(out)


@query("op6_mix_sources", f"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
s as (select source, sum(size)::bigint as s, row_number() over (order by source nulls last) - 1 as rank
      from d group by source),
w as (select source, s, 1 + rank % 3 as w, 3 * s as cap, sum(s) over () as total, rank from s),
o as (select *, sum(w) over () - sum(w) over (order by cap / w, rank rows unbounded preceding) as free,
             total - sum(cap) over (order by cap / w, rank rows unbounded preceding) as rest
      from w),
level as (select greatest(max(total / all_w), coalesce(max(case when free > 0 then rest / free end), 0)) as level
          from o, (select sum(w) as all_w from w)),
t as (select source, s, least(cap::double, w * level) as target from w, level),
c as (select d.doc_id, d.source, d.size, t.s as source_size, t.target, {u_sql('mix', 'd.doc_id')} as u,
             coalesce(floor(t.target / nullif(t.s, 0)), 0) as whole,
             t.target - coalesce(floor(t.target / nullif(t.s, 0)), 0) * t.s as rest
      from d join t on d.source is not distinct from t.source),
f0 as (select *, rest > 1e-6 and sum(size) over (partition by source order by u, doc_id rows unbounded preceding)
              <= rest + 1e-6 as got from c),
{_fill_sql('got', 'rest', 'rest > 1e-6', 'a', 'f0', mixing.FILLS - 1)},
s1 as (select *, rest - sum(case when got then size else 0 end) over (partition by source) as short,
              row_number() over (partition by source order by rest > 1e-6 and not got and size > 0 desc, size, u, doc_id) = 1
                and rest > 1e-6 and not got and size > 0 as picked from af{mixing.FILLS - 2}),
s2 as (select *, sum(case when picked then size end) over (partition by source) - short as over_, false as back from s1),
{_fill_sql('back', 'over_', 'got', 'b', 's2', mixing.FILLS)},
s3 as (select *, coalesce(over_ - sum(case when back then size else 0 end) over (partition by source) < short - 1e-6, false)
              as better from bf{mixing.FILLS - 1})
select doc_id, size, source_size, target,
       (size * (whole + case when (got and not (better and back)) or (better and picked) then 1 else 0 end))::bigint as taken
from s3""")
def op6_mix_sources(spark, sf):
    return mixing.mix(load_table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op8_exact_dedup", """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)""")
def op8_exact_dedup(spark, sf):
    return cuckoo.exact_groups(load_table(spark, sf, "documents"))


@query("op9_line_dedup")
def op9_line_dedup(spark, sf):
    """Lines dropped from each document and the digest of what is left."""
    text = F.coalesce("text", F.lit(""))
    return lines.drop_recurring(load_table(spark, sf, "documents")).select(
        "doc_id", F.col("__n_dropped").alias("n_dropped"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


@query("op1_jaccard_join")
def op1_jaccard_join(spark, sf):
    return jaccard.similar_groups(load_table(spark, sf, "documents"), width=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf):
    return suffixes.drop_earlier_seen(load_table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_html_extraction")
def op4_html_extraction(spark, sf):
    return pages.extract_text(load_table(spark, sf, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf):
    return superkmers.drop_repeated_passages(load_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_license_scan")
def op7_license_scan(spark, sf):
    return licenses.scan_licenses(load_table(spark, sf, "documents"))


@query("op10_packing")
def op10_packing(spark, sf):
    return packing.pack(load_table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _clusters_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """Every round as a table of its own; a key holds squared distance and centroid."""
    key = (f"min((list_dot_product(e, e) - 2 * list_dot_product(e, m) + list_dot_product(m, m))::bigint * {k} + c)")
    parts = [f"""v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, e as m from v
  order by sha256('3:' || vec_id) limit {k})"""]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select vec_id, any_value(e) as e, {key} as key from v, c{i} group by vec_id)")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(n.m, c{i}.m) as m from c{i} left join (
    select c, list(floor((s - ((s % n) + n) % n) / n) order by place) as m from (
      select key % {k} as c, place, sum(x::bigint)::bigint as s, count(*) as n
      from (select key, unnest(e) as x, unnest(range({width})) as place from a{i}) group by 1, 2) group by c) n
  on c{i}.c = n.c)""")
    parts.append(f"""found as (
  select vec_id, (key % {k})::int as cluster, key // {k} as distance from a{rounds}),
final as (select c, sha256(array_to_string(list_transform(m, lambda x: x::bigint), ',')) as centroid_sha256 from c{rounds})""")
    return "with " + ",\n".join(parts) + """
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, centroid_sha256
from found join final on c = cluster"""


@query("op11_centroid_clustering", _clusters_sql())
def op11_centroid_clustering(spark, sf):
    found = centroids.cluster(load_table(spark, sf, "embeddings"))
    return found.withColumn("centroid_sha256", centroids.centroid_digest(F.col("centroid"))).drop("centroid")


@query("op12_language_id")
def op12_language_id(spark, sf):
    docs = load_table(spark, sf, "documents")
    aside = languages.held_out()
    model = languages.learn_languages(docs, ~aside & F.col("doc_id").isNotNull())
    return languages.predict_languages(docs, model).select(
        "doc_id", aside.alias("held_out"), "lang_pred", "score", "rejected")


@query("op13_hard_negatives", """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (
  select p.anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not same
   and 80 * positive_score <= 100 * score and score <= positive_score)
select * from n where rank <= 5""")
def op13_hard_negatives(spark, sf):
    shifted = load_table(spark, sf, "embeddings").withColumn(
        "label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return negatives.hard_negatives(shifted, F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark, sf):
    from corpus_pipeline import run

    return run(spark, sf)
