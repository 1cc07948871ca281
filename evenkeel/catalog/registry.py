"""Registration of queries and the tables and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.columns import vector_columns
from evenkeel.sources.files import load_table
from evenkeel.spec import FeatureSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under a name; ``covers`` lists blueprint ids."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        INVENTORY[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---- tables ------------------------------------------------------------------

def customers(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("overdrawn"))


CUSTOMERS = """customers as (
  select c_custkey, c_nationkey, c_mktsegment, c_acctbal,
         case when c_acctbal < 0 then 1 else 0 end as overdrawn
  from customer)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", "value",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_error"))


EVENTS = """ev as (
  select event_id, event_type, user_id, value,
         case when event_type = 'error' then 1 else 0 end as is_error
  from events)"""


def vectors(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    return vector_columns(
        load_table(spark, folder, "embeddings").select("vec_id", "label", "embedding"),
        "embedding", width)


def vector_spec(width: int = 64, label: str = "label") -> FeatureSpec:
    return FeatureSpec(label, "vec_id", [f"x{i}" for i in range(width)])


def vectors_sql(width: int = 64) -> str:
    return f"""vec as (
  select vec_id, label, embedding[1:{width}]::double[] as e
  from embeddings)"""


PART_SPEC = FeatureSpec("p_type", "p_partkey", ["p_size", "p_retailprice"], ["p_brand"])


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "part").select(*PART_SPEC.columns)


# ---- SQL fragments -------------------------------------------------------------

def u_sql(salt, *keys: str) -> str:
    """The keyed uniform draw."""
    text = ", ".join(f"({k})::varchar" for k in keys)
    return (f"(('0x' || substr(md5(concat_ws(':', '{salt}', {text})), 1, 13))::bigint"
            f" / 4503599627370496e0)")


def shuffled_sql(salt, key: str, by: str = "", extra_keys: tuple = ()) -> str:
    """Position in the shuffled order, as ``rank_by_hash`` gives it."""
    part = f"partition by {by} " if by else ""
    keys = ", ".join([*extra_keys, key])
    return f"row_number() over ({part}order by {u_sql(salt, *extra_keys, key)}, {keys})"


def tie_rank_sql(value: str, key: str, by: str = "") -> str:
    """Ascending position with hashed ties, as ``rank_rows`` gives it."""
    part = f"partition by {by} " if by else ""
    return f"row_number() over ({part}order by {value}, {u_sql('tie', key)}, {key})"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (sums differ in the last digits between engines); -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded SQL column."""
    return f"round({expr}, {digits}) + 0e0 as {name}"
