"""Class profile and generator state kept up to date over a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.generator import fit_state, merge_state
from evenkeel.spec import FeatureSpec

STATE_SCHEMA = "g string, kind string, a string, b string, value double, batch bigint"


def _state_of(spark: SparkSession, state_path: str, batch_id: int) -> DataFrame:
    columns = STATE_SCHEMA.removesuffix(", batch bigint")
    return spark.read.schema(columns).parquet(f"{state_path.rstrip('/')}/batch={batch_id}")


def run_path(state_path: str, checkpoint: str) -> str:
    """Folder of the states that a checkpoint belongs to."""
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return f"{state_path.rstrip('/')}/run-{name}"


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest state of the stream that was started last; empty when there is none."""
    try:
        run = spark.read.schema("run string").json(f"{state_path.rstrip('/')}/current").first()["run"]
        every = spark.read.schema(STATE_SCHEMA).parquet(run)
    except Exception as error:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], STATE_SCHEMA).drop("batch")
    newest = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == F.lit(newest).cast("bigint")).drop("batch")


def stream_update(stream: DataFrame, spec: FeatureSpec, state_path: str,
                  ranges: dict[str, tuple[float, float]], checkpoint: str, bins: int = 64):
    """Merge every arriving batch into the state; returns the running query.

    Each batch writes its own folder from the folder of the batch before it, so
    a replayed batch overwrites its own result and nothing is counted twice.
    Work of a batch depends on its rows and the size of the state, not on the
    past; folders older than the last two can be deleted. The folders of a
    checkpoint stand below a name made from it, so a stream with a new checkpoint
    starts a new state and never reads an old one; the state is read as of the
    checkpoint that wrote last.
    """
    run = run_path(state_path, checkpoint)
    stream.sparkSession.createDataFrame([(run,)], "run string").write.mode("overwrite").json(
        f"{state_path.rstrip('/')}/current")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new, _ = fit_state(batch, spec, ranges, bins)
        merged = merge_state(_state_of(spark, run, batch_id - 1), new) if batch_id else new
        merged.write.mode("overwrite").parquet(f"{run}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(merge).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def class_counts_of(state: DataFrame) -> DataFrame:
    """Class profile held by a state: ``(label, n)``."""
    return state.filter(F.col("kind") == "n").select(
        F.col("g").alias("label"), F.col("value").cast("bigint").alias("n"))
