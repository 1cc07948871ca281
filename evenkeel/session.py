"""Session settings, scratch storage and size-checked collects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SMALL_ROWS = 200_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writes under way in a session and what the setting was before the first of them.
_WRITING: dict[int, tuple[int, str | None]] = {}
_WRITING_LOCK = threading.Lock()


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evenkeel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVENKEEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_evenkeel_scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="evenkeel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark._evenkeel_scratch = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _free_shuffles(spark: SparkSession, change: int) -> None:
    """Count the writes under way; the first one sets the setting, the last one puts back what was there."""
    with _WRITING_LOCK:
        n, before = _WRITING.get(id(spark), (0, None))
        if n == 0:
            before = spark.conf.get(FREE_SHUFFLES, None)
            spark.conf.set(FREE_SHUFFLES, "true")
        n += change
        if n:
            _WRITING[id(spark)] = (n, before)
            return
        _WRITING.pop(id(spark))
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table; it outlives lost executors.

    Nothing reads the shuffles of a written table again, so Spark deletes them when
    the write ends; otherwise they would stay on disk until the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _free_shuffles(spark, 1)
    try:
        df.write.parquet(path)
    finally:
        _free_shuffles(spark, -1)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete a table of ``write_scratch`` that nothing will read again."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if path.split("://")[-1].startswith(shared_folder(spark).split("://")[-1].rstrip("/")):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_evenkeel_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="evenkeel-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "evenkeel_package.zip"), "w", zipfile.ZIP_DEFLATED) as packed:
        for place, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(packed.filename)
    context._evenkeel_shipped = True


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that several branches read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def collect_small(df: DataFrame, what: str, max_rows: int = SMALL_ROWS) -> list:
    """Rows on the driver, or an error when there are more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows, too many for a fitted state")
    return rows

