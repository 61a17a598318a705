"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
LARGE_FILE = 1_000_000
# For rows of megabytes: Parquet looks at what it holds after a hundred rows otherwise, and a row group is read as a whole.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; in local mode without it a temporary one that goes with the process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def materialise(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back; ``options`` are the writer's.

    Used where a result is consumed several times or carries positions that must not change
    when a task is rerun. Parquet keeps column pruning and filter push-down for the readers,
    and nothing is recomputed if executors are lost afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, label: str, *order: str) -> DataFrame:
    """``df`` written once in as many files as there are cores, or in files of ``LARGE_FILE`` rows if that is more.

    For small tables over which much is computed again and again: Spark puts few bytes into few files,
    and one file of few bytes is one task. With ``order`` the files hold ranges of these columns and are sorted.
    """
    stored = materialise(df, f"{label}-once")
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // LARGE_FILE))
    if not order and len(stored.inputFiles()) >= files:
        return stored
    dealt = stored.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else stored.repartition(files)
    return materialise(dealt, label)


def bucketed(df: DataFrame, parts: int, column: str, label: str) -> DataFrame:
    """``df`` written once in ``parts`` buckets of a column; groupings and joins by it move nothing afterwards."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    (df.repartition(parts, column).write.bucketBy(parts, column).option("path", f"{shared_root(spark)}/{name}")
     .format("parquet").saveAsTable(name))
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and ``stored`` knows them
    return stored
