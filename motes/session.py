"""Session settings and the two helpers every iterative operator needs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have before it is no longer sent to every executor.
BROADCAST_ROWS = 50_000
#: About how many rows of a large join or sort a task gets.
TASK_ROWS = 500_000


def session(app: str = "motes", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE and its skew-join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on reliable storage.

    The folder is the one named by ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="motes-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which all executors share; removed when the session ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpoint(spark.range(0))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a plain table in the checkpoint folder: read back in stages of its own, so AQE may split a
    key that many rows share, and a count of it is read off the files.

    What was shuffled to make it is deleted at once; the driver's own collection of garbage may be far off.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of :func:`saved` that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it is proven to hold at most ``limit`` rows.

    Meant for aggregated tables (one row per marker, group or bucket).  At most
    ``limit + 1`` rows are fetched; a larger table is written once and read back, so the
    join that uses it becomes an ordinary shuffle join over a plain table, and nothing
    below it is computed again.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return checkpoint(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def written_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Like :func:`small_side` for a table that may well be large, as one with a row per image: it is
    worked out once, by all tasks at a time, and broadcast if it then has at most ``limit`` rows."""
    table = saved(df)
    return F.broadcast(table) if table.count() <= limit else shuffled(table)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles.

    Spark takes rows made by ``explode`` and compressed files for as small as what they are read
    from, and would gather them on the driver to broadcast them.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: float, *by: str) -> DataFrame:
    """``df`` by the hash of ``by`` in as many partitions as ``rows`` asks for, so that a task sorts about
    ``TASK_ROWS`` of them whatever their number.

    Left to itself Spark cuts a shuffle into a fixed number, and puts pieces together by their
    compressed size, of which rows of small numbers need little.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))
    return df.repartition(parts, *by)


def fits(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` holds at most ``limit`` rows; reads no further than that."""
    return df.limit(limit + 1).count() <= limit
