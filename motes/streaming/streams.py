"""Incremental forms of the operation-log fold and of detection ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motes.operators.manifest import LOG_SCHEMA, log_state
from motes.sources.tables import folder_keys, path_keys, plain_path

DETECTION_SCHEMA = ("id string, area string, perimeter string, circularity string, centroid_x string, "
                    "centroid_y string, bbox_x1 string, bbox_y1 string, bbox_x2 string, bbox_y2 string, "
                    "score string, mean_intensity string")


def log_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Log lines of a folder as they arrive."""
    return (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder))


def running_log_state(log: DataFrame) -> DataFrame:
    """Steps and latest step per (sample, position); one state row per key."""
    return log_state(log)


def detection_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Detection rows of new files with sample, position, channel and stamp from the path."""
    raw = (spark.readStream.schema(DETECTION_SCHEMA).option("header", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*_results_*.csv").option("maxFilesPerTrigger", max_files).csv(folder))
    path = F.col("_metadata.file_path")
    return raw.withColumns(path_keys(path)).withColumn("file", folder_keys(plain_path(path))["file"])


def running_detection_counts(dets: DataFrame) -> DataFrame:
    """Rows per file stamp and channel; the newest stamp is picked when the table is read.

    State is one counter per file, never per detection.
    """
    return dets.groupBy("sample", "position", "channel", "stamp").agg(F.count("*").alias("detections"))


def newest_counts(counts: DataFrame) -> DataFrame:
    """Count of the newest file per (sample, position, channel)."""
    best = F.max(F.struct("stamp", "detections")).alias("_b")
    return counts.groupBy("sample", "position", "channel").agg(best).select(
        "sample", "position", "channel", "_b.stamp", "_b.detections")


def to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there: each batch replaces the state table with the complete result."""
    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return (df.writeStream.outputMode("complete").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).foreachBatch(save).start())


# -- tables of one row a key, renewed by batches ------------------------------

def _versions(spark: SparkSession, path: str):
    """Complete versions of a state table, oldest first, and the file system they lie in."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = jvm.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
    found = sorted(int(n[8:]) for n in names if n.startswith("version="))
    return [v for v in found if fs.exists(jvm.Path(f"{path}/version={v}/_SUCCESS"))], fs


def state_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a state table."""
    versions, _ = _versions(spark, path)
    if not versions:
        raise ValueError(f"no complete version of a state table in {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def _renewed(path: str, keys: list[str], newest: str, changed) -> callable:
    """A batch writer: of the table so far and ``changed(batch)`` the row with the largest ``newest`` stays per key.

    A batch that runs again starts from the version before it and gives the same one, so a lost batch does
    no harm; the version it started from stays until the next is complete.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions, fs = _versions(spark, path)
        before = [v for v in versions if v < number]
        rows = changed(batch)
        if before:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/version={before[-1]}").unionByName(rows)
        rest = [c for c in rows.columns if c not in keys]
        best = F.max_by(F.struct(*rest), F.col(newest)).alias("_b")
        rows.groupBy(*keys).agg(best).select(*keys, *[f"_b.{c}" for c in rest]).write.mode("overwrite").parquet(f"{path}/version={number}")
        for v in before[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)
    return save


def upsert_newest_counts(dets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep one row per (sample, position, channel): its newest file by name and that file's row count.

    A file lies in one batch as a whole, so a batch counts its files by itself and the stream holds no state;
    superseded files leave the table with the batch that brings a newer one.
    """
    keys = ["sample", "position", "channel"]

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys, "file").agg(F.count("*").alias("detections"))
    return (dets.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(_renewed(path, keys, "file", counts)).start())


def upsert_state(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row per key of a running aggregate: batches carry only the keys that changed."""
    def numbered(batch: DataFrame, number: int) -> None:
        _renewed(path, keys, "_batch", lambda b: b.withColumn("_batch", F.lit(number).cast("long")))(batch, number)
    return (df.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(numbered).start())
