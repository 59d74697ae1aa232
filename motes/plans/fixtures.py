"""The bench tables read as particle data, in Spark and as SQL text.

Only integer arithmetic places the objects, so both readings agree exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.session import shuffled

MARKERS = ["m1", "m2", "m3", "m4"]
REFERENCE = "signup"
CHANNELS = ["click", "error", "purchase", "view"]


# The key each large table is spread by.
SPREAD = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id", "embeddings": "vec_id"}
#: Rows of a partition of a table whose rows grow: an image becomes 64 pixels, and all that is asked of an image stays in its partition.
PART_ROWS = {"embeddings": 2048}
#: Most rows of the part table that Spark may send to every task if it takes them for small, by the size of their file.
SMALL_PART = 2_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A bench table.  A file with fewer splits than cores is spread by its key; a
    table that is split well already is read as it is.  Images are dealt to as many
    partitions as their number asks for, so a task holds no more of a larger table."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores, now = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    parts = max(cores, math.ceil(df.count() / PART_ROWS[name])) if name in PART_ROWS else cores
    if name in SPREAD and now < parts:
        df = df.repartition(parts, SPREAD[name])
    return df


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """One object per line item; positions, shape and four markers from its columns."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    if part.count() > SMALL_PART:
        part = shuffled(part)
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.expr("((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey").alias("object_id"),
        F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("position"),
        F.expr("cast((l_orderkey * 7919 + l_linenumber * 31) % 1009 as double)").alias("centroid_x"),
        F.expr("cast((l_orderkey * 104729 + l_partkey * 17) % 1009 as double)").alias("centroid_y"),
        F.col("p_size").cast("double").alias("area"), F.expr("sqrt(p_size) * 4").alias("perimeter"),
        F.expr("l_discount * 10").alias("circularity"), F.col("l_extendedprice").alias("pan_score"),
        F.col("l_quantity").alias("m1"), F.col("l_discount").alias("m2"), F.col("l_tax").alias("m3"),
        F.col("p_retailprice").alias("m4"))


OBJECTS = """objects as (
  select ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey as object_id,
         l_returnflag as sample, l_linestatus as position,
         cast((l_orderkey * 7919 + l_linenumber * 31) % 1009 as double) as centroid_x,
         cast((l_orderkey * 104729 + l_partkey * 17) % 1009 as double) as centroid_y,
         cast(p_size as double) as area, sqrt(p_size) * 4 as perimeter, l_discount * 10 as circularity,
         l_extendedprice as pan_score, l_quantity as m1, l_discount as m2, l_tax as m3, p_retailprice as m4
  from lineitem join part on l_partkey = p_partkey)"""

LONG = """long as (
  select object_id, sample, position, marker, value from objects
  unpivot (value for marker in (m1, m2, m3, m4)))"""


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with seven markers that are missing for more than half of them."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[
        F.avg(F.when(F.col("l_linenumber") == i, F.col("l_extendedprice"))).alias(f"L{i}") for i in range(1, 8)])
    return table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("sample"),
        F.col("o_orderstatus").alias("position"), F.col("o_totalprice").alias("pan_score"),
        *[f"L{i}" for i in range(1, 8)])


SPARSE = """sparse as (
  select o_orderkey as object_id, o_orderpriority as sample, o_orderstatus as position, o_totalprice as pan_score,
         """ + ", ".join(f"L{i}" for i in range(1, 8)) + """
  from orders left join (select l_orderkey, """ + ", ".join(
    f"avg(case when l_linenumber = {i} then l_extendedprice end) as L{i}" for i in range(1, 8)) + """
    from lineitem group by l_orderkey) on o_orderkey = l_orderkey)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as detections: a user is an image, an event type a channel."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("image"), F.col("event_type").alias("channel"), F.col("event_id").alias("id"),
        F.expr("cast((event_id * 7919) % 101 as double)").alias("centroid_x"),
        F.expr("cast((event_id * 104729) % 103 as double)").alias("centroid_y"),
        F.expr("cast((event_id * 7919) % 101 as double)").alias("bbox_x1"),
        F.expr("cast((event_id * 104729) % 103 as double)").alias("bbox_y1"),
        F.expr("cast((event_id * 7919) % 101 + 1 + event_id % 7 as double)").alias("bbox_x2"),
        F.expr("cast((event_id * 104729) % 103 + 1 + event_id % 5 as double)").alias("bbox_y2"),
        F.col("value").alias("area"), F.col("value").alias("mean_intensity"), F.col("ts"), F.col("props"))


DETECTIONS = """detections as (
  select user_id as image, event_type as channel, event_id as id,
         cast((event_id * 7919) % 101 as double) as centroid_x, cast((event_id * 104729) % 103 as double) as centroid_y,
         cast((event_id * 7919) % 101 as double) as bbox_x1, cast((event_id * 104729) % 103 as double) as bbox_y1,
         cast((event_id * 7919) % 101 + 1 + event_id % 7 as double) as bbox_x2,
         cast((event_id * 104729) % 103 + 1 + event_id % 5 as double) as bbox_y2,
         value as area, value as mean_intensity, ts, props
  from events),
refs as (select * from detections where channel = 'signup'),
marks as (select * from detections where channel <> 'signup')"""


def references(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where(F.col("channel") == REFERENCE)


def marker_detections(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where(F.col("channel") != REFERENCE)


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 images."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.col("label").alias("class"),
                                              F.posexplode("embedding").alias("pos", "v"))
    return e.select("image", "class", F.expr("pos div 8").alias("y"), F.expr("cast(pos % 8 as bigint)").alias("x"),
                    F.col("v").cast("double").alias("value"))


PIXELS = """pixels as (
  select vec_id as image, label as class, cast(i // 8 as bigint) as y, cast(i % 8 as bigint) as x,
         cast(embedding[i + 1] as double) as value
  from embeddings, range(64) r(i))"""
