"""Group profiles, crosstabs, position QC and distribution tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.scalars import distance_verdict, q
from motes.operators.matrix import histogram
from motes.operators.ordering import exact_quantiles
from motes.session import small_side


def counts(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def count_pivot(df: DataFrame, rows: str = "position", cols: str = "sample", values: list | None = None) -> DataFrame:
    """rows x cols count table, absent cells 0."""
    per = counts(df, rows, cols)
    g = per.groupBy(rows)
    return (g.pivot(cols, values) if values else g.pivot(cols)).sum("count").na.fill(0)


def means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(q(c)).alias(c) for c in columns])


def mean_by_group(matrix: DataFrame, metadata: DataFrame, group: str, markers: list[str]) -> DataFrame:
    """Means of a matrix by a metadata column (inner join on object_id)."""
    return means(matrix.select("object_id", *[q(m) for m in markers]).join(
        metadata.select("object_id", group), "object_id"), [group], markers)


def group_profile(df: DataFrame, group: str, markers: list[str]) -> DataFrame:
    """Marker means per group with a ``<group> (n=<size>)`` label; a missing group is ``nan``."""
    g = F.coalesce(q(group).cast("string"), F.lit("nan"))
    out = df.groupBy(g.alias("group")).agg(F.count("*").alias("n"), *[F.avg(q(m)).alias(m) for m in markers])
    label = F.concat(F.col("group"), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
    return out.withColumn("label", label)


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long crosstab: row, col, count and its share of the row."""
    c = counts(df, row, col)
    total = F.sum("count").over(Window.partitionBy(row))
    return c.withColumn("share", F.col("count") / total)


def channel_totals(dets: DataFrame, channel: str = "channel", flag: str = "colocalized") -> DataFrame:
    """Per channel and overall (NULL channel): detections, colocalised ones, percent to one place."""
    n, k = F.count("*"), F.count_if(q(flag))
    return dets.rollup(channel).agg(n.alias("total"), k.alias("colocalized"),
                                    F.round(F.when(n > 0, k / n * 100.0).otherwise(0.0), 1).alias("percent"))


def flag_split(dets: DataFrame, channel: str = "channel", flag: str = "colocalized") -> DataFrame:
    return dets.groupBy(channel, flag).agg(F.count("*").alias("count"))


def nearest_diagnostics(nearest: DataFrame, keys: list[str], limits: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """min, max, mean, median nearest distance, counts and shares within limits, and a verdict."""
    n = F.count("*")
    base = nearest.groupBy(*keys).agg(
        n.alias("objects"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
        F.avg("distance").alias("mean_distance"),
        *[F.count_if(F.col("distance") <= t).alias(f"within_{t}") for t in limits])
    med = exact_quantiles(nearest, keys, "distance", {"median_distance": .5})
    out = base.join(med, keys) if keys else base.join(F.broadcast(med), F.lit(True))
    out = out.withColumns({f"share_{t}": F.col(f"within_{t}") / F.col("objects") for t in limits})
    return out.withColumn("verdict", distance_verdict(F.col("mean_distance")))


def detection_summary(dets: DataFrame, keys: list[str]) -> DataFrame:
    base = dets.groupBy(*keys).agg(F.count("*").alias("count"), F.avg("area").alias("mean_area"))
    return base.join(exact_quantiles(dets, keys, "area", {"median_area": .5}), keys, "left")


def densest_cell(points: DataFrame, keys: list[str], width: float, height: float, x: str, y: str,
                 grid: int = 10) -> DataFrame:
    """Fullest cell of a grid x grid raster per group; ties go to the first in row order."""
    gx = F.least(F.floor(F.col(x) / (width / grid)), F.lit(grid - 1))
    gy = F.least(F.floor(F.col(y) / (height / grid)), F.lit(grid - 1))
    inside = (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
    per = points.where(inside).groupBy(*keys, gy.alias("gy"), gx.alias("gx")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("gy")).alias("y"), (-F.col("gx")).alias("x"))).alias("_b")
    return per.groupBy(*keys).agg(best).select(
        *keys, (-F.col("_b.x")).alias("gx"), (-F.col("_b.y")).alias("gy"), F.col("_b.n").alias("n"))


def distinct_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sorted distinct values of key columns (samples, positions, channels)."""
    return df.agg(*[F.array_sort(F.collect_set(q(c))).alias(c) for c in columns])


def quartiles(long: DataFrame, keys: list[str]) -> DataFrame:
    return exact_quantiles(long, keys, "value", {"q25": .25, "median": .5, "q75": .75})


def histogram_table(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """Occupied bins with their edges: keys, bin, n, left, right."""
    h = histogram(df, keys, value, bins)
    step = (F.col("hi") - F.col("lo")) / bins
    return h.select(*keys, "bin", "n", (F.col("lo") + F.col("bin") * step).alias("left_edge"),
                    (F.col("lo") + (F.col("bin") + 1) * step).alias("right_edge"))


def area_histogram(dets: DataFrame, value: str = "area") -> DataFrame:
    """Area histogram with ceil(sqrt(n)) bins (8 to 30), log-spaced when the largest
    area exceeds ten medians.  The last bin is closed; log bins start at 0.5 or above."""
    v = q(value).cast("double")
    s = dets.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n, lo, hi = s["n"], s["lo"] or 0.0, s["hi"] or 0.0
    med = exact_quantiles(dets, [], value, {"m": .5}).first()["m"] if n else 0.0
    bins = min(30, max(8, math.ceil(math.sqrt(n))))
    log = lo > 0 and hi / max(med, 1.0) > 10
    start = math.log10(max(lo, 0.5)) if log else lo
    step = (math.log10(hi) - start if log else (hi - lo) or 1.0) / bins
    axis = (F.log10(v) if log else v) - F.lit(start)
    b = F.least(F.floor(axis / step), F.lit(bins - 1)).cast("int")
    left, right = F.lit(start) + F.col("bin") * step, F.lit(start) + (F.col("bin") + 1) * step
    if log:
        left, right = F.pow(F.lit(10.0), left), F.pow(F.lit(10.0), right)
    counted = dets.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counted.where(F.col("bin") >= 0).select(
        "bin", "n", left.alias("left_edge"), right.alias("right_edge"), F.lit(bins).alias("bins"),
        F.lit(log).alias("log_axis"))


def display_sizes(df: DataFrame, value: str, smallest: float = 10.0, largest: float = 100.0,
                  out: str = "size") -> DataFrame:
    """Min-max scaled sizes; a constant column gets the smallest size."""
    r = df.agg(F.min(q(value)).alias("lo"), F.max(q(value)).alias("hi")).first()
    if r["lo"] is None or r["hi"] == r["lo"]:
        return df.withColumn(out, F.lit(float(smallest)))
    return df.withColumn(out, F.lit(smallest) + (q(value) - F.lit(r["lo"])) / F.lit(float(r["hi"] - r["lo"]))
                         * (largest - smallest))


def score_report(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.min(q(score)).alias("min_score"), F.max(q(score)).alias("max_score"),
                  F.avg(q(score)).alias("mean_score"))


def preview(df: DataFrame, order: list[str], rows: int = 30) -> DataFrame:
    """First rows in a stated order (a report preview)."""
    return df.orderBy(*order).limit(rows)


def position_qc(df: DataFrame, markers: list[str]) -> dict[str, DataFrame]:
    """Counts by position and by sample and position, the pivot, and means by position."""
    return {"by_position": counts(df, "position", name="object_count"),
            "by_sample_position": counts(df, "sample", "position", name="object_count"),
            "pivot": count_pivot(df), "marker_means": means(df, ["position"], markers),
            "shape_means": means(df, ["position"], ["area", "perimeter", "circularity"])}


def share_of_total(df: DataFrame, n: str, out: str, by: list[str] = []) -> DataFrame:
    """Share of a small counted table's total (or of its group's total)."""
    if by:
        return df.withColumn(out, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))
    total = small_side(df.agg(F.sum(n).alias("_t")))
    return df.join(total, F.lit(True)).withColumn(out, F.col(n) / F.col("_t")).drop("_t")
