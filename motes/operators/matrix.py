"""Anchor normalisation, scaling, thresholds and binarisation of marker matrices.

Column statistics are one row per table: they are read once and enter the plan
as constants, so scaling itself is a projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.scalars import nan_to_null, q
from motes.operators.ordering import exact_quantiles
from motes.schema import BG_PREFIX, BG_SUB, POSITIVE, RAW_MEAN, RAW_PREFIX, MarkerSchema
from motes.session import saved, small_side


def long_form(df: DataFrame, markers: list[str], keys: list[str] = ["object_id", "sample", "position"]) -> DataFrame:
    """keys, marker, value; missing values stay as NULL rows."""
    return df.select(*keys, *[q(m).cast("double").alias(m) for m in markers]).unpivot(
        keys, [q(m) for m in markers], "marker", "value")


def normalization_source(schema: MarkerSchema) -> tuple[str, dict[str, str]]:
    """Denominator column and numerator column per marker, chosen for the whole table.

    Background matrix with its own anchor column first, then raw means, then
    background-subtracted means, then the score and the plain markers.
    """
    anchor = BG_PREFIX + schema.anchor
    if anchor in schema.columns:
        return anchor, {m: BG_PREFIX + m for m in schema.valid if BG_PREFIX + m in schema.columns}
    for suffix, there in ((RAW_MEAN, schema.raw_mean), (BG_SUB, schema.bg_sub)):
        if there and schema.anchor + suffix in schema.columns:
            return schema.anchor + suffix, {m: m + suffix for m in schema.valid}
    return schema.score, {m: m for m in schema.valid}


def normalize(df: DataFrame, anchor: str, markers: dict[str, str], epsilon: float = 1e-6,
              keep: list[str] = ["object_id", "sample", "position"], own_ratio: str | None = None) -> DataFrame:
    """marker / (anchor + epsilon); missing input gives missing output."""
    den = q(anchor) + F.lit(epsilon)
    out = [(q(src) / F.nullif(den, F.lit(0.0))).alias(m) for m, src in markers.items()]
    if own_ratio:
        out.append((q(anchor) / F.nullif(den, F.lit(0.0))).alias(own_ratio))
    return df.select(*keep, *out)


def low_anchor(df: DataFrame, anchor: str, epsilon: float = 1e-6) -> DataFrame:
    return df.withColumn("low_anchor", q(anchor) < epsilon)


def low_anchor_fraction(df: DataFrame, anchor: str, epsilon: float = 1e-6) -> DataFrame:
    flag = q(anchor) < epsilon
    return df.agg(F.count("*").alias("objects"), F.count_if(flag).alias("low"),
                  F.coalesce(F.avg(flag.cast("int")), F.lit(0.0)).alias("low_fraction"))


def scale(df: DataFrame, markers: list[str], method: str = "zscore") -> DataFrame:
    """zscore (population), max or robust (median / IQR).

    A column without spread becomes 0.0 in every row, missing ones included;
    otherwise missing stays missing.
    """
    centre: dict[str, float | None]
    spread: dict[str, float | None]
    if method == "robust":
        # quantiles take several passes and the result one more: joins that lie below are worked out once
        df = saved(df)
        qs = exact_quantiles(long_form(df, markers, []), ["marker"], "value", {"a": .25, "b": .5, "c": .75})
        rows = {r["marker"]: r for r in qs.collect()}
        centre = {m: rows[m]["b"] if m in rows else None for m in markers}
        spread = {m: rows[m]["c"] - rows[m]["a"] if m in rows else None for m in markers}
    elif method in ("zscore", "max"):
        a = [F.struct(F.avg(q(m)).alias("mean"), F.stddev_pop(q(m)).alias("sd"), F.max(q(m)).alias("max"))
             .alias(str(i)) for i, m in enumerate(markers)]
        row = df.agg(*a).first()
        centre = {m: row[i]["mean"] if method == "zscore" else 0.0 for i, m in enumerate(markers)}
        spread = {m: row[i]["sd" if method == "zscore" else "max"] for i, m in enumerate(markers)}
    else:
        raise ValueError("method must be zscore, max or robust")
    out = {m: (q(m) - F.lit(centre[m])) / F.lit(spread[m]) if spread[m] else F.lit(0.0) for m in markers}
    return df.withColumns(out)


# -- thresholds --------------------------------------------------------------

def thresholds_manual(spark, markers: list[str], values: dict[str, float]) -> DataFrame:
    lacking = [m for m in markers if m not in values]
    if lacking:
        raise ValueError(f"no threshold for {lacking}")
    rows = [(m, float(values[m]), "manual") for m in markers]
    return spark.createDataFrame(rows, "marker string, threshold double, method string")


def thresholds_global(spark, markers: list[str], value: float) -> DataFrame:
    rows = [(m, float(value), "global") for m in markers]
    return spark.createDataFrame(rows, "marker string, threshold double, method string")


def thresholds_percentile(df: DataFrame, markers: list[str], percentile: float = 95.0,
                          approximate: bool = False) -> DataFrame:
    """Percentile of each marker's present values; a marker without values has a NULL threshold."""
    long = long_form(df, markers, [])
    if approximate:
        found = long.groupBy("marker").agg(F.percentile_approx("value", percentile / 100.0, 10000).alias("threshold"))
    else:
        found = exact_quantiles(long, ["marker"], "value", {"threshold": percentile / 100.0})
    names = df.sparkSession.createDataFrame([(m,) for m in markers], "marker string")
    return names.join(found, "marker", "left").withColumn("method", F.lit("percentile"))


OTSU_BINS = 256


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts between each group's min and max: keys, bin (0-based), n, lo, hi.

    The last bin is closed.  Empty bins are absent; a group without spread has one bin.
    """
    present = df.where(F.col(value).isNotNull())
    ends = small_side(present.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"),
                                                 F.max(value).cast("double").alias("hi")))
    b = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    b = F.when(F.col("hi") > F.col("lo"), F.least(b, F.lit(bins - 1))).otherwise(F.lit(0))
    return (present.join(ends, keys).withColumn("bin", b.cast("int"))
            .groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))


def otsu(hist: DataFrame, keys: list[str], bins: int = OTSU_BINS) -> DataFrame:
    """Otsu's threshold (1979) from a histogram: the bin centre with the largest
    between-class variance, the first one on a tie; a constant group gives its value."""
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    # a gap of empty bins repeats its left neighbour's variance, so occupied bins suffice
    # bin numbers instead of values keep the variance free of the values' scale
    h = hist.withColumn("_c", centre)
    up = Window.partitionBy(*keys).orderBy("bin")
    all_ = Window.partitionBy(*keys)
    first = F.col("n") * F.col("bin")
    h = h.withColumns({
        "_w1": F.sum("n").over(up).cast("double"), "_s1": F.sum(first).over(up).cast("double"),
        "_w": F.sum("n").over(all_).cast("double"), "_s": F.sum(first).over(all_).cast("double")})
    w2 = F.col("_w") - F.col("_w1")
    gap = F.col("_s1") * F.col("_w") - F.col("_s") * F.col("_w1")
    h = h.withColumn("_var", gap * gap / F.nullif(F.col("_w1") * w2, F.lit(0.0)))
    best = F.max_by(F.col("_c"), F.struct(F.col("_var"), -F.col("bin")))
    pick = F.when(F.max("hi") > F.min("lo"), best).otherwise(F.max("hi"))
    return h.where((w2 > 0) | (F.col("hi") <= F.col("lo"))).groupBy(*keys).agg(pick.alias("threshold"))


def thresholds_otsu(df: DataFrame, markers: list[str]) -> DataFrame:
    """Otsu thresholds per marker; 0.0 for a marker without values."""
    found = otsu(histogram(long_form(df, markers, []), ["marker"], "value", OTSU_BINS), ["marker"])
    names = df.sparkSession.createDataFrame([(m,) for m in markers], "marker string")
    return (names.join(found, "marker", "left").na.fill(0.0, ["threshold"])
            .withColumn("method", F.lit("otsu")))


def binarize(df: DataFrame, markers: list[str], thresholds: DataFrame,
             keep: list[str] = ["object_id", "sample", "position"]) -> DataFrame:
    """1 where value > threshold, else 0; missing is 0."""
    t = {r["marker"]: r["threshold"] for r in thresholds.where(F.col("marker").isin(markers)).collect()}
    return df.select(*keep, *[F.coalesce(q(m) > F.lit(t.get(m)).cast("double"), F.lit(False)).cast("byte").alias(m)
                              for m in markers])


# Fixed value: source values from here on are positive.
SOURCE_POSITIVE = 0.5


def binarize_source(df: DataFrame, columns: dict[str, str],
                    keep: list[str] = ["object_id", "sample", "position"]) -> tuple[DataFrame, DataFrame]:
    """1 where the source value is at least 0.5 (missing is 0), and the matching threshold table."""
    out = df.select(*keep, *[(F.coalesce(q(c), F.lit(0.0)) >= SOURCE_POSITIVE).cast("byte").alias(m)
                             for m, c in columns.items()])
    t = [(m, SOURCE_POSITIVE, "source_positive") for m in columns]
    return out, df.sparkSession.createDataFrame(t, "marker string, threshold double, method string")


def aligned(ids: DataFrame, matrix: DataFrame, fill: float | None = None) -> DataFrame:
    """Matrix rows for every id, in the ids' table; absent ones missing or ``fill``."""
    out = ids.select("object_id").join(matrix, "object_id", "left")
    return out if fill is None else out.na.fill(fill)


def median_imputed(df: DataFrame, markers: list[str]) -> DataFrame:
    """Missing cells take the marker's median; a marker without values takes 0."""
    qs = exact_quantiles(long_form(df, markers, []), ["marker"], "value", {"m": .5}).collect()
    med = {r["marker"]: r["m"] for r in qs}
    return df.withColumns({m: F.coalesce(nan_to_null(q(m).cast("double")), F.lit(med.get(m, 0.0))) for m in markers})
