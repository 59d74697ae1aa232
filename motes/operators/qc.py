"""Quality filters over object and detection tables, with their counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.functions.scalars import all_of, between_open, q


def qc_predicates(columns: list[str], *, remove_zero_area: bool = True, remove_zero_perimeter: bool = True,
                  remove_missing_circularity: bool = True, area_range: tuple | None = None,
                  circularity_range: tuple | None = None, min_score: float | None = None,
                  score_column: str | None = None, min_marker: dict[str, float] | None = None
                  ) -> dict[str, Column]:
    """Named predicates; a row passes when all hold.  Ranges are closed."""
    preds: dict[str, Column] = {}
    if remove_zero_area:
        preds["area > 0"] = F.col("area") > 0
    if remove_zero_perimeter:
        preds["perimeter > 0"] = F.col("perimeter") > 0
    if remove_missing_circularity:
        preds["circularity present"] = F.col("circularity").isNotNull()
    if area_range:
        preds["area range"] = F.col("area").between(*area_range)
    if circularity_range:
        preds["circularity range"] = F.col("circularity").between(*circularity_range)
    if min_score is not None:
        preds["score"] = q(score_column) >= min_score
    for m, low in (min_marker or {}).items():
        if m not in columns:
            raise ValueError(f"unknown marker {m}")
        preds[f"marker {m}"] = q(m) >= low
    return preds


def qc_filter(df: DataFrame, preds: dict[str, Column]) -> DataFrame:
    return df.where(all_of(list(preds.values())))


def qc_summary(df: DataFrame, preds: dict[str, Column]) -> DataFrame:
    """Rows before, after and removed, removed percent and the filter names, in one scan."""
    n, kept = F.count("*"), F.count_if(F.coalesce(all_of(list(preds.values())), F.lit(False)))
    pct = F.when(n > 0, (n - kept) / n * 100.0).otherwise(0.0)
    return df.agg(n.alias("n_before"), kept.alias("n_after"), (n - kept).alias("n_removed"),
                  pct.alias("removed_pct")).withColumn("filters", F.lit(", ".join(preds)))


def range_filter(dets: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Closed ranges with open ends on area, perimeter, circularity; missing counts as 0."""
    return dets.where(all_of([between_open(q(c), lo, hi) for c, (lo, hi) in ranges.items()]))


def sorted_detections(dets: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    if by not in ("id", "area", "perimeter", "circularity"):
        raise ValueError(f"cannot sort by {by}")
    return dets.orderBy(F.asc(by) if ascending else F.desc(by), "id")


def detection_reasons(dets: DataFrame, pixels: DataFrame, image: list[str], *, min_size: float, max_size: float,
                      relative_intensity: float, min_circularity: float = 0.3, coords=("centroid_x", "centroid_y")
                      ) -> DataFrame:
    """Detections with the first filter they fail: size, intensity, morphology, else passed.

    The intensity limit lies ``relative_intensity`` of the way up the image's own range.
    A detection of passable size that falls outside the image has a NULL reason and
    is counted nowhere.  Circularity comes from the area alone, as a filled circle,
    so morphology never fails for a positive area.
    """
    lo_hi = pixels.groupBy(*image).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x, y = coords
    at = dets.withColumns({"x": F.bround(F.col(x)).cast("int"), "y": F.bround(F.col(y)).cast("int")})
    at = at.join(pixels.select(*image, "y", "x", F.col("value").alias("_v")), [*image, "y", "x"], "left")
    at = at.join(lo_hi, image, "left")
    limit = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * relative_intensity
    perimeter = 2 * math.pi * F.sqrt(F.col("area") / math.pi)
    circ = F.when(perimeter > 0, 4 * math.pi * F.col("area") / (perimeter * perimeter)).otherwise(0.0)
    reason = (F.when((F.col("area") < min_size) | (F.col("area") > max_size), "size")
              .when(F.col("_v").isNull(), F.lit(None))
              .when(F.col("_v") < limit, "intensity")
              .when(circ < min_circularity, "morphology")
              .otherwise("passed"))
    return at.withColumn("reason", reason).drop("x", "y", "_v", "_lo", "_hi")


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("count"))


def blob_filter(regions: DataFrame, *, area: tuple[float, float], circularity: tuple[float, float],
                min_inertia: float) -> DataFrame:
    """Blobs by area, circularity 4*pi*A/P^2 and inertia ratio of their pixels.

    A single pixel has no outline to measure and is no blob.
    """
    p = F.col("perimeter_crack")
    circ = F.when(p > 0, 4 * math.pi * F.col("area") / (p * p)).otherwise(0.0)
    return (regions.withColumn("blob_circularity", circ)
            .where((F.col("area") > 1) & F.col("area").between(*area) & F.col("blob_circularity").between(*circularity)
                   & (F.col("inertia_ratio") >= min_inertia)))


def score_area_filter(regions: DataFrame, min_score: float, area: tuple[float, float]) -> DataFrame:
    return regions.where((F.col("score") >= min_score) & F.col("area").between(*area))


def only_samples(df: DataFrame, names: list[str] | None) -> DataFrame:
    return df if not names else df.where(F.col("sample").isin(names))


def restrict_to(df: DataFrame, ids: DataFrame | None, keys: list[str]) -> DataFrame:
    """Keep listed keys only; ``None`` means there is no saved list."""
    return df if ids is None else df.join(ids.select(*keys), keys, "left_semi")


def complement(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(kept.select(*keys), keys, "left_anti")
