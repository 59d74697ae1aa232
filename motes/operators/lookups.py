"""Pixel values under points and boxes, and mean intensities with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.scalars import nan_to_null
from motes.operators.matching import greedy_match
from motes.operators.pixels import region_properties, region_runs
from motes.operators.runs import pixels_of
from motes.session import saved

XY = ("centroid_x", "centroid_y")


def value_at(points: DataFrame, px: DataFrame, image: list[str], coords=XY, outside: str = "drop") -> DataFrame:
    """``pixel_value`` at the half-even rounded coordinate; points outside go or get 0."""
    x, y = coords
    at = points.withColumns({"_x": F.bround(F.col(x)).cast("long"), "_y": F.bround(F.col(y)).cast("long")})
    p = px.select(*image, F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"),
                  F.col("value").alias("pixel_value"))
    if outside == "drop":
        return at.join(p, [*image, "_y", "_x"]).drop("_x", "_y")
    return at.join(p, [*image, "_y", "_x"], "left").na.fill(0.0, ["pixel_value"]).drop("_x", "_y")


def _prefix_sums(px: DataFrame, image: list[str]) -> DataFrame:
    """Sum of all values above and left of a pixel, itself included (dense images)."""
    row = Window.partitionBy(*image, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy(*image, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    s = px.select(*image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"),
                  F.sum("value").over(row).alias("_s"))
    return s.select(*image, "y", "x", F.sum("_s").over(col).alias("_s"))


def box_means(boxes: DataFrame, px: DataFrame, image: list[str], key: list[str], out: str) -> DataFrame:
    """Mean over inclusive pixel boxes ``_ix1.._iy2`` (already inside the image): key columns and ``out``.

    Four look-ups in a table of prefix sums per box, so the cost does not depend on box size.
    """
    s = _prefix_sums(px, image)
    low_x, low_y = F.col("_ix1") - 1, F.col("_iy1") - 1
    corners = F.array(
        F.struct(F.col("_iy2").alias("y"), F.col("_ix2").alias("x"), F.lit(1.0).alias("w")),
        F.struct(low_y.alias("y"), F.col("_ix2").alias("x"), F.lit(-1.0).alias("w")),
        F.struct(F.col("_iy2").alias("y"), low_x.alias("x"), F.lit(-1.0).alias("w")),
        F.struct(low_y.alias("y"), low_x.alias("x"), F.lit(1.0).alias("w")))
    keys = list(dict.fromkeys([*image, *key]))
    area = (F.col("_ix2") - F.col("_ix1") + 1) * (F.col("_iy2") - F.col("_iy1") + 1)
    c = boxes.where((F.col("_ix2") >= F.col("_ix1")) & (F.col("_iy2") >= F.col("_iy1"))).select(
        *keys, area.alias("_area"), F.inline(corners)).where((F.col("x") >= 0) & (F.col("y") >= 0))
    return (c.join(s, [*image, "y", "x"]).groupBy(*keys)
            .agg((F.sum(F.col("_s") * F.col("w")) / F.first("_area")).alias(out)))


def _size(px: DataFrame, image: list[str]) -> DataFrame:
    return px.groupBy(*image).agg((F.max("y") + 1).cast("long").alias("_h"), (F.max("x") + 1).cast("long").alias("_w"))


def _inside(c: Column, top: str) -> Column:
    return F.greatest(F.lit(0), F.least(c.cast("long"), F.col(top) - 1))


def footprint_intensity(objects: DataFrame, labels: DataFrame, px: DataFrame, object_image: list[str],
                        image: list[str], id: str = "id") -> DataFrame:
    """Mean marker value over each reference object: image key, id, ``mean_intensity``, ``source``.

    Mask first; without mask pixels the box (floor/ceil, inclusive); else the 3x3
    window at the centroid.  ``image`` is the pixel table's key and may add the
    marker channel to ``object_image``; every object is measured in every channel.
    """
    extra = [c for c in image if c not in object_image]
    size = _size(px, image)
    obj = objects.join(size, object_image)
    mask = (px.join(labels.where(F.col("label") > 0).select(*object_image, "y", "x", F.col("label").alias(id)),
                    [*object_image, "y", "x"])
            .groupBy(*image, id).agg(nan_to_null(F.avg("value")).alias("_mask")))
    lo = {a: F.floor(F.least(f"bbox_{a}1", f"bbox_{a}2")) for a in "xy"}
    hi = {a: F.ceil(F.greatest(f"bbox_{a}1", f"bbox_{a}2")) for a in "xy"}
    box = obj.withColumns({
        "_ix1": _inside(lo["x"], "_w"), "_ix2": _inside(hi["x"], "_w"),
        "_iy1": _inside(lo["y"], "_h"), "_iy2": _inside(hi["y"], "_h")})
    cx = _inside(F.bround("centroid_x"), "_w")
    cy = _inside(F.bround("centroid_y"), "_h")
    win = obj.withColumns({
        "_ix1": F.greatest(cx - 1, F.lit(0)), "_ix2": F.least(cx + 1, F.col("_w") - 1),
        "_iy1": F.greatest(cy - 1, F.lit(0)), "_iy2": F.least(cy + 1, F.col("_h") - 1)})
    key = [*image, id]
    out = obj.select(*object_image, *extra, id).join(mask, key, "left")
    out = out.join(box_means(box, px, image, [id], "_box"), key, "left")
    out = out.join(box_means(win, px, image, [id], "_win"), key, "left")
    source = (F.when(F.col("_mask").isNotNull(), "mask").when(F.col("_box").isNotNull(), "bbox")
              .when(F.col("_win").isNotNull(), "window"))
    return out.select(*key, F.coalesce("_mask", "_box", "_win").alias("mean_intensity"), source.alias("source"))


def legacy_intensity(objects: DataFrame, labels: DataFrame, px: DataFrame, image: list[str], id: str = "id"
                     ) -> DataFrame:
    """Older rule: mask mean, else half-open truncated box, else the centroid pixel."""
    obj = objects.join(_size(px, image), image)
    mask = (px.join(labels.where(F.col("label") > 0).select(*image, "y", "x", F.col("label").alias(id)),
                    [*image, "y", "x"]).groupBy(*image, id).agg(F.avg("value").alias("_mask")))
    box = obj.withColumns({
        "_ix1": F.greatest(F.lit(0), F.col("bbox_x1").cast("long")),
        "_iy1": F.greatest(F.lit(0), F.col("bbox_y1").cast("long")),
        "_ix2": F.least(F.col("_w"), F.col("bbox_x2").cast("long")) - 1,
        "_iy2": F.least(F.col("_h"), F.col("bbox_y2").cast("long")) - 1})
    key = [*image, id]
    centre = value_at(obj.select(*key, *XY), px, image).select(*key, "pixel_value")
    return (obj.select(*key).join(mask, key, "left").join(box_means(box, px, image, [id], "_box"), key, "left")
            .join(centre, key, "left")
            .select(*key, F.coalesce("_mask", "_box", "pixel_value").alias("mean_intensity")))


def detection_intensity(dets: DataFrame, fg: DataFrame, px: DataFrame, image: list[str]) -> DataFrame:
    """Mean value per detection from one merged foreground mask: image, id, ``mean_intensity``.

    Regions and detections pair up by order where their numbers agree, otherwise
    greedily by centroid distance, each side once.
    """
    labels = region_runs(fg, image)
    props = saved(region_properties(labels, image).select(*image, "label", *XY))
    mean = (px.join(pixels_of(labels), [*image, "y", "x"]).groupBy(*image, "label").agg(F.avg("value").alias("mean_intensity")))
    n_d = dets.groupBy(*image).agg(F.count("*").alias("_nd"))
    n_l = props.groupBy(*image).agg(F.count("*").alias("_nl"))
    both = saved(n_d.join(n_l, image))
    equal = both.where(F.col("_nd") == F.col("_nl")).select(*image)
    other = both.where(F.col("_nd") != F.col("_nl")).select(*image)
    from motes.operators.ordering import row_numbers
    by_order = row_numbers(dets.join(equal, image, "left_semi").select(*image, "id"), image, "id", "label")
    # the matching reads both sides many times; images that lack one of them have no pairs
    d, p = saved(dets.join(other, image, "left_semi")), saved(props.join(other, image, "left_semi"))
    by_place = greedy_match(d, p.withColumnRenamed("label", "id"), image, None).select(
        *image, F.col("left_id").alias("id"), F.col("right_id").alias("label"))
    pairs = by_order.select(*image, "id", F.col("label").cast("long")).unionByName(by_place)
    return dets.select(*image, "id").join(pairs, [*image, "id"], "left").join(
        mean, [*image, "label"], "left").select(*image, "id", "mean_intensity")


def labelled_background(points: DataFrame, image: list[str], foreground_class: int = 1,
                        background_class: int = 0) -> DataFrame:
    """Annotations where a background point under a foreground one is dropped."""
    fg = points.where(F.col("class") == foreground_class)
    bg = points.where(F.col("class") == background_class)
    return fg.unionByName(bg.join(fg.select(*image, "y", "x"), [*image, "y", "x"], "left_anti"))
