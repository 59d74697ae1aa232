"""Coordinates, crops, transforms and one-dimensional grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.scalars import movement, movement_class
from motes.operators.ordering import piece_offsets, with_pieces
from motes.session import small_side


def coordinate_variants(points: DataFrame, height: float, width: float, pixel_size: float,
                        x: str = "x_um", y: str = "y_um") -> DataFrame:
    """Five readings of µm points as pixels: unit-converted, with axes swapped, with y
    flipped, with both, and without unit conversion."""
    px, py = F.col(x) / pixel_size, F.col(y) / pixel_size

    def variant(name: str, vx: Column, vy: Column):
        return F.struct(F.lit(name).alias("variant"), vx.alias("x_px"), vy.alias("y_px"))
    return points.select("*", F.inline(F.array(
        variant("standard", px, py), variant("xy_swapped", py, px), variant("y_flipped", px, F.lit(height) - py),
        variant("xy_swapped_y_flipped", py, F.lit(height) - px),
        variant("no_unit_conversion", F.col(x).cast("double"), F.col(y).cast("double")))))


def in_bounds(x: Column, y: Column, width: float, height: float) -> Column:
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def variant_counts(variants: DataFrame, width: float, height: float) -> DataFrame:
    inside = in_bounds(F.col("x_px"), F.col("y_px"), width, height)
    return variants.groupBy("variant").agg(F.count("*").alias("points"), F.count_if(inside).alias("in_bounds"))


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int, x: str = "x", y: str = "y",
         shape: tuple[int, int] | None = None) -> DataFrame:
    """Rows inside the half-open rectangle (clipped to shape = height, width), re-origined to it."""
    if shape:
        h, w = shape
        x0, x1, y0, y1 = max(0, x0), min(w, x1), max(0, y0), min(h, y1)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("empty rectangle")
    inside = (F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1)
    return df.where(inside).withColumns({x: F.col(x) - x0, y: F.col(y) - y0})


def movements(df: DataFrame, matrix: str = "transform", kind: str | None = None) -> DataFrame:
    m = movement(F.col(matrix), F.col(kind) if kind else None)
    return (df.withColumn("_m", m).select("*", "_m.dx", "_m.dy", "_m.magnitude").drop("_m")
            .withColumn("movement_class", movement_class(F.col("magnitude"))))


def movement_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("magnitude").alias("avg_magnitude"),
                                 F.max("magnitude").alias("max_magnitude"))


def sorted_movements(df: DataFrame, by: str = "frame", ascending: bool = True) -> DataFrame:
    if by not in ("frame", "magnitude"):
        raise ValueError(f"cannot sort by {by}")
    return df.orderBy(F.asc(by) if ascending else F.desc(by), "frame")


def shift_table(channels: DataFrame, transforms: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """Shift of every channel: the reference and channels without a transform do not move.

    ``residual_error`` is 0 for the reference and NULL where no transform exists.
    """
    t = transforms.withColumn("_has", F.lit(True))
    j = channels.join(t, [*keys, "channel"], "left")
    m = movement(F.col("transform"))
    is_ref = F.col("channel") == reference
    kind = F.when(is_ref, "reference").when(F.col("_has").isNull(), "identity").otherwise(F.col("type"))
    still = is_ref | F.col("_has").isNull() | (F.col("type") == "identity")
    out = {n: F.when(still, 0.0).otherwise(m[n]) for n in ("dx", "dy", "magnitude")}
    return j.select(*keys, "channel", kind.alias("type"), *[c.alias(n) for n, c in out.items()],
                    F.when(is_ref, 0.0).otherwise(F.col("residual_error")).alias("residual_error"))


def shift_summary(shifts: DataFrame, keys: list[str] = []) -> DataFrame:
    still = F.col("type").isin("reference", "identity")
    return shifts.groupBy(*keys).agg(F.max("magnitude").alias("max_shift"), F.count_if(~still).alias("aligned"),
                                     F.count_if(F.col("type") == "identity").alias("identity"))


def residual_error(pairs: DataFrame, matrix: list[list[float]], keys: list[str] = []) -> DataFrame:
    """Mean distance of transformed source points (sx, sy) to their targets (tx, ty)."""
    m = [[F.lit(float(v)) for v in row] for row in matrix]
    sx, sy = F.col("sx"), F.col("sy")
    w = m[2][0] * sx + m[2][1] * sy + m[2][2] if len(m) > 2 else F.lit(1.0)
    px = (m[0][0] * sx + m[0][1] * sy + m[0][2]) / w
    py = (m[1][0] * sx + m[1][1] * sy + m[1][2]) / w
    d = F.sqrt((px - F.col("tx")) * (px - F.col("tx")) + (py - F.col("ty")) * (py - F.col("ty")))
    return pairs.groupBy(*keys).agg(F.avg(d).alias("residual_error"), F.count("*").alias("points"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], path: str = "path",
                 suffix: str = r"(_aligned|_preprocessed|_registered)(?=\.[^.]+$)") -> DataFrame:
    """Registered outputs paired with the preprocessed output of the same channel."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.regexp_replace(path, suffix, "").alias("channel_file"), F.col(path).alias(name))
    return keyed(before, "before_path").join(keyed(after, "after_path"), [*keys, "channel_file"])


def gap_islands(df: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Distinct values with the island they fall in: sorted values are cut where
    neighbours differ by more than ``gap``.  Columns: keys, value, n, island.

    Each key's values lie in pieces; the last value of the earlier pieces and the
    number of their breaks carry over, so a crowded key is no single sort.
    """
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cut = with_pieces(vals, keys, value)
    ends = cut.groupBy(*keys, "_piece").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = small_side(ends.withColumn("_prev", F.max("_top").over(before)).drop("_top"))
    inside = Window.partitionBy(*keys, "_piece").orderBy(value)
    lag = F.coalesce(F.lag(value, 1).over(inside), F.col("_prev"))
    marked = cut.join(ends, [*keys, "_piece"]).withColumn(
        "_break", F.when(F.col(value) - lag > gap, 1).otherwise(0))
    offs = small_side(piece_offsets(marked, keys, F.col("_break")).drop("_in"))
    island = F.col("_before") + F.sum("_break").over(inside) + 1
    return marked.join(offs, [*keys, "_piece"]).select(*keys, value, "n", island.cast("long").alias("island"))


def gap_groups(df: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Islands of close values: keys, island, n, mean, low, high."""
    v = F.col(value)
    return gap_islands(df, keys, value, gap).groupBy(*keys, "island").agg(
        F.sum("n").alias("n"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(v).alias("low"), F.max(v).alias("high"))


def merged_lines(lines: DataFrame, keys: list[str], gap: float = 20.0, vertical: bool = False) -> DataFrame:
    """Parallel lines (x1, y1, x2, y2) closer than ``gap`` as one line each: the mean
    position (half-even rounded) and the full extent."""
    across, along = ("x", "y") if vertical else ("y", "x")
    at = lines.withColumn("_mid", (F.col(f"{across}1") + F.col(f"{across}2")) / 2.0)
    isl = gap_islands(at, keys, "_mid", gap).drop("n")
    g = at.join(isl, [*keys, "_mid"]).groupBy(*keys, "island").agg(
        F.count("*").alias("lines"), F.bround(F.avg("_mid")).cast("long").alias("position"),
        F.least(F.min(f"{along}1"), F.min(f"{along}2")).alias("low"),
        F.greatest(F.max(f"{along}1"), F.max(f"{along}2")).alias("high"))
    return g
