"""Pixel tables: image statistics, stretches, stencils and connected regions.

A pixel table has image key columns, ``y``, ``x`` and ``value`` (or ``label``).
Row and column stencils are windows inside one image row or column; larger
kernels run on tiles with a rim, so no task ever holds a whole image.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from motes.functions.scalars import clip, q
from motes.operators.matrix import histogram, otsu
from motes.operators.ordering import exact_quantiles
from motes.operators.runs import component_runs, moments, numbered, pixels_of, runs_of
from motes.session import saved, small_side, written_side

TILE = 256
#: About how many pixels are handed to Python at a time.
BATCH_PIXELS = 4 * TILE * TILE


# -- statistics per image ------------------------------------------------------

def image_stats(px: DataFrame, image: list[str]) -> DataFrame:
    """n, min, max, mean, std (population), height, width and the usual percentiles."""
    base = px.groupBy(*image).agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    qs = exact_quantiles(px, image, "value", {"p0_5": .005, "p1": .01, "median": .5, "p99": .99, "p99_5": .995})
    return base.join(written_side(qs), image, "left")


def percentile_ladder(px: DataFrame, image: list[str]) -> DataFrame:
    return exact_quantiles(px, image, "value", {
        "p0_5": .005, "p1": .01, "p5": .05, "p50": .5, "p95": .95, "p99": .99, "p99_5": .995})


def index_percentiles(px: DataFrame, image: list[str]) -> DataFrame:
    """Median, p1 and p99 as the value at index floor(n * p) of the sorted pixels."""
    return exact_quantiles(px, image, "value", {"median": .5, "p1": .01, "p99": .99}, discrete=True)


def value_histogram(px: DataFrame, image: list[str]) -> DataFrame:
    """Counts per 8-bit value."""
    return px.groupBy(*image, F.col("value").cast("int").alias("bin")).agg(F.count("*").alias("n"))


def display_window(px: DataFrame, image: list[str]) -> DataFrame:
    """p1 and p99, or min and max where these are equal."""
    s = image_stats(px, image)
    flat = F.col("p1") >= F.col("p99")
    return s.select(*image, F.when(flat, F.col("min")).otherwise(F.col("p1")).alias("low"),
                    F.when(flat, F.col("max")).otherwise(F.col("p99")).alias("high"))


def snr(px: DataFrame, image: list[str]) -> DataFrame:
    """(p90 - p10) / population std of the pixels under p20; infinite without noise."""
    qs = written_side(exact_quantiles(px, image, "value", {"p10": .1, "p20": .2, "p90": .9}))
    dark = F.when(F.col("value") < F.col("p20"), F.col("value"))
    g = px.join(qs, image).groupBy(*image, "p10", "p90").agg(
        F.coalesce(F.stddev_pop(dark), F.stddev_pop("value")).alias("noise"))
    value = F.when(F.col("noise") == 0, F.lit(float("inf"))).otherwise(
        (F.col("p90") - F.col("p10")) / F.nullif("noise", F.lit(0.0)))
    return g.select(*image, value.alias("snr"))


# -- point operations --------------------------------------------------------

def stretch(px: DataFrame, image: list[str], method: str = "percentile") -> DataFrame:
    """``out`` in 0..255: percentile (p0.5-p99.5), minmax or 16bit; a flat image becomes 0."""
    if method == "16bit":
        return px.withColumn("out", F.floor(clip(F.col("value") / 65535.0, 0.0, 1.0) * 255.0).cast("int"))
    if method == "minmax":
        ends = px.groupBy(*image).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    else:
        ends = exact_quantiles(px, image, "value", {"_lo": .005, "_hi": .995})
    span = F.col("_hi") - F.col("_lo")
    unit = clip((F.col("value") - F.col("_lo")) / F.nullif(span, F.lit(0.0)), 0.0, 1.0)
    out = F.when(span > 0, F.floor(unit * 255.0)).otherwise(0).cast("int")
    return px.join(written_side(ends), image).withColumn("out", out).drop("_lo", "_hi")


def linear_stretch(px: DataFrame, image: list[str]) -> DataFrame:
    """p1-p99 stretched over the image's own min-max range; a flat image stays."""
    s = exact_quantiles(px, image, "value", {"_a": .01, "_b": .99}).join(
        px.groupBy(*image).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")), image)
    span = F.col("_b") - F.col("_a")
    unit = clip((F.col("value") - F.col("_a")) / F.nullif(span, F.lit(0.0)), 0.0, 1.0)
    out = F.when(span > 0, unit * (F.col("_hi") - F.col("_lo")) + F.col("_lo")).otherwise(F.col("value"))
    return px.join(written_side(s), image).withColumn("out", out).drop("_a", "_b", "_lo", "_hi")


def gamma(px: DataFrame, g: float) -> DataFrame:
    """8-bit gamma table value."""
    return px.withColumn("out", F.floor(F.pow(F.col("value") / 255.0, F.lit(1.0 / g)) * 255.0).cast("int"))


def contrast(px: DataFrame, alpha: float, beta: float) -> DataFrame:
    """|alpha * v + beta| saturated to 0..255."""
    return px.withColumn("out", F.bround(clip(F.abs(F.col("value") * alpha + beta), 0.0, 255.0)).cast("int"))


def fixed_threshold(px: DataFrame, t: float) -> DataFrame:
    return px.withColumn("out", F.when(F.col("value") > t, 255).otherwise(0))


def otsu_threshold(px: DataFrame, image: list[str]) -> DataFrame:
    """Otsu threshold per image from 256 bins between its min and max."""
    return otsu(histogram(px, image, "value", 256), image)


def foreground(px: DataFrame, image: list[str], t: float) -> DataFrame:
    """``fg``: min-max scaled 0..255 value above int(t * 255)."""
    s = stretch(px, image, "minmax")
    return s.withColumn("fg", (F.col("out") > int(t * 255)).cast("int")).drop("out")


def foreground_ratio(fg: DataFrame, image: list[str]) -> DataFrame:
    return fg.groupBy(*image).agg(F.avg("fg").alias("foreground_ratio"))


def adaptive_foreground(px: DataFrame, image: list[str], size: int = 11, c: float = 2.0) -> DataFrame:
    """``fg``: value above the mean of its size x size surroundings minus ``c``."""
    m = tiled(px, image, size // 2, {"_m": lambda a: _box(a, size // 2)}, "edge")
    return m.withColumn("fg", (F.col("value") > F.col("_m") - c).cast("int")).drop("_m")


def composite(px: DataFrame, image: list[str], weights: dict[str, tuple[float, float, float]],
              channel: str = "channel") -> DataFrame:
    """r, g, b per pixel: weighted sum of the channels, each divided by its maximum, clipped to 1."""
    spark = px.sparkSession
    w = spark.createDataFrame([(c, *map(float, v)) for c, v in weights.items()],
                              f"{channel} string, wr double, wg double, wb double")
    top = px.groupBy(*image, channel).agg(F.max("value").alias("_top"))
    j = px.join(small_side(top), [*image, channel]).join(F.broadcast(w), channel)
    unit = F.when(F.col("_top") > 0, F.col("value") / F.nullif("_top", F.lit(0.0))).otherwise(0.0)
    return j.groupBy(*image, "y", "x").agg(*[
        F.least(F.lit(1.0), F.sum(unit * F.col(f"w{c}"))).alias(c) for c in "rgb"])


# -- stencils ------------------------------------------------------------------

def _row(image: list[str]):
    return Window.partitionBy(*image, "y").orderBy("x")


def _col(image: list[str]):
    return Window.partitionBy(*image, "x").orderBy("y")


def laplacian(px: DataFrame, image: list[str]) -> DataFrame:
    """4-neighbour Laplacian; a missing neighbour repeats the pixel itself."""
    v = F.col("value")

    def step(f, w):
        return F.coalesce(f("value", 1).over(w), v)
    out = px.withColumn("_h", step(F.lag, _row(image)) + step(F.lead, _row(image)) - 2 * v)
    return (out.withColumn("laplacian", F.col("_h") + (step(F.lag, _col(image)) + step(F.lead, _col(image)) - 2 * v))
            .drop("_h"))


def sharpness(px: DataFrame, image: list[str]) -> DataFrame:
    """Population variance of the Laplacian per image."""
    return laplacian(px, image).groupBy(*image).agg(F.var_pop("laplacian").alias("sharpness"))


def anchor_channel(sharp: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """The sharpest channel per key; ties go to the smaller name."""
    best = F.min(F.struct((-F.col("sharpness")).alias("_s"), channel)).alias("_b")
    return sharp.groupBy(*keys).agg(best).select(*keys, F.col(f"_b.{channel}").alias("anchor_channel"))


def gradient(px: DataFrame, image: list[str]) -> DataFrame:
    """Gradient magnitude: central differences, one-sided at the edges."""
    def slope(w):
        a, b = F.lag("value", 1).over(w), F.lead("value", 1).over(w)
        return (F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - F.col("value"))
                .when(b.isNull(), F.col("value") - a).otherwise((b - a) / 2))
    out = px.withColumn("_gx", slope(_row(image))).withColumn("_gy", slope(_col(image)))
    return out.withColumn("gradient", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_gx", "_gy")


def _five(df: DataFrame, value: str, out: str, w, at: str) -> DataFrame:
    """Mean of five along a window; the border mirrors without repeating the edge pixel."""
    v = F.col(value)

    def lag(n):
        return F.lag(value, n).over(w)

    def lead(n):
        return F.lead(value, n).over(w)
    first, last = F.lag(value, 1).over(w).isNull(), F.lead(value, 1).over(w).isNull()
    l1, r1 = F.coalesce(lag(1), lead(1), v), F.coalesce(lead(1), lag(1), v)
    l2 = F.coalesce(lag(2), F.when(first, lead(2)), v)
    r2 = F.coalesce(lead(2), F.when(last, lag(2)), v)
    return df.withColumn(out, (l2 + l1 + v + r1 + r2) / 5)


def box_mean5(px: DataFrame, image: list[str], value: str = "value", out: str = "local_mean") -> DataFrame:
    rows = _five(px, value, "_r", _row(image), "x")
    return _five(rows, "_r", out, _col(image), "y").drop("_r")


def local_variance5(px: DataFrame, image: list[str]) -> DataFrame:
    """5x5 mean of the squared deviation from the 5x5 mean."""
    m = box_mean5(px, image)
    d = m.withColumn("_d", (F.col("value") - F.col("local_mean")) * (F.col("value") - F.col("local_mean")))
    return box_mean5(d, image, "_d", "local_variance").drop("_d")


def tiled(px: DataFrame, image: list[str], radius: int, kernels: dict[str, Callable[[np.ndarray], np.ndarray]],
          pad: str | dict[str, str], value: str = "value", tile: int = TILE) -> DataFrame:
    """Apply array kernels of reach ``radius`` to every image, tile by tile.

    A pixel goes to its own tile and, near a tile's edge, to the neighbours that need
    it as rim.  A task holds about ``BATCH_PIXELS`` pixels at a time, whatever the image
    size; tiles of equal shape are one array, whose last two axes the kernels work on.  At the image border the tile is padded (numpy mode ``pad``, or
    ``nan`` for kernels that skip the outside).  The image is
    expected to be dense; absent pixels count as 0.
    """
    if radius > tile:
        raise ValueError("radius beyond the tile size")
    pads = pad if isinstance(pad, dict) else {k: pad for k in kernels}
    ends = written_side(px.groupBy(*image).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")))
    area = ends.agg(F.sum(F.col("_h") * F.col("_w"))).first()[0] or 0
    batches = max(px.sparkSession.sparkContext.defaultParallelism, math.ceil(area / BATCH_PIXELS))

    def targets(axis: str, size: str) -> Column:
        own, at = F.floor(F.col(axis) / tile), F.pmod(F.col(axis), F.lit(tile))
        near = F.array(F.when(at < radius, own - 1), own, F.when(at >= tile - radius, own + 1))
        return F.filter(near, lambda t: (t >= 0) & (t * tile < F.col(size)))

    # the caller's other columns travel with the pixel into its own tile only
    rest = [c for c in px.columns if c not in (*image, "y", "x")]
    home = (F.col("_ty") == F.floor(F.col("y") / tile)) & (F.col("_tx") == F.floor(F.col("x") / tile))
    held = [F.struct(*[q(c) for c in rest]).alias("_rest")] if rest else []
    cut = (px.select(*image, F.col("y").cast("long"), F.col("x").cast("long"), F.col(value).cast("double").alias("_v"), *held)
           .join(ends, image)
           .withColumn("_ty", F.explode(targets("y", "_h"))).withColumn("_tx", F.explode(targets("x", "_w"))))
    if rest:
        cut = cut.withColumn("_rest", F.when(home, F.col("_rest")))
    carried = [*image, "y", "x", *(["_rest"] if rest else [])]

    def same(t: pa.Table, which: np.ndarray, count: int) -> pa.Table:
        """``count`` tiles of one place and image size, pixel by pixel numbered by ``which``, as one array."""
        h, w, ty, tx = (t.column(c)[0].as_py() for c in ("_h", "_w", "_ty", "_tx"))
        y0, y1 = max(0, ty * tile - radius), min(h, (ty + 1) * tile + radius)
        x0, x1 = max(0, tx * tile - radius), min(w, (tx + 1) * tile + radius)
        a = np.zeros((count, y1 - y0, x1 - x0))
        ys, xs = t.column("y").to_numpy(), t.column("x").to_numpy()
        a[which, ys - y0, xs - x0] = t.column("_v").to_numpy()
        rim = ((0, 0), (radius - (ty * tile - y0), radius - (y1 - min(h, (ty + 1) * tile))),
               (radius - (tx * tile - x0), radius - (x1 - min(w, (tx + 1) * tile))))
        own = (ys // tile == ty) & (xs // tile == tx)
        res = t.filter(pa.array(own)).select(carried)
        at, py, pxx = which[own], ys[own] - y0 + rim[1][0], xs[own] - x0 + rim[2][0]
        for name, k in kernels.items():
            how = {"mode": "constant", "constant_values": np.nan} if pads[name] == "nan" else {"mode": pads[name]}
            res = res.append_column(name, pa.array(k(np.pad(a, rim, **how))[at, py, pxx], pa.float64()))
        return res

    def run(t: pa.Table) -> pa.Table:
        place = numbered(t, ["_h", "_w", "_ty", "_tx"])
        code = numbered(t, [*image, "_ty", "_tx"])
        order = np.lexsort((code, place))
        t, place, code = t.take(pa.array(order)), place[order], code[order]
        out = []
        for p in np.flatnonzero(np.r_[True, place[1:] != place[:-1]]):
            end = np.searchsorted(place, place[p], "right")
            first = np.r_[True, code[p + 1:end] != code[p:end - 1]]
            which, starts = np.cumsum(first) - 1, np.r_[np.flatnonzero(first), end - p]
            h, w = (min(t.column(c)[int(p)].as_py(), tile) + 2 * radius for c in ("_h", "_w"))
            step = max(1, (TILE * TILE) // (h * w))
            for i in range(0, len(starts) - 1, step):
                j = min(i + step, len(starts) - 1)
                lo, hi = int(starts[i]), int(starts[j])
                out.append(same(t.slice(int(p) + lo, hi - lo), which[lo:hi] - i, j - i))
        return pa.concat_tables(out)

    schema = StructType([cut.schema[c] for c in carried] + [StructField(k, DoubleType()) for k in kernels])
    out = cut.groupBy(F.pmod(F.xxhash64(*image, "_ty", "_tx"), F.lit(batches)).alias("_batch")).applyInArrow(run, schema)
    return out.select(*image, *[F.col(c).cast(px.schema[c].dataType).alias(c) for c in ("y", "x")],
                      *[F.col("_rest").getField(c).alias(c) for c in rest], *[q(k) for k in kernels])


def _along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along ``axis``, 0 or 1 of the last two."""
    r, axis = len(weights) // 2, axis - 2
    n = a.shape[axis]
    out = np.zeros_like(a)
    core = [slice(None)] * a.ndim
    core[axis] = slice(r, n - r)
    acc = 0.0
    for i, w in enumerate(weights):
        part = [slice(None)] * a.ndim
        part[axis] = slice(i, n - 2 * r + i)
        acc = acc + w * a[tuple(part)]
    out[tuple(core)] = acc
    return out


def _box(a: np.ndarray, r: int) -> np.ndarray:
    w = np.full(2 * r + 1, 1.0 / (2 * r + 1))
    return _along(_along(a, w, 0), w, 1)


def gaussian_radius(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def gaussian_kernel(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    r = gaussian_radius(sigma)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    return lambda a: _along(_along(a, w, 0), w, 1)


def gaussian(px: DataFrame, image: list[str], sigma: float, out: str = "gaussian") -> DataFrame:
    """Gaussian blur cut at four sigma; the border repeats the edge pixel."""
    return tiled(px, image, gaussian_radius(sigma), {out: gaussian_kernel(sigma)}, "edge")


def _extreme(a: np.ndarray, r: int, f) -> np.ndarray:
    for axis in (-2, -1):
        best = a.copy()
        n = a.shape[axis]
        for s in range(1, r + 1):
            for sign in (1, -1):
                src, dst = [slice(None)] * a.ndim, [slice(None)] * a.ndim
                src[axis] = slice(s, n) if sign > 0 else slice(0, n - s)
                dst[axis] = slice(0, n - s) if sign > 0 else slice(s, n)
                best[tuple(dst)] = f(best[tuple(dst)], a[tuple(src)])
        a = best
    return a


def opened_background(px: DataFrame, image: list[str], radius: int) -> DataFrame:
    """``background``: opening with a square of the given radius; ``out``: value minus it."""
    def opening(a: np.ndarray) -> np.ndarray:
        eroded = _extreme(a, radius, np.fmin)
        eroded[np.isnan(a)] = np.nan
        return _extreme(eroded, radius, np.fmax)
    b = tiled(px, image, 2 * radius, {"background": opening}, "nan")
    return b.withColumn("out", F.col("value") - F.col("background"))


def unsharp(px: DataFrame, image: list[str], sigma: float, alpha: float, beta: float) -> DataFrame:
    """alpha * value - beta * blurred value."""
    b = gaussian(px, image, sigma, "_b")
    return b.withColumn("out", F.col("value") * alpha - F.col("_b") * beta).drop("_b")


# The blur widths of the pixel features.
FEATURE_SIGMAS = (1.0, 2.0, 4.0)
FEATURES = ["raw", "gauss_1", "gauss_2", "gauss_4", "laplace", "gradient_magnitude", "variance_5"]


def pixel_features(px: DataFrame, image: list[str]) -> DataFrame:
    """The seven features of the pixel classifier on the image scaled to [0, 1] where it exceeds 1.

    All kernels share one pass over the tiles.
    """
    ends = written_side(px.groupBy(*image).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    unit = F.when(F.col("_hi") > 1.0, (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)
                  ).otherwise(F.col("value"))
    raw = px.join(ends, image).withColumn("raw", unit).drop("_lo", "_hi")

    def laplace(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        out[..., 1:-1, 1:-1] = (4 * a[..., 1:-1, 1:-1] - a[..., :-2, 1:-1] - a[..., 2:, 1:-1]
                                - a[..., 1:-1, :-2] - a[..., 1:-1, 2:])
        return out

    kernels = {f"gauss_{int(s)}": gaussian_kernel(s) for s in FEATURE_SIGMAS}
    pads = {k: "edge" for k in kernels}
    f = tiled(raw, image, gaussian_radius(max(FEATURE_SIGMAS)), {**kernels, "laplace": laplace},
              {**pads, "laplace": "symmetric"}, value="raw")
    # gradient and variance treat the border by neighbours, not by padding
    shaped = f.withColumnRenamed("value", "_value").withColumn("value", F.col("raw"))
    g = gradient(shaped, image).withColumnRenamed("gradient", "gradient_magnitude")
    v = local_variance5(g, image).withColumnRenamed("local_variance", "variance_5")
    return v.drop("value", "local_mean").withColumnRenamed("_value", "value")


# -- regions -------------------------------------------------------------------

def components8(fg: DataFrame, image: list[str]) -> DataFrame:
    """8-connected regions of a foreground pixel set: image, y, x, ``label``.

    Pixels are read once, as runs; see :func:`motes.operators.runs.component_runs`.
    """
    return pixels_of(region_runs(fg, image))


def region_runs(fg: DataFrame, image: list[str]) -> DataFrame:
    """The regions of :func:`components8` as labelled runs, written once for all that is asked of them."""
    return saved(component_runs(saved(runs_of(fg, image)), image))


def label_runs(labels: DataFrame, image: list[str]) -> DataFrame:
    """The runs of each label of a label image."""
    return runs_of(labels.where(F.col("label") > 0), [*image, "label"])


def region_properties(labels: DataFrame, image: list[str]) -> DataFrame:
    """area, centroid, bbox (max + 1), moments and the shape numbers made from them.

    ``labels`` is a label image or its runs (columns x0 and x1).  ``perimeter_crack`` counts pixel
    edges on the border of the region.
    """
    g = moments(labels if "x0" in labels.columns else label_runs(labels, image), [*image, "label"])
    mid = (F.col("_xx") + F.col("_yy")) / 2
    dev = F.sqrt(F.pow((F.col("_xx") - F.col("_yy")) / 2, 2) + F.col("_xy") * F.col("_xy"))
    g = g.withColumns({"_l1": mid + dev, "_l2": F.greatest(mid - dev, F.lit(0.0))})
    ratio = F.when(F.col("_l1") > 0, F.col("_l2") / F.nullif("_l1", F.lit(0.0))).otherwise(1.0)
    g = g.withColumn("inertia_ratio", ratio)
    p = F.col("perimeter_crack")
    return g.withColumns({
        # each pixel has an extent of its own (variance 1/12 along both axes), so a line has a finite value
        "elongation": F.sqrt((F.col("_l1") + 1 / 12) / (F.col("_l2") + 1 / 12)),
        "eccentricity": F.sqrt(1 - F.col("inertia_ratio")),
        "circularity": F.least(F.lit(1.0), 4 * math.pi * F.col("area") / (p * p)),
    }).drop("_xx", "_yy", "_xy", "_l1", "_l2")


@F.pandas_udf(DoubleType())
def _hull_area(rows: pd.Series) -> pd.Series:
    """Area of the convex hull of pixel squares, from each row's first and last x."""
    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def area(spans) -> float:
        pts = sorted({(x, y) for r in spans for y in (r["y"], r["y"] + 1) for x in (r["lo"], r["hi"] + 1)})
        hull = []
        for side in (pts, pts[::-1]):
            part = []
            for p in side:
                while len(part) > 1 and cross(part[-2], part[-1], p) <= 0:
                    part.pop()
                part.append(p)
            hull += part[:-1]
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2
    return pd.Series([area(r) for r in rows], dtype=float)


def region_solidity(labels: DataFrame, image: list[str]) -> DataFrame:
    """Region area over the area of its convex hull.  Only row ends are gathered: at
    most the image height per region."""
    runs = labels if "x0" in labels.columns else label_runs(labels, image)
    rows = runs.groupBy(*image, "label", "y").agg(
        F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    g = rows.groupBy(*image, "label").agg(
        F.sum("_n").alias("_area"), F.collect_list(F.struct("y", "lo", "hi")).alias("_rows"))
    return g.select(*image, "label", (F.col("_area") / _hull_area("_rows")).alias("solidity"))


def object_features(px: DataFrame, labels: DataFrame, image: list[str]) -> DataFrame:
    """The object classifier's features per region."""
    shapes = saved(label_runs(labels, image))
    return (region_properties(shapes, image).withColumnRenamed("perimeter_crack", "perimeter")
            .join(region_intensity(px, labels, image), [*image, "label"])
            .join(region_solidity(shapes, image), [*image, "label"]))


def drop_small(labels: DataFrame, image: list[str], min_area: int) -> DataFrame:
    keep = labels.groupBy(*image, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_area)
    return labels.join(keep.drop("_n"), [*image, "label"], "left_semi")


def stacked_labels(masks: DataFrame, image: list[str], order: str = "order") -> DataFrame:
    """Label image from per-object masks; the later object owns a shared pixel."""
    return masks.groupBy(*image, "y", "x").agg(F.max_by("label", order).alias("label"))


def region_intensity(px: DataFrame, labels: DataFrame, image: list[str]) -> DataFrame:
    """mean, max, population std and sum of the values under each label."""
    j = px.join(labels.where(F.col("label") > 0).select(*image, "y", "x", "label"), [*image, "y", "x"])
    return j.groupBy(*image, "label").agg(
        F.avg("value").alias("mean_intensity"), F.max("value").alias("max_intensity"),
        F.stddev_pop("value").alias("std_intensity"), F.sum("value").alias("integrated_intensity"))


def background_intensity(px: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean value and number of pixels whose probability lies under the threshold, per key.

    Keys without such pixels have a NULL mean and 0 pixels.
    """
    back = F.when(F.col("prob") < threshold, F.col("value"))
    return px.groupBy(*keys).agg(F.avg(back).alias("background_mean"), F.count(back).alias("background_pixels"))


def spots(px: DataFrame, image: list[str], t: float = 0.5, min_area: int = 1) -> DataFrame:
    """Spot detection: foreground, regions, region properties and mean intensities."""
    fg = foreground(px, image, t).where(F.col("fg") == 1)
    labels = components8(fg, image)
    if min_area > 1:
        labels = drop_small(labels, image, min_area)
    return region_properties(labels, image).join(region_intensity(px, labels, image), [*image, "label"])
