"""Registered queries over pixel tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.operators import geometry, learn, lookups, pixels as px_ops, qc, runs
from motes.plans.fixtures import DETECTIONS, PIXELS, detections, pixels
from motes.plans.objects import rounded
from motes.session import checkpoint, saved

QUERIES: dict = {}
IMG = ["image"]


def query(sql: str | None = None):
    """Register a query under its function name, with SQL that gives the same table."""
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def _q(names: dict[str, float]) -> str:
    return ", ".join(f"round(quantile_cont(value, {p}), 6) as {n}" for n, p in names.items())


@query(f"""with {PIXELS} select image, count(*) as n, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean,
  round(stddev_pop(value), 6) as std, max(y) + 1 as height, max(x) + 1 as width,
  {_q(dict(p0_5=.005, p1=.01, median=.5, p99=.99, p99_5=.995))} from pixels group by image""")
def image_stats(spark, sf):
    s = px_ops.image_stats(pixels(spark, sf), IMG)
    return rounded(s, ["min", "max", "mean", "std", "p0_5", "p1", "median", "p99", "p99_5"])


@query(f"""with {PIXELS} select class, {_q(dict(p0_5=.005, p1=.01, p5=.05, p50=.5, p95=.95, p99=.99, p99_5=.995))}
from pixels group by class""")
def percentile_ladder(spark, sf):
    s = px_ops.percentile_ladder(pixels(spark, sf), ["class"])
    return rounded(s, ["p0_5", "p1", "p5", "p50", "p95", "p99", "p99_5"])


BYTES = "bytes as (select image, class, y, x, least(255, greatest(0, floor(value * 100 + 128)))::double as value from pixels)"


def byte_pixels(spark, sf) -> DataFrame:
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("value") * 100 + 128))).cast("double")
    return pixels(spark, sf).withColumn("value", v)


@query(f"""with {PIXELS}, {BYTES} select image, cast(value as int) as bin, count(*) as n from bytes group by 1, 2""")
def image_histogram(spark, sf):
    return px_ops.value_histogram(byte_pixels(spark, sf), IMG)


@query(f"""with {PIXELS}, {BYTES}, o as (select class, value, row_number() over (partition by class order by value) - 1 as i, count(*) over (partition by class) n from bytes)
select class, max(value) filter (i = floor(n * 0.5)) as median, max(value) filter (i = floor(n * 0.01)) as p1,
  max(value) filter (i = floor(n * 0.99)) as p99 from o group by class""")
def index_percentiles(spark, sf):
    return px_ops.index_percentiles(byte_pixels(spark, sf), ["class"])


@query(f"""with {PIXELS}, s as (select image, quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b, min(value) lo, max(value) hi from pixels group by 1)
select image, round(case when a >= b then lo else a end, 6) as low, round(case when a >= b then hi else b end, 6) as high from s""")
def display_window(spark, sf):
    return rounded(px_ops.display_window(pixels(spark, sf), IMG), ["low", "high"])


@query(f"""with {PIXELS}, s as (select image, quantile_cont(value, 0.1) a, quantile_cont(value, 0.2) b, quantile_cont(value, 0.9) c from pixels group by 1)
select image, round((any_value(c) - any_value(a)) / stddev_pop(value), 4) as snr from pixels join s using (image) where value < b group by image""")
def snr(spark, sf):
    return rounded(px_ops.snr(pixels(spark, sf), IMG), ["snr"], 4)


@query(f"""with {PIXELS}, s as (select image, min(value) lo, max(value) hi from pixels group by 1)
select image, y, x, floor((value - lo) / (hi - lo) * 255)::int as out from pixels join s using (image)""")
def stretch_minmax(spark, sf):
    return px_ops.stretch(pixels(spark, sf), IMG, "minmax").select("image", "y", "x", "out")


@query(f"""with {PIXELS}, s as (select image, quantile_cont(value, 0.005) lo, quantile_cont(value, 0.995) hi from pixels group by 1)
select image, count(*) filter (floor(least(1.0, greatest(0.0, (value - lo) / (hi - lo))) * 255) >= 128) as bright,
 count(*) filter (value >= hi) as saturated from pixels join s using (image) group by image""")
def stretch_percentile(spark, sf):
    s = px_ops.stretch(pixels(spark, sf), IMG)
    return s.groupBy("image").agg(F.count_if(F.col("out") >= 128).alias("bright"), F.count_if(F.col("out") == 255).alias("saturated"))


@query(f"""with {PIXELS}, s as (select image, quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b, min(value) lo, max(value) hi from pixels group by 1)
select image, y, x, round(least(1.0, greatest(0.0, (value - a) / (b - a))) * (hi - lo) + lo, 5) as out from pixels join s using (image)""")
def linear_stretch(spark, sf):
    return rounded(px_ops.linear_stretch(pixels(spark, sf), IMG).select("image", "y", "x", "out"), ["out"], 5)


@query(f"""with {PIXELS}, {BYTES} select image, y, x, floor(power(value / 255.0, 0.5) * 255.0)::int as gamma_out,
  round_even(least(255.0, greatest(0.0, abs(value * 1.5 - 40))), 0)::int as contrast_out, case when value > 127 then 255 else 0 end as fixed_out from bytes""")
def point_operations(spark, sf):
    b = byte_pixels(spark, sf)
    out = px_ops.gamma(b, 2.0).withColumnRenamed("out", "gamma_out")
    out = px_ops.contrast(out, 1.5, -40.0).withColumnRenamed("out", "contrast_out")
    return px_ops.fixed_threshold(out, 127).withColumnRenamed("out", "fixed_out").select(
        "image", "y", "x", "gamma_out", "contrast_out", "fixed_out")


@query(f"""with {PIXELS}, e as (select class, min(value) lo, max(value) hi from pixels group by class),
h as (select class, least(cast(floor((value - lo) / (hi - lo) * 256) as int), 255) as bin, count(*) n, any_value(lo) lo, any_value(hi) hi
  from pixels join e using (class) group by 1, 2),
c as (select *, lo + (bin + 0.5) * (hi - lo) / 256 as mid from h),
w as (select *, sum(n) over (partition by class order by bin) w1, sum(n * bin) over (partition by class order by bin) s1,
      sum(n) over (partition by class) w, sum(n * bin) over (partition by class) s from c),
v as (select *, (cast(s1 as double) * cast(w as double) - cast(s as double) * cast(w1 as double)) * (cast(s1 as double) * cast(w as double) - cast(s as double) * cast(w1 as double))
  / (cast(w1 as double) * (cast(w as double) - cast(w1 as double))) as var from w where w > w1),
f as (select *, row_number() over (partition by class order by var desc, bin) k from v)
select class, round(mid, 6) as threshold from f where k = 1""")
def image_otsu(spark, sf):
    return rounded(px_ops.otsu_threshold(pixels(spark, sf), ["class"]), ["threshold"])


@query(f"""with {PIXELS}, s as (select image, min(value) lo, max(value) hi from pixels group by 1)
select image, round(avg(case when floor((value - lo) / (hi - lo) * 255) > 127 then 1.0 else 0.0 end), 6) as foreground_ratio
from pixels join s using (image) group by image""")
def foreground_ratio(spark, sf):
    return rounded(px_ops.foreground_ratio(px_ops.foreground(pixels(spark, sf), IMG, 0.5), IMG), ["foreground_ratio"])


ROWCOL = """w as (select *, lag(value) over r l, lead(value) over r rr, lag(value) over c u, lead(value) over c d from pixels
  window r as (partition by image, y order by x), c as (partition by image, x order by y))"""


@query(f"""with {PIXELS}, {ROWCOL} select image, y, x, round(coalesce(l, value) + coalesce(rr, value) + coalesce(u, value) + coalesce(d, value) - 4 * value, 5) as laplacian from w""")
def laplacian(spark, sf):
    return rounded(px_ops.laplacian(pixels(spark, sf), IMG).select("image", "y", "x", "laplacian"), ["laplacian"], 5)


@query(f"""with {PIXELS}, {ROWCOL}, s as (select class, image, var_pop(coalesce(l, value) + coalesce(rr, value) + coalesce(u, value) + coalesce(d, value) - 4 * value) as v from w group by 1, 2),
k as (select *, row_number() over (partition by class order by v desc, image) k from s) select class, image as anchor_channel from k where k = 1""")
def anchor_channel(spark, sf):
    """The sharpest image of each class."""
    s = px_ops.sharpness(pixels(spark, sf), ["class", "image"])
    return px_ops.anchor_channel(s, ["class"], "image")


@query(f"""with {PIXELS}, {ROWCOL} select image, round(var_pop(coalesce(l, value) + coalesce(rr, value) + coalesce(u, value) + coalesce(d, value) - 4 * value), 5) as sharpness from w group by image""")
def laplacian_sharpness(spark, sf):
    return rounded(px_ops.sharpness(pixels(spark, sf), IMG), ["sharpness"], 5)


@query(f"""with {PIXELS}, {ROWCOL} select image, y, x, round(sqrt(
  power(case when l is null then rr - value when rr is null then value - l else (rr - l) / 2 end, 2)
  + power(case when u is null then d - value when d is null then value - u else (d - u) / 2 end, 2)), 5) as gradient from w""")
def gradient_magnitude(spark, sf):
    return rounded(px_ops.gradient(pixels(spark, sf), IMG).select("image", "y", "x", "gradient"), ["gradient"], 5)


OFF = "o5 as (select a.i as dy, b.i as dx from range(-2, 3) a(i), range(-2, 3) b(i))"
MIRROR = "7 - abs(7 - abs({c}))"


@query(f"""with {PIXELS}, {OFF},
m as (select p.image, p.y, p.x, any_value(p.value) as value, avg(n.value) as mean from pixels p, o5 join pixels n on n.image = p.image
  and n.y = {MIRROR.format(c='p.y + dy')} and n.x = {MIRROR.format(c='p.x + dx')} group by 1, 2, 3),
v as (select p.image, p.y, p.x, any_value(p.mean) as mean, avg(power(n.value - n.mean, 2)) as var from m p, o5 join m n on n.image = p.image
  and n.y = {MIRROR.format(c='p.y + dy')} and n.x = {MIRROR.format(c='p.x + dx')} group by 1, 2, 3)
select image, y, x, round(mean, 5) as local_mean, round(var, 5) as local_variance from v""")
def box_variance(spark, sf):
    v = px_ops.local_variance5(pixels(spark, sf), IMG)
    return rounded(v.select("image", "y", "x", "local_mean", "local_variance"), ["local_mean", "local_variance"], 5)


CLAMP = "least(7, greatest(0, {c}))"


@query(f"""with {PIXELS}, g as (select i, exp(-0.5 * i * i) as w from range(-4, 5) t(i)), gs as (select i, w / (select sum(w) from g) as w from g)
select p.image, p.y, p.x, round(sum(a.w * b.w * n.value), 5) as gaussian from pixels p, gs a, gs b join pixels n on n.image = p.image
  and n.y = {CLAMP.format(c='p.y + a.i')} and n.x = {CLAMP.format(c='p.x + b.i')} group by 1, 2, 3""")
def gaussian_blur(spark, sf):
    return rounded(px_ops.gaussian(pixels(spark, sf), IMG, 1.0).select("image", "y", "x", "gaussian"), ["gaussian"], 5)


@query(f"""with {PIXELS}, o as (select a.i as dy, b.i as dx from range(-1, 2) a(i), range(-1, 2) b(i)),
e as (select p.image, p.y, p.x, any_value(p.value) as value, min(n.value) as m from pixels p, o join pixels n on n.image = p.image and n.y = p.y + dy and n.x = p.x + dx group by 1, 2, 3)
select p.image, p.y, p.x, round(max(n.m), 6) as background, round(any_value(p.value) - max(n.m), 6) as out
from e p, o join e n on n.image = p.image and n.y = p.y + dy and n.x = p.x + dx group by 1, 2, 3""")
def opened_background(spark, sf):
    b = px_ops.opened_background(pixels(spark, sf), IMG, 1)
    return rounded(b.select("image", "y", "x", "background", "out"), ["background", "out"])


@query(f"""with {PIXELS}, g as (select i, exp(-0.5 * i * i) as w from range(-4, 5) t(i)), gs as (select i, w / (select sum(w) from g) as w from g)
select p.image, p.y, p.x, round(any_value(p.value) * 1.5 - 0.5 * sum(a.w * b.w * n.value), 5) as out from pixels p, gs a, gs b join pixels n on n.image = p.image
  and n.y = {CLAMP.format(c='p.y + a.i')} and n.x = {CLAMP.format(c='p.x + b.i')} group by 1, 2, 3""")
def unsharp_mask(spark, sf):
    return rounded(px_ops.unsharp(pixels(spark, sf), IMG, 1.0, 1.5, 0.5).select("image", "y", "x", "out"), ["out"], 5)


@query(f"""with {PIXELS}, o as (select a.i as dy, b.i as dx from range(-2, 3) a(i), range(-2, 3) b(i))
select p.image, p.y, p.x, (any_value(p.value) > avg(n.value) - 0.05)::int as fg from pixels p, o join pixels n on n.image = p.image
  and n.y = {CLAMP.format(c='p.y + dy')} and n.x = {CLAMP.format(c='p.x + dx')} group by 1, 2, 3""")
def adaptive_foreground(spark, sf):
    return px_ops.adaptive_foreground(pixels(spark, sf), IMG, 5, 0.05).select("image", "y", "x", "fg")


@query(f"""with {PIXELS}, c as (select image // 3 as field, (image % 3)::varchar as channel, y, x, abs(value) as value from pixels),
m as (select field, channel, max(value) top from c group by 1, 2),
u as (select c.*, value / top as u from c join m using (field, channel))
select field, y, x, round(least(1.0, sum(u * case channel when '0' then 1.0 when '1' then 0.0 else 0.25 end)), 5) as r,
  round(least(1.0, sum(u * case channel when '0' then 0.0 when '1' then 1.0 else 0.25 end)), 5) as g,
  round(least(1.0, sum(u * case channel when '0' then 0.0 when '1' then 0.5 else 1.0 end)), 5) as b from u group by 1, 2, 3""")
def channel_composite(spark, sf):
    """Three neighbouring images as the channels of one field."""
    p = pixels(spark, sf).select(F.expr("image div 3").alias("field"), F.expr("cast(image % 3 as string)").alias("channel"),
                                 "y", "x", F.abs("value").alias("value"))
    c = px_ops.composite(p, ["field"], {"0": (1, 0, 0), "1": (0, 1, .5), "2": (.25, .25, 1)})
    return rounded(c, ["r", "g", "b"], 5)


# -- regions -------------------------------------------------------------------

FG = "fg as (select image, y, x, value from pixels where value > 0)"
REGIONS = f"""{FG}, e as (select a.image, a.y * 8 + a.x as p, b.y * 8 + b.x as q from fg a join fg b on a.image = b.image
    and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
reach as (select image, p, q from e union select r.image, r.p, e.q from reach r join e on e.image = r.image and e.p = r.q),
root as (select image, p, min(q) as root from reach group by 1, 2),
lab as (select image, p // 8 as y, p % 8 as x, dense_rank() over (partition by image order by root) as label from root)"""


def foreground(spark, sf) -> DataFrame:
    return pixels(spark, sf).where("value > 0").select("image", "y", "x")


def labels(spark, sf) -> DataFrame:
    return px_ops.components8(foreground(spark, sf), IMG)


def label_runs(spark, sf) -> DataFrame:
    """The same regions as runs; their shapes need no pixels."""
    return saved(runs.component_runs(saved(runs.runs_of(foreground(spark, sf), IMG)), IMG))


@query(f"with recursive {PIXELS}, {REGIONS} select image, y, x, label from lab")
def pixel_components(spark, sf):
    return labels(spark, sf)


PROPS = """adj as (select a.image, a.label, count(*) as n from lab a join lab b on a.image = b.image and a.label = b.label
  and ((b.x = a.x + 1 and b.y = a.y) or (b.x = a.x and b.y = a.y + 1)) group by 1, 2),
g as (select image, label, count(*) as area, avg(x) cx, avg(y) cy, min(x) x1, min(y) y1, max(x) + 1 x2, max(y) + 1 y2,
  var_pop(x) xx, var_pop(y) yy, covar_pop(x, y) xy from lab group by 1, 2),
m as (select *, (xx + yy) / 2 + sqrt(power((xx - yy) / 2, 2) + xy * xy) l1, greatest((xx + yy) / 2 - sqrt(power((xx - yy) / 2, 2) + xy * xy), 0) l2,
  4 * area - 2 * coalesce(adj.n, 0) as per from g left join adj using (image, label)),
props as (select image, label, area, cx as centroid_x, cy as centroid_y, x1 as bbox_x1, y1 as bbox_y1, x2 as bbox_x2, y2 as bbox_y2, per as perimeter_crack,
  case when l1 > 0 then l2 / l1 else 1.0 end as inertia_ratio, sqrt((l1 + 1 / 12.0) / (l2 + 1 / 12.0)) as elongation, least(1.0, 4 * pi() * area / (per * per)) as circularity from m)"""


@query(f"""with recursive {PIXELS}, {REGIONS}, {PROPS} select image, label, area, round(centroid_x, 6) as centroid_x, round(centroid_y, 6) as centroid_y,
  bbox_x1, bbox_y1, bbox_x2, bbox_y2, perimeter_crack, round(inertia_ratio, 4) as inertia_ratio, round(elongation, 4) as elongation,
  round(circularity, 6) as circularity, round(sqrt(round(1 - inertia_ratio, 9)), 4) as eccentricity from props""")
def region_properties(spark, sf):
    p = px_ops.region_properties(label_runs(spark, sf), IMG)
    p = p.withColumn("eccentricity", F.sqrt(F.round(1 - F.col("inertia_ratio"), 9)))
    return rounded(rounded(p, ["centroid_x", "centroid_y", "circularity"]), ["inertia_ratio", "eccentricity", "elongation"], 4)


@query(f"""with recursive {PIXELS}, {REGIONS} select image, label, round(avg(value), 6) as mean_intensity, round(max(value), 6) as max_intensity,
  round(stddev_pop(value), 5) as std_intensity, round(sum(value), 5) as integrated_intensity from lab join pixels using (image, y, x) group by 1, 2""")
def region_intensity(spark, sf):
    r = px_ops.region_intensity(pixels(spark, sf), labels(spark, sf), IMG)
    return rounded(rounded(r, ["mean_intensity", "max_intensity"]), ["std_intensity", "integrated_intensity"], 5)


@query(f"""with recursive {PIXELS}, {REGIONS} select image, y, x, label from lab
where (image, label) in (select (image, label) from (select image, label from lab group by 1, 2 having count(*) >= 4))""")
def drop_small_regions(spark, sf):
    return px_ops.drop_small(labels(spark, sf), IMG, 4)


@query(f"""with recursive {PIXELS}, {REGIONS}, {PROPS} select image, label, area, perimeter_crack from props
where area between 1 and 20 and area > 1 and 4 * pi() * area / (perimeter_crack * perimeter_crack) between 0.2 and 1.0 and round(inertia_ratio, 9) >= 0.15""")
def blob_filter(spark, sf):
    p = px_ops.region_properties(label_runs(spark, sf), IMG).withColumn("inertia_ratio", F.round("inertia_ratio", 9))
    return qc.blob_filter(p, area=(1, 20), circularity=(.2, 1.0), min_inertia=.15).select("image", "label", "area", "perimeter_crack")


@query(f"""with recursive {PIXELS}, {REGIONS}, {PROPS}, v as (select image, label, avg(value) as score from lab join pixels using (image, y, x) group by 1, 2)
select image, label, area, round(score, 6) as score from props join v using (image, label) where round(score, 9) >= 0.1 and area between 3 and 40""")
def score_area_filter(spark, sf):
    lab = labels(spark, sf)
    p = px_ops.region_properties(lab, IMG).join(px_ops.region_intensity(pixels(spark, sf), lab, IMG), ["image", "label"])
    p = p.withColumn("score", F.round("mean_intensity", 9))
    return rounded(qc.score_area_filter(p, .1, (3, 40)).select("image", "label", "area", "score"), ["score"])


@query(f"""with recursive {PIXELS}, s as (select image, min(value) lo, max(value) hi from pixels group by 1),
fgb as (select image, class, y, x, value from pixels join s using (image) where floor((value - lo) / (hi - lo) * 255) > 153),
{REGIONS.replace("fg as (select image, y, x, value from pixels where value > 0)", "fg as (select image, y, x, value from fgb)")}, {PROPS},
i as (select image, label, avg(value) as mi from lab join pixels using (image, y, x) group by 1, 2)
select image, label, area, round(centroid_x, 6) as centroid_x, perimeter_crack, round(mi, 6) as mean_intensity from props join i using (image, label)""")
def spot_detection(spark, sf):
    s = px_ops.spots(pixels(spark, sf), IMG, 0.6)
    return rounded(s.select("image", "label", "area", "centroid_x", "perimeter_crack", "mean_intensity"), ["centroid_x", "mean_intensity"])


@query()
def region_solidity(spark, sf):
    return px_ops.region_solidity(label_runs(spark, sf), IMG)


@query(f"""with {PIXELS}, p as (select image, class, value, ((image * 31 + y * 7 + x * 3) % 10) / 10.0 as prob from pixels)
select class, round(avg(value) filter (prob < 0.3), 6) as background_mean, count(*) filter (prob < 0.3) as background_pixels from p group by class""")
def background_intensity(spark, sf):
    p = pixels(spark, sf).withColumn("prob", F.expr("((image * 31 + y * 7 + x * 3) % 10) / 10.0"))
    return rounded(px_ops.background_intensity(p, ["class"], 0.3), ["background_mean"])


@query(f"""with {PIXELS}, s as (select image // 2 as field, image % 2 as ord, y, x, image * 10 + y // 2 as label from pixels where value > 0)
select field, y, x, arg_max(label, ord) as label from s group by 1, 2, 3""")
def stacked_labels(spark, sf):
    s = pixels(spark, sf).where("value > 0").select(F.expr("image div 2").alias("field"), F.expr("image % 2").alias("order"),
                                                    "y", "x", F.expr("image * 10 + y div 2").alias("label"))
    return px_ops.stacked_labels(s, ["field"])


# -- look-ups ------------------------------------------------------------------

# detections placed on the small images: coordinates in eighths of the field
ONPX = f"""{DETECTIONS}, onpx as (select image, id, channel, centroid_x / 12.5 as centroid_x, centroid_y / 12.5 as centroid_y, bbox_x1 / 12.5 as bbox_x1,
  bbox_y1 / 12.5 as bbox_y1, bbox_x2 / 12.5 as bbox_x2, bbox_y2 / 12.5 as bbox_y2, area from detections)"""
BOXCOLS = ["centroid_x", "centroid_y", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]


def on_pixels(spark, sf) -> DataFrame:
    return detections(spark, sf).withColumns({c: F.col(c) / 12.5 for c in BOXCOLS})


@query(f"""with {PIXELS}, {ONPX} select d.image, d.id, round(value, 6) as pixel_value from onpx d join pixels p on p.image = d.image
  and p.x = round_even(centroid_x, 0) and p.y = round_even(centroid_y, 0)""")
def point_values(spark, sf):
    v = lookups.value_at(on_pixels(spark, sf), pixels(spark, sf), IMG)
    return rounded(v.select("image", "id", "pixel_value"), ["pixel_value"])


@query(f"""with {PIXELS}, {ONPX}, r as (select image, min(value) lo, max(value) hi from pixels group by 1),
v as (select d.image, d.id, d.area, value, lo + (hi - lo) * 0.3 as lim from onpx d left join pixels p on p.image = d.image
  and p.x = round_even(centroid_x, 0) and p.y = round_even(centroid_y, 0) left join r on r.image = d.image)
select case when area < 5 or area > 100 then 'size' when value < lim then 'intensity' else 'passed' end as reason, count(*) as count
from v where area < 5 or area > 100 or value is not null group by 1""")
def filter_reasons(spark, sf):
    r = qc.detection_reasons(on_pixels(spark, sf), pixels(spark, sf), IMG, min_size=5, max_size=100, relative_intensity=.3)
    return qc.reason_counts(r)


MASKLAB = "ml as (select image, y, x, value, case when value > 0 then id end as id from pixels p join (select image as im, min(id) as id from detections group by 1) on im = image)"


def _mask_labels(spark, sf) -> DataFrame:
    """The foreground of an image belongs to its first detection."""
    first = detections(spark, sf).groupBy("image").agg(F.min("id").alias("label"))
    return foreground(spark, sf).join(first, "image")


INSIDE = "least(7, greatest(0, {c}))"


@query(f"""with {PIXELS}, {ONPX}, {MASKLAB}, k as (select image, id, avg(value) as v from ml where id > 0 group by 1, 2),
b as (select d.image, d.id, avg(value) as v from onpx d join pixels p on p.image = d.image and p.x between {INSIDE.format(c='floor(bbox_x1)')} and {INSIDE.format(c='ceil(bbox_x2)')}
   and p.y between {INSIDE.format(c='floor(bbox_y1)')} and {INSIDE.format(c='ceil(bbox_y2)')} group by 1, 2)
select d.image, d.id, round(coalesce(k.v, b.v), 5) as mean_intensity, case when k.v is not null then 'mask' else 'bbox' end as source
from onpx d join (select distinct image from pixels) using (image) left join k using (image, id) left join b using (image, id)""")
def footprint_intensity(spark, sf):
    f = lookups.footprint_intensity(on_pixels(spark, sf), _mask_labels(spark, sf), pixels(spark, sf).drop("class"), IMG, IMG)
    return rounded(f, ["mean_intensity"], 5)


@query(f"""with {PIXELS}, {ONPX}, {MASKLAB}, k as (select image, id, avg(value) as v from ml where id > 0 group by 1, 2),
b as (select d.image, d.id, avg(value) as v from onpx d join pixels p on p.image = d.image and p.x >= trunc(bbox_x1) and p.x < least(8, trunc(bbox_x2))
   and p.y >= trunc(bbox_y1) and p.y < least(8, trunc(bbox_y2)) group by 1, 2),
c as (select d.image, d.id, value as v from onpx d join pixels p on p.image = d.image and p.x = round_even(centroid_x, 0) and p.y = round_even(centroid_y, 0))
select d.image, d.id, round(coalesce(k.v, b.v, c.v), 5) as mean_intensity from onpx d join (select distinct image from pixels) using (image)
left join k using (image, id) left join b using (image, id) left join c using (image, id)""")
def legacy_intensity(spark, sf):
    f = lookups.legacy_intensity(on_pixels(spark, sf), _mask_labels(spark, sf), pixels(spark, sf), IMG)
    return rounded(f, ["mean_intensity"], 5)


@query()
def detection_intensity(spark, sf):
    d = on_pixels(spark, sf).select("image", "id", "centroid_x", "centroid_y")
    return rounded(lookups.detection_intensity(d, foreground(spark, sf), pixels(spark, sf), IMG), ["mean_intensity"])


@query(f"""with {PIXELS}, d as (select image, k as id, (image * 7 + k * 3) % 9 as cx, (image * 5 + k * 2) % 9 as cy, 1 + (image + k) % 3 as r
    from (select distinct image from pixels), range(4) t(k)),
  run as (select image, id, y, cx - r + abs(y - cy) as x0, cx + r - abs(y - cy) as x1 from d, range(-3, 12) t(y) where abs(y - cy) <= r and id < 3)
select d.image, d.id, round(avg(value), 6) as mean_intensity from d left join run using (image, id)
  left join pixels p on p.image = d.image and p.y = run.y and p.x between run.x0 and run.x1 group by 1, 2""")
def mask_stack_intensity(spark, sf):
    """Overlapping diamonds as masks of their own, some across the border; the fourth of an image has none."""
    px = pixels(spark, sf)
    d = px.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("id")).selectExpr(
        "image", "cast(id as long) as id", "(image * 7 + id * 3) % 9 as cx", "(image * 5 + id * 2) % 9 as cy", "1 + (image + id) % 3 as r")
    m = d.where("id < 3").withColumn("y", F.explode(F.expr("sequence(cy - r, cy + r)"))).selectExpr(
        "image", "id", "y", "cx - r + abs(y - cy) as x0", "cx + r - abs(y - cy) as x1")
    return rounded(runs.mask_intensity(d, m, px, IMG), ["mean_intensity"])


# -- classifiers -------------------------------------------------------------

@query(f"""with {PIXELS.replace('pixels as', 'stored as', 1)}, mm as (select image, min(value) lo, max(value) hi from stored group by 1),
pixels as (select image, class, y, x, case when hi > 1 then (value - lo) / (hi - lo + 1e-10) else value end as value from stored join mm using (image)), {ROWCOL}, {OFF},
g as (select s, i, exp(-0.5 * i * i / (s * s)) as w from (values (1), (2), (4)) t(s), range(-16, 17) r(i) where abs(i) <= 4 * s),
gs as (select s, i, w / sum(w) over (partition by s) as w from g),
hx as (select s, p.image, p.y, p.x, sum(w * n.value) as value from pixels p, gs join pixels n on n.image = p.image and n.y = p.y and n.x = {CLAMP.format(c='p.x + gs.i')} group by 1, 2, 3, 4),
hy as (select p.s, p.image, p.y, p.x, sum(w * n.value) as value from hx p join gs on gs.s = p.s join hx n on n.s = p.s and n.image = p.image and n.x = p.x and n.y = {CLAMP.format(c='p.y + gs.i')} group by 1, 2, 3, 4),
ga as (select image, y, x, max(value) filter (s = 1) as g1, max(value) filter (s = 2) as g2, max(value) filter (s = 4) as g4 from hy group by 1, 2, 3),
m as (select p.image, p.y, p.x, any_value(p.value) as value, avg(n.value) as mean from pixels p, o5 join pixels n on n.image = p.image
  and n.y = {MIRROR.format(c='p.y + dy')} and n.x = {MIRROR.format(c='p.x + dx')} group by 1, 2, 3),
v as (select p.image, p.y, p.x, avg(power(n.value - n.mean, 2)) as var from m p, o5 join m n on n.image = p.image
  and n.y = {MIRROR.format(c='p.y + dy')} and n.x = {MIRROR.format(c='p.x + dx')} group by 1, 2, 3)
select image, y, x, round(w.value, 5) as raw, round(g1, 5) as gauss_1, round(g2, 5) as gauss_2, round(g4, 5) as gauss_4,
  round(4 * w.value - coalesce(l, w.value) - coalesce(rr, w.value) - coalesce(u, w.value) - coalesce(d, w.value), 5) as laplace, round(sqrt(
  power(case when l is null then rr - w.value when rr is null then w.value - l else (rr - l) / 2 end, 2)
  + power(case when u is null then d - w.value when d is null then w.value - u else (d - u) / 2 end, 2)), 5) as gradient_magnitude, round(var, 5) as variance_5
from w join ga using (image, y, x) join v using (image, y, x)""")
def pixel_features(spark, sf):
    f = px_ops.pixel_features(pixels(spark, sf), IMG)
    return rounded(f.select("image", "y", "x", *px_ops.FEATURES), px_ops.FEATURES, 5)


ANNOT = "a as (select image, y, x, case when (image * 5 + y * 3 + x) % 7 = 0 then 1 else 0 end as class from pixels where (image + y + x) % 5 = 0 or (image * 5 + y * 3 + x) % 7 = 0)"


def annotations(spark, sf) -> DataFrame:
    p = pixels(spark, sf).select("image", "y", "x", "value")
    fg = p.where("(image * 5 + y * 3 + x) % 7 = 0").select("image", "y", "x", F.lit(1).alias("class"))
    bg = p.where("(image + y + x) % 5 = 0").select("image", "y", "x", F.lit(0).alias("class"))
    return fg.unionByName(bg)


@query(f"with {PIXELS}, {ANNOT} select image, y, x, class from a")
def annotation_precedence(spark, sf):
    """Background points that also carry a foreground label are dropped."""
    return lookups.labelled_background(annotations(spark, sf), IMG)


@query()
def pixel_classifier(spark, sf):
    """Forest trained on annotated points, regions of the predicted foreground of all images."""
    feats = checkpoint(px_ops.pixel_features(pixels(spark, sf), IMG))
    truth = pixels(spark, sf).where("(image + y + x) % 5 = 0").select(
        "image", "y", "x", (F.col("value") > 0.1).cast("int").alias("class"))
    train = learn.pixel_training_set(feats, truth, IMG)
    model = learn.train_classifier(train, px_ops.FEATURES)
    pred = learn.predict(model, feats, px_ops.FEATURES).where("predicted = 1")
    lab = px_ops.drop_small(px_ops.components8(pred.select("image", "y", "x"), IMG), IMG, 2)
    return px_ops.region_properties(lab, IMG).groupBy("image").agg(
        F.count("*").alias("regions"), F.sum("area").alias("area"))


@query()
def object_classifier(spark, sf):
    """Forest on region features; large bright regions are the positive class."""
    lab = labels(spark, sf)
    f = checkpoint(px_ops.object_features(pixels(spark, sf), lab, IMG))
    f = f.withColumn("label_class", ((F.col("area") >= 6) & (F.col("mean_intensity") > 0.08)).cast("int"))
    model = learn.train_classifier(f, learn.OBJECT_FEATURES, "label_class")
    return learn.predict(model, f, learn.OBJECT_FEATURES).groupBy("label_class", "predicted").agg(F.count("*").alias("objects"))


@query(f"with {PIXELS} select image, y - 2 as y, x - 1 as x, round(value, 6) as value from pixels where x >= 1 and x < 6 and y >= 2 and y < 8")
def crop_pixels(spark, sf):
    c = geometry.crop(pixels(spark, sf).select("image", "y", "x", "value"), 1, 2, 6, 20, shape=(8, 8))
    return rounded(c, ["value"])
