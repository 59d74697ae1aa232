"""Registered queries over files, manifests, transforms and texts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motes.functions import scalars
from motes.operators import geometry, manifest
from motes.plans.fixtures import DETECTIONS, MARKERS, detections, marker_detections, objects, OBJECTS, references, table
from motes.plans.objects import rounded
from motes.session import shared_path, small_side
from motes.sources import export, tables

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function name, with SQL that gives the same table."""
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


# -- geometry ------------------------------------------------------------------

@query(f"""with {OBJECTS}, v as (
  select 'standard' as variant, centroid_x / 0.21 as x, centroid_y / 0.21 as y from objects union all
  select 'xy_swapped', centroid_y / 0.21, centroid_x / 0.21 from objects union all
  select 'y_flipped', centroid_x / 0.21, 1024.0 - centroid_y / 0.21 from objects union all
  select 'xy_swapped_y_flipped', centroid_y / 0.21, 1024.0 - centroid_x / 0.21 from objects union all
  select 'no_unit_conversion', centroid_x, centroid_y from objects)
select variant, count(*) as points, count(*) filter (x >= 0 and x < 1024 and y >= 0 and y < 1024) as in_bounds from v group by 1""")
def unit_convert_bounds(spark, sf):
    pts = objects(spark, sf).select(F.col("centroid_x").alias("x_um"), F.col("centroid_y").alias("y_um"))
    return geometry.variant_counts(geometry.coordinate_variants(pts, 1024.0, 1024.0, 0.21), 1024.0, 1024.0)


@query(f"with {OBJECTS} select centroid_x as x_um, centroid_y as y_um, round(centroid_x / 0.21, 6) as x_px, round(centroid_y / 0.21, 6) as y_px from objects where m1 <> 7")
def ground_truth_points(spark, sf):
    """Points whose text coordinates are partly no numbers; those rows go."""
    bad = F.when(F.col("m1") == 7, "n/a").otherwise(F.col("centroid_x").cast("string"))
    df = objects(spark, sf).select(bad.alias("Ch1 Center of Mass X (µm)"), F.col("centroid_y").alias("Ch1 Center of Mass Y (µm)"))
    return rounded(tables.ground_truth_points(df), ["x_px", "y_px"])


@query(f"with {OBJECTS} select object_id, centroid_x - 100 as x, centroid_y - 50 as y from objects where centroid_x >= 100 and centroid_x < 1000 and centroid_y >= 50 and centroid_y < 300")
def crop_points(spark, sf):
    p = objects(spark, sf).select("object_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return geometry.crop(p, 100, 50, 2000, 300, shape=(500, 1000))


TRANSFORMS = """tr as (select o_custkey as sample, o_orderkey as frame, case when o_orderkey % 5 = 0 then 'identity' else 'affine' end as type,
  o_totalprice / 100000 as tx, case when o_orderkey % 7 = 0 then 0.0::double else (o_orderkey % 13) - 6.0::double end as ty from orders),
mv as (select *, case when type = 'identity' then 0.0::double else tx end as dx, case when type = 'identity' then 0.0::double else ty end as dy from tr)"""


def transforms(spark, sf) -> DataFrame:
    """Affine matrices per frame; some are identities, some lack their second row's shift."""
    ty = F.expr("cast(o_orderkey % 13 as double) - 6.0")
    one, zero = F.lit(1.0), F.lit(0.0)
    top = F.array(one, zero, F.col("o_totalprice") / 100000)
    low = F.when(F.col("o_orderkey") % 7 == 0, F.array(zero, one)).otherwise(F.array(zero, one, ty))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("frame"),
        F.when(F.col("o_orderkey") % 5 == 0, "identity").otherwise("affine").alias("type"),
        F.array(top, low).alias("transform"))


@query(f"""with {TRANSFORMS} select frame, round(dx, 8) as dx, round(dy, 8) as dy, round(sqrt(dx * dx + dy * dy), 6) as magnitude,
  case when sqrt(dx * dx + dy * dy) < 1 then 'low' when sqrt(dx * dx + dy * dy) < 5 then 'medium' else 'high' end as movement_class from mv""")
def movement(spark, sf):
    m = geometry.movements(transforms(spark, sf), kind="type")
    return rounded(m.select("frame", "dx", "dy", "magnitude", "movement_class").withColumns(
        {"dx": F.round("dx", 8), "dy": F.round("dy", 8)}), ["magnitude"])


@query(f"""with {TRANSFORMS} select sample, count(*) as n, round(avg(sqrt(dx * dx + dy * dy)), 6) as avg_magnitude,
  round(max(sqrt(dx * dx + dy * dy)), 6) as max_magnitude from mv group by 1""")
def movement_stats(spark, sf):
    m = geometry.movement_stats(geometry.movements(transforms(spark, sf), kind="type"), ["sample"])
    return rounded(m, ["avg_magnitude", "max_magnitude"])


SHIFTS = f"""{TRANSFORMS}, chan as (select distinct user_id as sample, event_type as channel from events),
t as (select sample, case frame % 3 when 0 then 'click' when 1 then 'view' else 'signup' end as channel, min(frame) as frame from tr group by 1, 2),
j as (select c.sample, c.channel, m.frame, m.type as ttype, m.dx, m.dy from chan c left join t on t.sample = c.sample and t.channel = c.channel left join mv m on m.frame = t.frame),
sh as (select sample, channel, case when channel = 'signup' then 'reference' when frame is null then 'identity' else ttype end as type,
  case when channel = 'signup' or frame is null then 0.0::double else dx end as dx, case when channel = 'signup' or frame is null then 0.0::double else dy end as dy,
  case when channel = 'signup' then 0.0::double when frame is not null then (frame % 10 / 4.0)::double end as residual_error from j)"""


def shift_rows(spark, sf) -> DataFrame:
    name = F.when(F.col("frame") % 3 == 0, "click").when(F.col("frame") % 3 == 1, "view").otherwise("signup")
    t = transforms(spark, sf).withColumn("channel", name)
    first = t.groupBy("sample", "channel").agg(F.min(F.struct("frame", "type", "transform")).alias("_t"))
    first = first.select("sample", "channel", "_t.type", "_t.transform", (F.col("_t.frame") % 10 / 4.0).alias("residual_error"))
    chan = detections(spark, sf).select(F.col("image").alias("sample"), "channel").distinct()
    return geometry.shift_table(chan, first, ["sample"], "signup")


@query(f"""with {SHIFTS} select sample, channel, type, round(dx, 8) as dx, round(dy, 8) as dy, round(sqrt(dx * dx + dy * dy), 6) as magnitude, residual_error from sh""")
def shift_table(spark, sf):
    return rounded(rounded(shift_rows(spark, sf), ["dx", "dy"], 8), ["magnitude"])


@query(f"""with {SHIFTS} select sample, round(max(sqrt(dx * dx + dy * dy)), 6) as max_shift, count(*) filter (type not in ('reference', 'identity')) as aligned,
  count(*) filter (type = 'identity') as identity from sh group by 1""")
def shift_summary(spark, sf):
    return rounded(geometry.shift_summary(shift_rows(spark, sf), ["sample"]), ["max_shift"])


@query(f"""with {OBJECTS} select sample, round(avg(sqrt(power(1.01 * centroid_x - 0.02 * centroid_y + 3 - centroid_y, 2)
  + power(0.02 * centroid_x + 0.99 * centroid_y - 2 - centroid_x, 2))), 6) as residual_error, count(*) as points from objects group by 1""")
def residual_error(spark, sf):
    o = objects(spark, sf).select("sample", F.col("centroid_x").alias("sx"), F.col("centroid_y").alias("sy"),
                                  F.col("centroid_y").alias("tx"), F.col("centroid_x").alias("ty"))
    m = [[1.01, -0.02, 3.0], [0.02, 0.99, -2.0], [0.0, 0.0, 1.0]]
    return rounded(geometry.residual_error(o, m, ["sample"]), ["residual_error"])


@query("""with v as (select l_returnflag as k, round(l_extendedprice, 2) as v from lineitem),
b as (select k, v, case when v - lag(v) over (partition by k order by v) > 20 then 1 else 0 end as br from v),
g as (select k, v, sum(br) over (partition by k order by v rows between unbounded preceding and current row) + 1 as island from b)
select k as sample, island::bigint as island, count(*) as n, round(avg(v), 4) as mean, min(v) as low, max(v) as high from g group by 1, 2""")
def gap_groups(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.round("l_extendedprice", 2).alias("v"))
    g = geometry.gap_groups(v, ["sample"], "v", 20.0)
    return g.select("sample", "island", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), "low", "high")


@query("""with l as (select user_id % 3 as img, (event_id * 37) % 4000 as y1, (event_id * 37) % 4000 + event_id % 3 as y2, event_id % 50 as x1, event_id % 50 + 40 as x2 from events),
m as (select *, (y1 + y2) / 2.0 as mid from l), d as (select distinct img, mid from m),
b as (select img, mid, case when mid - lag(mid) over (partition by img order by mid) > 1 then 1 else 0 end as br from d),
g as (select img, mid, sum(br) over (partition by img order by mid) + 1 as island from b)
select img, island::bigint as island, count(*) as lines, round_even(avg(mid), 0)::bigint as position, least(min(x1), min(x2)) as low, greatest(max(x1), max(x2)) as high
from m join g using (img, mid) group by 1, 2""")
def merged_lines(spark, sf):
    e = table(spark, sf, "events").select(
        F.expr("user_id % 3 as img"), F.expr("(event_id * 37) % 4000 as y1"), F.expr("(event_id * 37) % 4000 + event_id % 3 as y2"),
        F.expr("event_id % 50 as x1"), F.expr("event_id % 50 + 40 as x2"))
    return geometry.merged_lines(e, ["img"], 1.0)


# -- names and files -------------------------------------------------------------

@query("""select event_id, case event_id % 4 when 0 then 'C' || (event_id % 9) || '_ch' || (event_id % 3) when 1 then 'C' || (event_id % 9)
  else 'C' || (event_id % 5) end as channel_key from events""")
def channel_key_parse(spark, sf):
    n, c, h = F.col("event_id"), F.col("event_id") % 9, F.col("event_id") % 3
    name = (F.when(n % 4 == 0, F.concat(F.lit("s1_C"), c, F.lit("_Ch"), h, F.lit(".tif")))
            .when(n % 4 == 1, F.concat(F.lit("s1-c"), c, F.lit(".TIFF"))).otherwise("overview.tif"))
    return table(spark, sf, "events").select("event_id", tables.channel_key(name, n % 5).alias("channel_key"))


@query("""select event_id, case event_id % 4 when 0 then 'ch' || (event_id % 100) when 1 then 'ch' || (event_id % 7) when 2 then 'ch' || (event_id % 12) else event_type end as channel_id from events""")
def channel_id_parse(spark, sf):
    n = F.col("event_id")
    name = (F.when(n % 4 == 0, F.concat(F.lit("ch"), n % 100))
            .when(n % 4 == 1, F.concat(F.lit("r01c01f01p01-ch"), n % 7, F.lit("sk1fk1fl1")))
            .when(n % 4 == 2, F.concat(F.lit("plate_ch"), n % 12)).otherwise(F.col("event_type")))
    return table(spark, sf, "events").select("event_id", scalars.channel_id(name).alias("channel_id"))


@query("""with s as (select user_id, list_distinct(list('ch' || (event_id % 12))) as c from events group by 1),
o as (select user_id, unnest(c) as c from s) select user_id, string_agg(c, ',' order by substr(c, 3)::int) as combination from o group by 1""")
def combination_normalized(spark, sf):
    """Distinct channel ids of each image in numeric order (channels are few by nature)."""
    e = table(spark, sf, "events").select("user_id", F.concat(F.lit("x-ch"), F.col("event_id") % 12, F.lit("fk1")).alias("c")).distinct()
    s = e.groupBy("user_id").agg(F.collect_list("c").alias("c"))
    return s.select("user_id", F.array_join(scalars.normalized_combination(F.col("c")), ",").alias("combination"))


FILES = """files as (select user_id as sample, event_type as channel, case when event_id % 11 = 0 then 'notes_' || event_id || '.csv' when event_id % 4 = 0 then 'det_results_' || event_id || '.csv'
  when event_id % 4 = 1 then 'det_masks_' || event_id || '.npz' when event_id % 4 = 2 then 'det_overlay_' || event_id || '.png' else 'det_run_' || event_id || '.json' end as path, event_id from events)"""


def files(spark, sf) -> DataFrame:
    n = F.col("event_id")
    path = (F.when(n % 11 == 0, F.concat(F.lit("notes_"), n, F.lit(".csv"))).when(n % 4 == 0, F.concat(F.lit("det_results_"), n, F.lit(".csv")))
            .when(n % 4 == 1, F.concat(F.lit("det_masks_"), n, F.lit(".npz"))).when(n % 4 == 2, F.concat(F.lit("det_overlay_"), n, F.lit(".png")))
            .otherwise(F.concat(F.lit("det_run_"), n, F.lit(".json"))))
    return table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("channel"), path.alias("path"), "event_id")


@query(f"""with {FILES}, w as (select sample, channel, max(path) filter (path like 'det_results_%.csv') c, max(path) filter (path like '%.npz') m,
  max(path) filter (path like '%.png') o, max(path) filter (path like '%.json') r from files group by 1, 2)
select sample, channel, c as csv_path, m as masks_path, (o is not null)::int as has_overlay, (r is not null)::int as has_run, (c is not null)::int as included,
  case when c is null then 'missing_results_csv' end as skip_reason from w""")
def artefact_inventory(spark, sf):
    i = tables.artefact_inventory(files(spark, sf), ["sample", "channel"])
    flags = [F.col(c).cast("int").alias(c) for c in ("has_overlay", "has_run", "included")]
    return i.select("sample", "channel", "csv_path", "masks_path", *flags, "skip_reason")


@query(f"""with {FILES}, p as (select *, case when path like 'det_results%' then 2 when path like 'det_masks%' then 1 else 3 end as pr from files),
k as (select *, row_number() over (partition by sample, channel order by pr, path) k from p) select sample, channel, path, pr as priority from k where k = 1""")
def source_priority(spark, sf):
    p = F.when(F.col("path").startswith("det_results"), 2).when(F.col("path").startswith("det_masks"), 1).otherwise(3)
    return tables.preferred_source(files(spark, sf).withColumn("priority", p), ["sample", "channel"])


@query(f"""with {FILES.replace("event_type as channel", "case when event_type = 'error' then 'C0' else 'C' || (user_id % 3) || '_ch' || (length(event_type) % 4) end as channel")},
dim as (select 'C' || c as cycle, 'CH' || h as ch, 'M' || c || h as marker from range(2) a(c), range(3) b(h)),
w as (select sample, channel, max(path) filter (path like 'det_results_%.csv') p from files group by 1, 2)
select sample, channel, p as csv_path, coalesce(marker, '') as biomarker, (p is not null)::int as included
from w left join dim on channel like '%\\_ch%' escape '\\' and cycle = split_part(channel, '_', 1) and ch = upper(split_part(channel, '_', 2))""")
def artefact_biomarkers(spark, sf):
    """The artefact inventory with marker names; some channels are not in the dimension, some have no number."""
    f = files(spark, sf)
    name = F.concat(F.lit("C"), F.col("sample") % 3, F.lit("_ch"), F.length("channel") % 4)
    f = f.withColumn("channel", F.when(F.col("channel") == "error", "C0").otherwise(name))
    dim = spark.createDataFrame([(f"c{c}", f"Ch{h}", f"M{c}{h}") for c in range(2) for h in range(3)], "cycle string, channel string, marker string")
    i = tables.artefact_inventory(f, ["sample", "channel"], dim=dim)
    return i.select("sample", "channel", "csv_path", "biomarker", F.col("included").cast("int").alias("included"))


IMAGES = f"""images as (select event_id // 4 as sample, user_id % 2 as position, case (event_id * 7 + user_id) % 9 {' '.join(f"when {i} then '{s}'" for i, s in enumerate(tables.IMAGE_STAGES))} end as stage,
  (event_id * 7 + user_id) % 9 as place, event_type || '_' || event_id || '.tif' as path, event_id % 3 <> 0 as there from events)"""


@query(f"""with {IMAGES}, first as (select *, row_number() over (partition by sample, position order by place, path) k from images where place between 1 and 7),
tries as (select sample, position, 0 as step, path, stage from images where place = 0 and there
  union all select sample, position, 1, path, stage from first where k = 1 and there
  union all select sample, position, 2, path, stage from images where place = 8 and there),
best as (select *, row_number() over (partition by sample, position order by step, path) k from tries)
select i.sample, i.position, b.path, b.stage from (select distinct sample, position from images) i
left join (select * from best where k = 1) b on i.sample = b.sample and i.position = b.position""")
def preferred_image(spark, sf):
    place = ((F.col("event_id") * 7 + F.col("user_id")) % 9).cast("int")
    c = table(spark, sf, "events").select(
        F.expr("event_id div 4").alias("sample"), (F.col("user_id") % 2).alias("position"),
        F.get(F.array(*[F.lit(s) for s in tables.IMAGE_STAGES]), place).alias("stage"),
        F.concat_ws("", "event_type", F.lit("_"), "event_id", F.lit(".tif")).alias("path"), (F.col("event_id") % 3 != 0).alias("exists"))
    return tables.preferred_image(c, ["sample", "position"])


@query("select event_id, case event_id % 4 when 0 then 0.0::double when 1 then 0.0::double when 2 then date_diff('second', timestamp '1970-01-01', date_trunc('second', ts::timestamp)) + 0.25::double else date_diff('second', timestamp '1970-01-01', date_trunc('second', ts::timestamp))::double end as seconds from events")
def log_seconds(spark, sf):
    """Times of a log given as texts: with a zone, with a fraction, blank, or no time at all."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 4
    text = F.when(n == 0, "yesterday").when(n == 1, "").when(n == 2, F.concat(iso, F.lit(".250Z"))).otherwise(F.concat(iso, F.lit("+00:00")))
    return table(spark, sf, "events").select("event_id", scalars.epoch_or_zero(text).alias("seconds"))


@query(f"with {TRANSFORMS} select frame, round(sqrt(dx * dx + dy * dy), 6) as magnitude from mv where type <> 'identity'")
def sorted_movements(spark, sf):
    m = geometry.movements(transforms(spark, sf).where("type <> 'identity'"), kind="type")
    return rounded(geometry.sorted_movements(m, "magnitude", False).select("frame", "magnitude"), ["magnitude"])


@query("""with p as (select event_id, unnest(['gamma_correction', 'clahe_grid_size', 'threshold_method', 'other']) as name, value from events)
select event_id, name, case name when 'gamma_correction' then round(least(greatest(value, 0.1), 5.0), 6) when 'clahe_grid_size' then trunc(least(greatest(value, 2), 32)) end as number,
  case name when 'threshold_method' then 'otsu' when 'other' then 'kept' end as words from p""")
def clamped_maps(spark, sf):
    """Parameter maps clamped in place; texts and unknown names stay."""
    v = F.col("value").cast("string")
    m = F.create_map(F.lit("gamma_correction"), v, F.lit("clahe_grid_size"), v, F.lit("threshold_method"), F.lit("otsu"), F.lit("other"), F.lit("kept"))
    c = manifest.clamped_maps(table(spark, sf, "events").select("event_id", "value", m.alias("params")))
    text = F.col("name").isin("threshold_method", "other")
    return c.select("event_id", F.explode("params").alias("name", "v")).select(
        "event_id", "name", F.when(~text, F.round(F.col("v").try_cast("double"), 6)).alias("number"), F.when(text, F.col("v")).alias("words"))


@query(f"""with {OBJECTS} select object_id, sample, position, m1, m2, m3, m4, pan_score as anchor, count(*) over (partition by sample) as sample_objects from objects""")
def bundle_roundtrip(spark, sf):
    """The object table and its counts by sample as one committed CSV bundle, read back and typed."""
    o = objects(spark, sf).withColumnsRenamed({m: f"{m}_positive" for m in MARKERS})
    root = shared_path(spark)
    export.write_bundle({"objects": o, "samples": o.groupBy("sample").agg(F.count("*").alias("n"))}, root, "csv")
    back = export.read_bundle(spark, root)
    typed, schema = tables.load_objects(back["objects"])
    n = small_side(back["samples"].select("sample", F.col("n").cast("long").alias("sample_objects")))
    return typed.join(n, "sample").select("object_id", "sample", "position", *schema.markers, F.col(schema.score).alias("anchor"), "sample_objects")


@query("""with k as (select user_id as position, ts as saved_at, event_type || '_' || event_id as path, row_number() over (partition by user_id order by date_trunc('day', ts) desc, event_type || '_' || event_id desc) k from events)
select position, path, date_trunc('day', saved_at)::timestamp as saved_at from k where k = 1""")
def model_catalogue(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("position"), F.date_trunc("day", "ts").alias("saved_at"),
                                          F.concat_ws("_", "event_type", "event_id").alias("path"))
    return tables.model_catalogue(e)


@query("""select distinct 'P' || (user_id % 40) || case when event_id % 3 = 0 then '_crop' else '' end as name, (user_id % 40)::int as number,
  (event_id % 3 = 0)::int as is_crop from events where event_id % 5 <> 0""")
def sample_positions(spark, sf):
    n = F.when(F.col("event_id") % 5 == 0, "notes").otherwise(
        F.concat(F.lit("P"), F.col("user_id") % 40, F.when(F.col("event_id") % 3 == 0, "_crop").otherwise("")))
    p = tables.sample_positions(table(spark, sf, "events").select(n.alias("name")))
    return p.withColumn("is_crop", F.col("is_crop").cast("int"))


DIM = """raw as (select distinct case when user_id % 6 = 5 then 'cycle' else ' c' || (user_id % 6) end as cycle, case when event_type = 'view' then '' when event_type = 'click' then 'ch2' else '3' end as channel,
  case when event_type = 'error' then '' else event_type end as marker from events)"""


def raw_dimension(spark, sf) -> DataFrame:
    u, t = F.col("user_id") % 6, F.col("event_type")
    return table(spark, sf, "events").select(
        F.when(u == 5, "cycle").otherwise(F.concat(F.lit(" c"), u)).alias("cycle"),
        F.when(t == "view", "").when(t == "click", "ch2").otherwise("3").alias("channel"),
        F.when(t == "error", "").otherwise(t).alias("marker")).distinct()


@query(f"""with {DIM} select upper(trim(cycle)) as cycle, case channel when 'ch2' then 'CH2' else 'CH3' end as channel, marker, 'keep' as variant from raw where channel <> '' and trim(cycle) <> 'cycle'
union all select upper(trim(cycle)), case channel when '' then 'CH1' when 'ch2' then 'CH2' else 'CH3' end, marker, 'default' from raw where marker <> '' and trim(cycle) <> 'cycle'""")
def marker_dimension(spark, sf):
    d = raw_dimension(spark, sf)
    return tables.marker_dimension(d).withColumn("variant", F.lit("keep")).union(
        tables.marker_dimension(d, "CH1").withColumn("variant", F.lit("default")))


@query("""select event_id, 'C' || (user_id % 7) as cycle, case when user_id % 7 < 5 and event_type in ('click', 'purchase', 'signup', 'view') then event_type else '' end as marker from events""")
def marker_lookup(spark, sf):
    """Marker names joined by cycle and channel; unknown channels get an empty name."""
    e = table(spark, sf, "events")
    dim = e.where("user_id % 7 < 5 and event_type <> 'error'").select(
        F.concat(F.lit("C"), F.col("user_id") % 7).alias("cycle"), F.col("event_type").alias("channel"), F.col("event_type").alias("marker")).distinct()
    d = e.select("event_id", F.concat(F.lit("C"), F.col("user_id") % 7).alias("cycle"), F.col("event_type").alias("channel"))
    return tables.with_marker(d, dim).drop("channel")


@query("select event_id, case when event_id % 3 = 0 then 0.25::double when event_id % 3 = 1 then 0.5 else round(cast(regexp_extract(props, '(\\d+)', 1) as double) / 100, 6) end as threshold from events")
def run_confidence(spark, sf):
    n = F.col("event_id")
    k = F.round(F.get_json_object("props", "$.k").cast("double") / 100, 6).cast("string")
    doc = (F.when(n % 3 == 0, F.lit('{"settings": {"confidence_threshold": "0.25"}}')).when(n % 3 == 1, F.lit("{broken"))
           .otherwise(F.concat(F.lit('{"settings": {"confidence_threshold": '), k, F.lit("}}"))))
    return table(spark, sf, "events").select("event_id", tables.confidence_threshold(doc).alias("threshold"))


@query("""select user_id as image, event_id as id from events where case user_id % 6 when 0 then true when 3 then true when 4 then true
  when 5 then false else event_id % 2 = 0 end""")
def saved_filter_ids(spark, sf):
    """Detections kept by a filter document per image: off, broken or without ids (all stay), by ids
    with and without ``enabled``, as numbers and texts among other values, and by an empty list."""
    e = table(spark, sf, "events").withColumn("kind", F.col("user_id") % 6)
    text = F.when(F.col("kind") == 1, F.concat(F.lit('"'), F.col("event_id"), F.lit('.0"'))).otherwise(F.col("event_id").cast("string"))
    lists = e.groupBy(F.col("user_id").alias("image"), "kind").agg(F.array_join(F.collect_list(F.when(F.col("event_id") % 2 == 0, text)), ",").alias("ids"))
    k, ids = F.col("kind"), F.col("ids")
    doc = (F.when(k == 0, F.concat(F.lit('{"enabled": false, "objectIds": ['), ids, F.lit("]}")))
           .when(k == 1, F.concat(F.lit('{"objectIds": ["x", null, '), ids, F.lit("]}")))
           .when(k == 2, F.concat(F.lit('{"enabled": "false", "objectIds": ['), ids, F.lit("]}")))
           .when(k == 3, F.lit("{broken")).when(k == 4, F.lit('{"enabled": true}')).otherwise(F.lit('{"enabled": true, "objectIds": []}')))
    filters = tables.saved_filters(lists.select("image", doc.alias("doc")), ["image"], "doc")
    return tables.with_saved_filters(detections(spark, sf).select("image", "id"), filters, ["image"])


@query(f"""with {FILES}, b as (select sample, replace(path, '.', '_preprocessed.') as before_path from files where event_id % 4 <> 3),
a as (select sample, replace(path, '.', '_aligned.') as after_path from files where event_id % 3 = 0)
select sample, replace(before_path, '_preprocessed', '') as channel_file, before_path, after_path from b join a using (sample)
where replace(before_path, '_preprocessed', '') = replace(after_path, '_aligned', '')""")
def before_after(spark, sf):
    f = files(spark, sf)
    b = f.where("event_id % 4 <> 3").select("sample", F.replace("path", F.lit("."), F.lit("_preprocessed.")).alias("path"))
    a = f.where("event_id % 3 = 0").select("sample", F.replace("path", F.lit("."), F.lit("_aligned.")).alias("path"))
    return geometry.before_after(b, a, ["sample"])


@query("""select channel, count(*) as total, count(*) filter (event_id % 4 = 1) as colocalized from (select event_type as channel, event_id from events) group by 1""")
def legacy_scan(spark, sf):
    n = F.col("event_id")
    text = F.when(n % 4 == 1, " TRUE ").when(n % 4 == 2, "False").otherwise("yes")
    d = tables.legacy_detections(table(spark, sf, "events").select(
        F.col("event_type").alias("channel"), n.alias("object_id"), n.alias("x_coord"), n.alias("y_coord"), text.alias("colocalized")))
    return d.groupBy("channel").agg(F.count("*").alias("total"), F.count_if("colocalized").alias("colocalized"))


@query("select event_id, round(list_sum(list_transform(range(event_id % 4), lambda i: i + value)), 3) as total, (event_id % 4)::int as items from events")
def json_cell_roundtrip(spark, sf):
    """Nested cells written as JSON text and read back."""
    e = table(spark, sf, "events").withColumn("n", (F.col("event_id") % 4).cast("int"))
    cells = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), F.col("n")), lambda i: i + F.col("value"))
    text = export.json_cells(e.select("event_id", cells.alias("vals")))
    back = tables.parsed_json_cells(text, {"vals": "array<double>"})
    total = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
    return back.select("event_id", F.when(F.size("vals") > 0, F.round(total, 3)).alias("total"), F.size("vals").alias("items"))


# -- manifest --------------------------------------------------------------------

STATUS = """ev as (select user_id as image_id, ts, event_id, case event_type when 'signup' then 'recommended' when 'click' then 'approved' when 'error' then 'failed'
   when 'purchase' then 'applied' else 'cancelled' end as status, case when event_type in ('signup', 'view') then regexp_extract(props, '(\\d+)', 1) end as rec,
   case when event_type in ('click', 'purchase') then regexp_extract(props, '(\\d+)', 1) end as fin from events)"""


def manifest_events(spark, sf) -> DataFrame:
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    status = (F.when(t == "signup", "recommended").when(t == "click", "approved").when(t == "error", "failed")
              .when(t == "purchase", "applied").otherwise("cancelled"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"), "ts", "event_id", status.alias("status"),
        F.when(t.isin("signup", "view"), k).alias("recommended_params"), F.when(t.isin("click", "purchase"), k).alias("final_params"))


@query(f"""with {STATUS} select image_id, count(*) as events, arg_max(status, ts) as status, arg_max(rec, ts) filter (rec is not null) as recommended_params,
  arg_max(fin, ts) filter (fin is not null) as final_params from ev group by 1""")
def manifest_current(spark, sf):
    return manifest.current_state(manifest_events(spark, sf).drop("event_id")).drop("created_at", "updated_at")


@query(f"""with {STATUS}, h as (select image_id, event_id, rec, lag(rec) over (partition by image_id order by ts) as prev from ev where rec is not null)
select image_id, count(*) as changes, max(prev) as largest_previous from h where prev <> rec group by 1""")
def manifest_history(spark, sf):
    h = manifest.recommendation_history(manifest_events(spark, sf).drop("event_id"))
    return h.groupBy("image_id").agg(F.count("*").alias("changes"), F.max("previous").alias("largest_previous"))


@query(f"""with {STATUS}, h as (select *, last_value(rec ignore nulls) over (partition by image_id order by ts rows between unbounded preceding and current row) as r from ev)
select image_id, count(*) filter (fin is not distinct from r) as approved, count(*) filter (fin is distinct from r) as edited from h where fin is not null group by 1""")
def approvals(spark, sf):
    a = manifest.approvals(manifest_events(spark, sf).drop("event_id", "status"))
    return a.groupBy("image_id").agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "edited").alias("edited"))


@query(f"""with {STATUS}, c as (select image_id, arg_max(status, ts) as status, coalesce(arg_max(fin, ts) filter (fin is not null), arg_max(rec, ts) filter (rec is not null)) as params from ev group by 1)
select image_id, status, params from c where params is not null and status in ('recommended', 'approved', 'edited')""")
def to_process(spark, sf):
    state = manifest.current_state(manifest_events(spark, sf).drop("event_id"))
    return manifest.to_process(state).select("image_id", "status", "params")


@query(f"""with {STATUS} select image_id % 10 as run_id, count(*) as total, count(*) filter (status = 'applied') as success, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'cancelled') as cancelled, count(*) filter (status in ('recommended', 'approved')) as skipped from ev group by 1""")
def run_summary(spark, sf):
    return manifest.status_counts(manifest_events(spark, sf).withColumn("run_id", F.col("image_id") % 10), ["run_id"])


@query("select user_id % 10 as run_id, count(distinct user_id) as images, min(ts) as started, max(ts) as finished from events group by 1")
def run_list(spark, sf):
    e = manifest_events(spark, sf).withColumn("run_id", F.col("image_id") % 10)
    return manifest.run_list(e).select("run_id", "images", F.col("started").cast("timestamp_ntz").alias("started"),
                                       F.col("finished").cast("timestamp_ntz").alias("finished"))


@query("select count(*) as samples, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed from (select user_id, bool_and(event_type <> 'error') as ok from events group by 1)")
def sample_outcomes(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type") != "error").alias("ok"))
    return manifest.sample_outcomes(s)


@query("""with p as (select event_id, case event_type when 'click' then 'gamma_correction' when 'view' then 'clahe_grid_size' when 'error' then 'threshold_method'
  when 'signup' then 'brightness_beta' else 'custom' end as name, case when event_type = 'error' then case when event_id % 2 = 0 then 'otsu' else 'magic' end
  when event_id % 13 = 0 then 'abc' else cast(value as varchar) end as value, value as v, event_id % 13 = 0 as bad from events)
select event_id, name, case when name = 'threshold_method' then case when value = 'magic' then 'not allowed' end when name <> 'custom' and bad then 'not a number' end as error,
  round(case when bad or name in ('custom', 'threshold_method') then null when name = 'gamma_correction' then least(greatest(v, 0.1), 5.0)
   when name = 'clahe_grid_size' then least(greatest(floor(v), 2), 32) else least(greatest(floor(v), -100), 100) end, 6) as number, (name <> 'custom')::int as known from p""")
def param_clamp(spark, sf):
    t, n = F.col("event_type"), F.col("event_id")
    name = (F.when(t == "click", "gamma_correction").when(t == "view", "clahe_grid_size").when(t == "error", "threshold_method")
            .when(t == "signup", "brightness_beta").otherwise("custom"))
    value = (F.when(t == "error", F.when(n % 2 == 0, "otsu").otherwise("magic")).when(n % 13 == 0, "abc").otherwise(F.col("value").cast("string")))
    p = table(spark, sf, "events").select("event_id", name.alias("name"), value.alias("value"))
    c = manifest.clamped_params(p, ["event_id"])
    return c.select("event_id", "name", "error", F.round("number", 6).alias("number"), F.col("known").cast("int").alias("known"))


@query("""select user_id as sample, event_type as channel, coalesce(max(case when value > 40 then 'own' end), 'global') as strength from events group by 1, 2""")
def channel_params(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("channel"), "value")
    own = e.where("value > 40").select("sample", "channel", F.lit("strength").alias("name"), F.lit("own").alias("value")).distinct()
    return manifest.channel_params(e.select("sample", "channel").distinct(), own, ["sample"], "strength", "global", "50")


@query("select event_id, substr(sha256('/data/' || event_type || '/' || event_id || '.tif' || case when event_id % 2 = 0 then ':' || (event_id % 7) else '' end), 1, 16) as image_id from events")
def image_ids(spark, sf):
    n = F.col("event_id")
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/"), n, F.lit(".tif"))
    return table(spark, sf, "events").select("event_id", manifest.image_id(path, F.when(n % 2 == 0, n % 7)).alias("image_id"))


@query("""select event_id, substr(sha256('{"a":"' || event_type || '","k":"' || regexp_extract(props, '(\\d+)', 1) || '"}'), 1, 16) as version_hash from events""")
def version_hashes(spark, sf):
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("a"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", manifest.version_hash(m).alias("version_hash"))


@query("""select user_id as sample, 'P1' as position, count(*) as steps, arg_max(event_type, ts) as step_name, arg_max(event_id, ts)::varchar as version_hash from events group by 1""")
def log_state(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("sample"), F.lit("P1").alias("position"), F.col("ts").alias("time"), F.col("event_type").alias("step_name"),
        F.lit("aligned").alias("output_stage"), F.col("event_id").cast("string").alias("version_hash"))
    return manifest.log_state(log).drop("updated_at", "output_stage")


ANSWER = """t as (select conv_id, turn, text, length(text) as n from conversations)"""


@query(f"""with {ANSWER} select conv_id, turn, (case when n % 3 <> 0 then round(n / 10.0, 1) end)::double as gaussian_blur_sigma,
  case when n % 3 <> 0 then (n % 9)::int end as clahe_grid_size, case when n % 3 <> 0 then n % 2 = 0 end as bit_depth_conversion,
  (case when n % 5 = 0 then 0.8 else round(n % 100 / 100.0, 2) end)::double as confidence, case when n % 3 <> 0 then role_ end as noise_level
from (select *, 'n' || n as role_ from t)""")
def text_params(spark, sf):
    """Answer texts written around whole conversation turns, then parsed back."""
    t = table(spark, sf, "conversations")
    n = F.length("text")
    plain = F.regexp_replace("text", r"[\[\]:]", " ")
    body = F.concat(F.lit("[IMAGE_DIAGNOSIS]\nNoise level: N"), n, F.lit("\n"), F.regexp_replace(plain, "\n", " "),
                    F.lit("\n[RECOMMENDED_PREPROCESSING_PARAMETERS]\n16-bit → 8-bit (yes / no): "),
                    F.when(n % 2 == 0, "yes").otherwise("no"), F.lit("\nGaussian blur sigma: "), F.round(n / 10.0, 1).cast("string"),
                    F.lit("\nTile grid size: "), n % 9, F.lit(" x 8\n"))
    conf = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("[CONFIDENCE]\nOverall confidence score: "),
                                                     F.round(n % 100 / 100.0, 2).cast("string")))
    text = F.concat(F.when(n % 3 == 0, "").otherwise(body), conf)
    p = manifest.text_parameters(t.select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"])
    noise = F.try_element_at("diagnosis", F.lit("noise_level"))
    return p.select("conv_id", "turn", "gaussian_blur_sigma", "clahe_grid_size", "bit_depth_conversion", "confidence",
                    noise.alias("noise_level"))


@query("""select event_id, round(case event_id % 4 when 0 then value / 65535.0 when 1 then value / 4294967295.0 when 2 then least(1.0, greatest(0.0, value - 10)) else value / 255.0 end, 9) as unit from events""")
def dtype_scaling(spark, sf):
    n = F.col("event_id") % 4
    kind = F.when(n == 0, "uint16").when(n == 1, "uint32").when(n == 2, "float32").otherwise("uint8")
    v = F.when(n == 2, F.col("value") - 10).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", F.round(scalars.unit_range(v, kind), 9).alias("unit"))


# -- export views ----------------------------------------------------------------

#: Marker channel -> (cycle, marker, its column in the views); two channels share a marker name.
VIEWS = {"click": ("C1", "CD", "CD"), "view": ("C2", "CD", "CD_2"), "error": ("C3", "CE", "CE"), "purchase": ("C4", "CF", "CF")}


def _views_sql() -> str:
    flag = ", ".join(f"""coalesce({c}.n > 8, false)::int as "{v[2].replace('_2', '')}_positive{'_2' * v[2].endswith('_2')}\"""" for c, v in VIEWS.items())
    value = ", ".join(f'round(case when {c}.n > 8 then greatest({c}.mi - 5, 0) else 0 end, 5) as "{v[2]}"' for c, v in VIEWS.items())
    joins = " ".join(f"left join (select * from c where channel = '{c}') {c} on {c}.image = r.image" for c in VIEWS)
    return f"""with {DETECTIONS}, c as (select image, channel, count(*) n, avg(mean_intensity) mi from marks group by 1, 2)
select r.id as object_id, r.image::varchar as sample, {flag}, {value} from refs r {joins}"""


@query(_views_sql())
def export_views(spark, sf):
    """Full and background-subtracted views of the reference objects over all marker channels."""
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    dim = spark.createDataFrame([(v[0], "CH1", v[1]) for v in VIEWS.values()] + [("C0", "CH1", "anchor")], "cycle string, channel string, marker string")
    c = marks.groupBy("image", "channel").agg(F.count("*").alias("n"), F.avg("mean_intensity").alias("mi"))
    names = F.create_map(*[F.lit(x) for k, v in VIEWS.items() for x in (k, f"{v[0]}_CH1")])
    long = refs.select("image", F.col("id").alias("object_id")).join(c, "image").select(
        "object_id", names[F.col("channel")].alias("channel"), (F.col("n") > 8).alias("positive"),
        F.col("mi").alias("mean_intensity"), F.greatest(F.col("mi") - 5, F.lit(0.0)).alias("intensity_bg_subtracted"), F.col("mi").alias("raw_mean"))
    obj = refs.select(F.col("id").alias("object_id"), F.col("image").cast("string").alias("sample"), F.lit("P1").alias("position"),
                      "centroid_x", "centroid_y", "area", F.lit(1.0).alias("perimeter"), F.lit(1.0).alias("circularity"), F.lit(1.0).alias("score"))
    v = export.export_views(obj, long, dim)
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in ("CD_positive", "CD_positive_2", "CE_positive", "CF_positive")]
    full = v["full"].select("object_id", "sample", *flags)
    return full.join(v["bg_subtracted"].select("object_id", *[F.round(v[2], 5).alias(v[2]) for v in VIEWS.values()]), "object_id")


@query(f"""with {DETECTIONS} select r.id as object_id, {", ".join(f"round(avg(m.mean_intensity) filter (m.channel = '{c}'), 5) as {c}" for c in VIEWS)}
from refs r left join marks m on m.image = r.image group by r.id""")
def intensity_export(spark, sf):
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    per = marks.groupBy("image", F.col("channel").alias("marker")).agg(F.round(F.avg("mean_intensity"), 5).alias("mean_intensity"))
    i = refs.select("image", F.col("id").alias("object_id")).join(per, "image").select("object_id", "marker", "mean_intensity")
    return export.intensity_export(refs.select(F.col("id").alias("object_id")), i, list(VIEWS))


@query("""with c as (select 'C' || (event_id % 12) as name from events group by 1) select name, (row_number() over (order by substr(name, 2)::int))::int as place from c""")
def natural_order(spark, sf):
    names = table(spark, sf, "events").select(F.concat(F.lit("C"), F.col("event_id") % 12).alias("name")).distinct()
    w = Window.orderBy(scalars.natural_number(F.col("name"), "C"), "name")
    return names.withColumn("place", F.row_number().over(w))


# -- answers and patches as JSON -------------------------------------------------

@query("""with ev as (select user_id as image, event_id as t, event_type as e, (event_id % 10)::varchar as k from events),
m as (select image, t, 'view' as name, 'zoom' as member, k as value, true as obj from ev where e in ('signup', 'view')
  union all select image, t, 'view', 'mode', '"m"', true from ev where e = 'view' union all select image, t, 'tab', null, '"x"', false from ev where e = 'signup'
  union all select image, t, 'view', 'pan', k, true from ev where e = 'click' union all select image, t, 'view', null, k, false from ev where e = 'purchase'
  union all select image, t, 'tab', 'id', k, true from ev where e = 'error'),
w as (select *, coalesce(max(t) filter (not obj) over (partition by image, name), -1) as plain, max(t) over (partition by image, name) as last from m)
select image, name, member, arg_max(value, t) as value from w where (last = plain and t = last) or (last > plain and obj and t > plain) group by 1, 2, 3""")
def folded_patches(spark, sf):
    """State of each image after its patches: plain values replace, objects merge one level deep."""
    e = table(spark, sf, "events").selectExpr("user_id as image", "event_id as t", """case event_type
      when 'signup' then concat('{"view":{"zoom":', event_id % 10, '},"tab":"x"}') when 'click' then concat('{"view":{"pan":', event_id % 10, '}}')
      when 'view' then concat('{"view":{"zoom":', event_id % 10, ',"mode":"m"}}') when 'purchase' then concat('{"view":', event_id % 10, '}')
      else concat('{"tab":{"id":', event_id % 10, '}}') end as patch""")
    return manifest.folded_patches(e, ["image"], "t")


@query("""with ev as (select event_id as id, event_type as e, event_id % 10 as k from events)
select id, 'sigma' as name, k::varchar as value from ev where e in ('signup', 'click') union all select id, 'low', k::varchar from ev where e = 'signup'
union all select id, 'sharpening_blur_sigma', k::double::varchar from ev where e = 'view'""")
def answer_parameters(spark, sf):
    """Parameters of mixed answers: JSON objects first, the text format where there is none."""
    a = table(spark, sf, "events").selectExpr("event_id as id", r"""case event_type
      when 'signup' then concat('{"recommended_parameters":{"sigma":{"value":', event_id % 10, ',"why":"n"},"low":', event_id % 10, '}}')
      when 'click' then concat('{"parameters":{"sigma":', event_id % 10, '}}')
      when 'view' then concat('[RECOMMENDED_PREPROCESSING_PARAMETERS]\nBlur sigma: ', event_id % 10) else '{"other":1}' end as text""")
    text = manifest.text_parameters(a, ["id"]).where("sharpening_blur_sigma is not null").select(
        "id", F.lit("sharpening_blur_sigma").alias("name"), F.col("sharpening_blur_sigma").cast("string").alias("value"))
    return manifest.json_parameters(a, ["id"]).unionByName(text)
