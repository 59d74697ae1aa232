"""Registered queries over detections, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motes.functions.scalars import distance_verdict
from motes.operators import coloc, graph, matching, profile, qc, spatial
from motes.plans.fixtures import (CHANNELS, DETECTIONS, PIXELS, REFERENCE, detections, marker_detections, pixels,
                                  references, table)
from motes.plans.objects import rounded
from motes.session import saved
from motes.sources import export, tables

QUERIES: dict = {}
IMG = ["image"]


def query(sql: str | None = None):
    """Register a query under its function name, with SQL that gives the same table."""
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


D2 = """(a.centroid_x - b.centroid_x) * (a.centroid_x - b.centroid_x)
  + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y)"""

NEAR = f"""near as (select image, channel, right_id, left_id, distance from (
  select b.image, b.channel, b.id as right_id, a.id as left_id, sqrt({D2}) as distance,
    row_number() over (partition by b.id order by {D2}, a.id) k
  from refs a join marks b on a.image = b.image where {D2} < 100) where k = 1)"""


@query(f"with {DETECTIONS}, {NEAR} select image, channel, right_id as id, left_id as ref_id, round(distance, 6) as distance from near")
def nearest_reference(spark, sf):
    m = coloc.nearest_by_channel(references(spark, sf), marker_detections(spark, sf), IMG, 10.0)
    return m.select("image", "channel", F.col("right_id").alias("id"), F.col("left_id").alias("ref_id"),
                    F.round("distance", 6).alias("distance"))


@query(f"""with {DETECTIONS} select a.image, a.id as left_id, b.id as right_id, round(sqrt({D2}), 6) as distance
from refs a join marks b on a.image = b.image where {D2} <= 100""")
def range_join(spark, sf):
    return rounded(spatial.pairs_within(references(spark, sf), marker_detections(spark, sf), IMG, 10.0), ["distance"])


BOXES = "a.bbox_x1 < b.bbox_x2 and b.bbox_x1 < a.bbox_x2 and a.bbox_y1 < b.bbox_y2 and b.bbox_y1 < a.bbox_y2"


@query(f"with {DETECTIONS} select a.image, a.id as left_id, b.id as right_id from refs a join marks b on a.image = b.image and {BOXES}")
def bbox_overlap(spark, sf):
    return spatial.box_pairs(references(spark, sf), marker_detections(spark, sf), IMG)


PCT = f"""pct as (select a.image, a.id as left_id, b.id as right_id, b.channel, sqrt({D2}) as distance,
  (least(a.bbox_x2, b.bbox_x2) - greatest(a.bbox_x1, b.bbox_x1)) * (least(a.bbox_y2, b.bbox_y2) - greatest(a.bbox_y1, b.bbox_y1))
   / ((b.bbox_x2 - b.bbox_x1) * (b.bbox_y2 - b.bbox_y1)) * 100.0 as percent
  from refs a join marks b on a.image = b.image and {BOXES})"""


def _percent(spark, sf, mode, **kw) -> DataFrame:
    p = spatial.overlap_percent(references(spark, sf), marker_detections(spark, sf), IMG, mode=mode, **kw)
    return rounded(p.select("image", "left_id", "right_id", "percent", "distance"), ["percent", "distance"])


def _percent_sql(where: str) -> str:
    return f"""with {DETECTIONS}, {PCT} select image, left_id, right_id, round(percent, 6) as percent,
      round(distance, 6) as distance from pct where {where}"""


@query(_percent_sql("percent > 0"))
def overlap_percent(spark, sf):
    return _percent(spark, sf, "overlap_all")


@query(_percent_sql("percent >= 99.9"))
def overlap_full(spark, sf):
    return _percent(spark, sf, "overlap_full")


@query(_percent_sql("percent > 0 and percent < 99.9"))
def overlap_partial(spark, sf):
    return _percent(spark, sf, "overlap_partial")


@query(_percent_sql("percent >= 40"))
def overlap_min_pct(spark, sf):
    return _percent(spark, sf, "overlap_min_pct", min_pct=40.0)


# two neighbouring images act as two channels of one field; blocks of the
# foreground are the objects
LABELS = """pa as (select image // 2 as field, y, x, (y // 2) * 2 + x // 4 + 1 as label from pixels where value > 0 and image % 2 = 0),
pb as (select image // 2 as field, y, x, (y // 4) * 4 + x // 2 + 1 as label from pixels where value > 0 and image % 2 = 1)"""


def label_channels(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = pixels(spark, sf).where("value > 0").withColumn("field", F.expr("image div 2"))
    a = p.where("image % 2 = 0").select("field", "y", "x", F.expr("(y div 2) * 2 + x div 4 + 1").alias("label"))
    b = p.where("image % 2 = 1").select("field", "y", "x", F.expr("(y div 4) * 4 + x div 2 + 1").alias("label"))
    return a, b


@query(f"""with {PIXELS}, {LABELS} select field, a.label as left_id, b.label as right_id, count(*) as shared
from pa a join pb b using (field, y, x) group by 1, 2, 3""")
def overlap_labels(spark, sf):
    return spatial.label_pairs(*label_channels(spark, sf), ["field"])


@query(f"""with {PIXELS}, {LABELS}, ca as (select field, label, avg(x) cx, avg(y) cy from pa group by 1, 2),
cb as (select field, label, avg(x) cx, avg(y) cy, count(*) n from pb group by 1, 2),
s as (select field, a.label as l, b.label as r, count(*) as shared from pa a join pb b using (field, y, x) group by 1, 2, 3)
select s.field, l as left_id, r as right_id, round(shared / n * 100.0, 6) as percent,
  round(sqrt((ca.cx - cb.cx) * (ca.cx - cb.cx) + (ca.cy - cb.cy) * (ca.cy - cb.cy)), 5) as distance
from s join ca on ca.field = s.field and ca.label = l join cb on cb.field = s.field and cb.label = r where shared / n >= 0.5""")
def overlap_percent_masks(spark, sf):
    a, b = label_channels(spark, sf)

    def centres(df):
        return df.groupBy("field", F.col("label").alias("id")).agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    p = spatial.overlap_percent(centres(a), centres(b), ["field"], mode="overlap_min_pct", min_pct=50.0,
                                primary_pixels=a, secondary_pixels=b)
    return rounded(rounded(p, ["percent"]), ["distance"], 5)


# -- matching ------------------------------------------------------------------

PAIRS = f"""pairs as (select a.image, a.channel as c1, b.channel as c2, a.id as l, b.id as r, {D2} as d2,
    row_number() over (partition by a.image, a.channel, b.channel order by {D2}, a.id, b.id) as k
  from detections a join detections b on a.image = b.image and a.channel < b.channel where {D2} <= 100),
steps(image, c1, c2, k, ls, rs) as (
  select image, c1, c2, 0::bigint, []::bigint[], []::bigint[] from (select distinct image, c1, c2 from pairs)
  union all
  select s.image, s.c1, s.c2, p.k,
    case when list_contains(ls, l) or list_contains(rs, r) then ls else list_append(ls, l) end,
    case when list_contains(ls, l) or list_contains(rs, r) then rs else list_append(rs, r) end
  from steps s join pairs p on p.image = s.image and p.c1 = s.c1 and p.c2 = s.c2 and p.k = s.k + 1),
done as (select image, c1, c2, unnest(max_by(ls, k)) as l, unnest(max_by(rs, k)) as r from steps group by 1, 2, 3)"""


def _matches(spark, sf) -> DataFrame:
    return matching.channel_pair_matches(detections(spark, sf), IMG, 10.0)


@query(f"with recursive {DETECTIONS}, {PAIRS} select image, c1 as channel_1, c2 as channel_2, l as left_id, r as right_id from done")
def greedy_match(spark, sf):
    return _matches(spark, sf).drop("distance")


@query(f"""with recursive {DETECTIONS}, {PAIRS}, n as (select image, channel, count(*) n from detections group by 1, 2),
m as (select image, c1, c2, count(*) m from done group by 1, 2, 3)
select a.image, a.channel as channel_1, b.channel as channel_2, a.n as n_1, b.n as n_2, coalesce(m, 0) as matched,
  round(coalesce(m, 0) / a.n, 6) as rate_1, round(coalesce(m, 0) / b.n, 6) as rate_2
from n a join n b on a.image = b.image and a.channel < b.channel
left join m on m.image = a.image and c1 = a.channel and c2 = b.channel""")
def pairwise_coloc_rates(spark, sf):
    d = detections(spark, sf)
    return rounded(matching.pair_rates(d, _matches(spark, sf), IMG), ["rate_1", "rate_2"])


@query(f"""with recursive {DETECTIONS}, {PAIRS},
hit as (select image, c1 as channel, l as id from done union select image, c2, r from done)
select channel, count(*) as total, count(hit.id) as colocalized, round(count(hit.id) / count(*) * 100.0, 1) as percent
from detections left join hit using (image, channel, id) group by rollup (channel)""")
def channel_totals(spark, sf):
    d = detections(spark, sf)
    return profile.channel_totals(matching.colocalized_flag(d, _matches(spark, sf), IMG))


@query(f"""with recursive {DETECTIONS}, {PAIRS},
hit as (select image, c1 as channel, l as id from done union select image, c2, r from done)
select d.image, d.channel, d.id as object_id, round(centroid_x, 2) as x_coord, round(centroid_y, 2) as y_coord,
  mean_intensity as intensity, (hit.id is not null)::int as colocalized from detections d left join hit using (image, channel, id)""")
def legacy_detection_rows(spark, sf):
    d = detections(spark, sf).withColumns({"score": F.lit(1.0), "circularity": F.lit(1.0)})
    rows = export.legacy_rows(d, matching.colocalized_ids(_matches(spark, sf), IMG), IMG)
    return rows.select("image", "channel", "object_id", "x_coord", "y_coord", "intensity",
                       F.col("colocalized").cast("int").alias("colocalized"))


@query(f"""with recursive {DETECTIONS}, {PAIRS},
e as (select image, l as a, r as b from done union select image, r, l from done union select image, id, id from detections),
reach as (select image, a, b from e union select r.image, r.a, e.b from reach r join e on e.image = r.image and e.a = r.b),
comp as (select image, a, min(b) as root from reach group by 1, 2),
sig as (select c.image, c.root, list_sort(list(distinct d.channel)) as ch from comp c join detections d on d.image = c.image and d.id = c.a group by 1, 2)
select array_to_string(ch, ',') as signature, count(*) as count, (select count(*) from sig) as total_objects_grouped,
  round(count(*) / (select count(*) from sig), 6) as rate from sig group by 1""")
def component_signatures(spark, sf):
    d = detections(spark, sf)
    t = graph.signature_table(graph.channel_signatures(d, _matches(spark, sf), IMG))
    return t.select(F.array_join("channels", ",").alias("signature"), "count", "total_objects_grouped",
                    F.round("rate", 6).alias("rate"))


# -- reference tables --------------------------------------------------------------

BACKGROUND = {"click": 5.0, "error": 10.0, "view": 2.0}


def _long(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    matches = coloc.nearest_by_channel(refs, marks, IMG, 10.0)
    hits = coloc.channel_hits(matches, IMG, marks)
    back = refs.select("image").distinct().select("image", F.explode(F.create_map(
        *[F.lit(v) for kv in BACKGROUND.items() for v in kv])).alias("channel", "background_mean"))
    return refs, marks, coloc.reference_long(refs, hits, CHANNELS, IMG, back)


REFLONG = f"""{NEAR}, bg as (select * from (values ('click', 5.0::double), ('error', 10.0::double), ('view', 2.0::double)) t(channel, bg)),
hits as (select n.image, n.left_id as id, n.channel, count(*) c, min(distance) d, avg(m.mean_intensity) mi
  from near n join marks m on m.id = n.right_id group by 1, 2, 3),
rl as (select r.image, r.id, ch as channel, coalesce(c, 0) as count, c is not null as positive, round(d, 3) as nearest_distance,
    round(mi, 6) as mean_intensity, case when mi is not null and bg is not null then round(greatest(0.0, mi - bg), 6) end as intensity_bg_subtracted
  from refs r cross join (values ('click'), ('error'), ('purchase'), ('view')) t(ch)
  left join hits h on h.image = r.image and h.id = r.id and h.channel = ch left join bg on bg.channel = ch),
st as (select image, id, coalesce(list_sort(list(channel) filter (positive)), []) as pc, sum(count)::bigint as total from rl group by 1, 2),
lab as (select *, case len(pc) when 0 then 'Negative' when 1 then pc[1] || ' only' else array_to_string(pc, ' + ') end as label from st)"""


@query(f"""with {DETECTIONS}, {REFLONG} select image, id, channel, count, positive::int as positive, nearest_distance, mean_intensity,
  intensity_bg_subtracted from rl""")
def reference_long(spark, sf):
    return _long(spark, sf)[2].withColumn("positive", F.col("positive").cast("int"))


@query(f"""with {DETECTIONS}, {REFLONG},
ids as (select image, left_id as id, array_to_string(list_sort(list(right_id)), ',') as click_matched_ids from near where channel = 'click' group by 1, 2)
select l.image, l.id as reference_object_id, r.centroid_x as reference_centroid_x, r.area as reference_area,
  c.count as click_count, c.nearest_distance as click_nearest_distance, coalesce(click_matched_ids, '') as click_matched_ids,
  v.count as view_count, v.intensity_bg_subtracted as view_intensity_bg_subtracted,
  label as biomarker_combination_label, total as total_positive_marker_count,
  case when len(pc) > 0 then 'Positive' else 'Negative' end as overall_status, array_to_string(pc, ',') as positive_channels
from lab l join refs r on r.image = l.image and r.id = l.id
join rl c on c.image = l.image and c.id = l.id and c.channel = 'click' join rl v on v.image = l.image and v.id = l.id and v.channel = 'view'
left join ids on ids.image = l.image and ids.id = l.id""")
def reference_table(spark, sf):
    refs, marks, long = _long(spark, sf)
    ids = coloc.matched_ids(coloc.nearest_by_channel(refs, marks, IMG, 10.0), IMG)
    w = coloc.reference_wide(refs, long, CHANNELS, IMG, ids, {c: c.upper() for c in CHANNELS})
    return w.select("image", "reference_object_id", "reference_centroid_x", "reference_area", "click_count",
                    "click_nearest_distance", F.coalesce(F.array_join("click_matched_ids", ","), F.lit("")).alias("click_matched_ids"),
                    "view_count", "view_intensity_bg_subtracted", "biomarker_combination_label",
                    "total_positive_marker_count", "overall_status", F.array_join("positive_channels", ",").alias("positive_channels"))


@query(f"""with {DETECTIONS}, {REFLONG} select label as combination, count(*) as count, round(count(*) / (select count(*) from refs), 6) as rate,
  round(count(*) / (select count(*) from refs) * 100.0, 6) as percentage from lab group by 1""")
def combination_summary(spark, sf):
    return rounded(coloc.combination_summary(coloc.reference_status(_long(spark, sf)[2], IMG)), ["rate", "percentage"])


@query(f"""with {DETECTIONS}, {REFLONG} select label as combination, count(*) as count, round(count(*) / (select count(*) from refs), 4) as rate,
  round(count(*) / (select count(*) from refs) * 100.0, 1) as percentage from lab group by 1""")
def formatted_combinations(spark, sf):
    return coloc.formatted_combinations(coloc.combination_summary(coloc.reference_status(_long(spark, sf)[2], IMG)))


def _channel_sql(avg: str, med: str) -> str:
    return f"""with {DETECTIONS}, {REFLONG}, n as (select channel, count(*) n from marks group by 1),
    o as (select channel, nearest_distance, row_number() over (partition by channel order by nearest_distance) - 1 as i,
      count(*) over (partition by channel) as c from rl where positive),
    u as (select channel, max(nearest_distance) filter (i = c // 2) as um from o group by 1)
    select rl.channel, '' as biomarker, any_value(n.n) as total_marker_objects, count(*) filter (positive) as positive_reference_objects,
      round(count(*) filter (positive) / count(*) * 100.0, 3) as positive_rate, round({avg}, 3) as avg_marker_count_per_positive_reference,
      round({med}, 3) as median_nearest_distance from rl left join n on n.channel = rl.channel left join u on u.channel = rl.channel group by 1"""


def _channel_summary(spark, sf, mode) -> DataFrame:
    refs, marks, long = _long(spark, sf)
    return coloc.channel_summary(long, marks, refs.count(), mode)


@query(_channel_sql("avg(count) filter (positive)", "quantile_cont(nearest_distance, 0.5) filter (positive)"))
def channel_summary(spark, sf):
    return _channel_summary(spark, sf, "live")


@query(_channel_sql("sum(count) / count(*) filter (positive)", "quantile_cont(nearest_distance, 0.5)"))
def channel_summary_reconciled(spark, sf):
    return _channel_summary(spark, sf, "reconcile")


@query(_channel_sql("avg(count) filter (positive)", "any_value(um)"))
def channel_summary_display(spark, sf):
    return _channel_summary(spark, sf, "ui")


@query(f"""with {DETECTIONS}, {REFLONG} select count(*) as total_reference_objects, count(*) filter (len(pc) > 0) as marker_positive_reference_objects,
  count(*) filter (len(pc) = 0) as marker_negative_reference_objects, round(count(*) filter (len(pc) > 0) / count(*) * 100.0, 3) as overall_positive_rate,
  sum(total)::bigint as total_matched_marker_objects from lab""")
def overall_summary(spark, sf):
    return coloc.overall_summary(coloc.reference_status(_long(spark, sf)[2], IMG))


@query(f"""with {DETECTIONS}, {REFLONG}, old as (select * from lab where id % 3 <> 0)
select r.image, r.id, coalesce(label, 'Negative') as biomarker_combination_label, coalesce(total, 0) as total_positive_marker_count,
  coalesce(case when len(pc) > 0 then 'Positive' else 'Negative' end, 'Negative') as overall_status, (old.id is null)::int as was_missing
from refs r left join old on old.image = r.image and old.id = r.id""")
def reconcile_missing(spark, sf):
    """Stored results of two thirds of the objects brought in line with all current objects."""
    refs, _, long = _long(spark, sf)
    old = coloc.reference_status(long, IMG).where("id % 3 <> 0").drop("positive_channels")
    return coloc.reconciled(refs, old, IMG, {}).withColumn("was_missing", F.col("was_missing").cast("int"))


@query(f"""with {DETECTIONS}, pr as (select a.image, a.id, b.channel, sqrt({D2}) as d from refs a join marks b on a.image = b.image where {D2} <= 100),
po as (select channel, image, id, count(*) c from pr group by 1, 2, 3)
select channel, (select count(*) from refs) as total_objects, count(*) as objects_with_relation, sum(c)::bigint as total_relations,
  round(sum(c) / (select count(*) from refs), 3) as mean_markers_per_object, 0.0::double as mean_max_overlap_pct from po group by 1""")
def spatial_relation_summary(spark, sf):
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    per = spatial.neighbours_per_object(refs, marks, IMG, 10.0, CHANNELS)
    return spatial.relation_summary(refs, per, marks.select("channel").distinct())


@query(f"""with {DETECTIONS}, {PCT}, po as (select channel, image, left_id, count(*) c, max(round(percent, 2)) best from pct group by 1, 2, 3)
select channel, (select count(*) from refs) as total_objects, count(*) as objects_with_relation, sum(c)::bigint as total_relations,
  round(sum(c) / (select count(*) from refs), 3) as mean_markers_per_object, round(avg(best), 2) as mean_max_overlap_pct from po group by 1""")
def overlap_relation_summary(spark, sf):
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    p = spatial.overlap_percent(refs, marks, IMG).join(
        marks.select("image", F.col("id").alias("right_id"), "channel"), ["image", "right_id"])
    return spatial.relation_summary(refs, spatial.overlaps_per_object(p, IMG), marks.select("channel").distinct())


@query(f"""with {DETECTIONS}, {PCT}, g as (select image, left_id, channel, count(*) c, string_agg(right_id, ',' order by right_id) ids,
  string_agg(cast(round(distance, 2) as decimal(9,2)), ',' order by right_id) ds from pct group by 1, 2, 3)
select r.image, r.id, click.c as click_count, click.ids as click_ids, click.ds as click_distances, view.c as view_count from refs r
left join g click on click.image = r.image and click.left_id = r.id and click.channel = 'click'
left join g view on view.image = r.image and view.left_id = r.id and view.channel = 'view'""")
def nested_relations(spark, sf):
    refs, marks = references(spark, sf), marker_detections(spark, sf)
    p = spatial.overlap_percent(refs, marks, IMG).join(
        marks.select("image", F.col("id").alias("right_id"), "channel"), ["image", "right_id"])
    n = spatial.nested_relations(refs, spatial.relation_table(refs, p, IMG), IMG)
    click, view = F.try_element_at("relations", F.lit("click")), F.try_element_at("relations", F.lit("view"))
    fixed = F.transform(click["distances"], lambda d: d.cast("decimal(9,2)").cast("string"))
    return n.select("image", "id", click["relation_count"].alias("click_count"),
                    F.array_join(click["marker_ids"].cast("array<string>"), ",").alias("click_ids"),
                    F.array_join(fixed, ",").alias("click_distances"), view["relation_count"].alias("view_count"))


# -- distances -----------------------------------------------------------------

ANY = f"""anyn as (select image, id, channel, ref_id, d from (select a.image, a.id, a.channel, b.id as ref_id, sqrt({D2}) as d,
    row_number() over (partition by a.id order by {D2}, b.id) k from marks a join refs b on a.image = b.image) where k = 1)"""


def _any(spark, sf) -> DataFrame:
    m = marker_detections(spark, sf)
    n = spatial.nearest_any(m, references(spark, sf), IMG)
    return n.join(m.select("image", "id", "channel"), ["image", "id"])


@query(f"""with {DETECTIONS}, {ANY} select channel, count(*) as objects, round(min(d), 6) as min_distance, round(max(d), 6) as max_distance,
  round(avg(d), 6) as mean_distance, round(quantile_cont(d, 0.5), 6) as median_distance,
  count(*) filter (d <= 5) as within_5, count(*) filter (d <= 10) as within_10, round(count(*) filter (d <= 20) / count(*), 6) as share_20,
  case when avg(d) > 20 then 'high' when avg(d) > 10 then 'moderate' else 'low' end as verdict from anyn group by 1""")
def distance_diagnostics(spark, sf):
    d = profile.nearest_diagnostics(_any(spark, sf), ["channel"])
    d = rounded(d, ["min_distance", "max_distance", "mean_distance", "median_distance", "share_20"])
    return d.select("channel", "objects", "min_distance", "max_distance", "mean_distance", "median_distance",
                    "within_5", "within_10", "share_20", distance_verdict(F.col("mean_distance")).alias("verdict"))


@query(f"""with {DETECTIONS}, {ANY}, k as (select *, row_number() over (partition by channel order by d, id, ref_id) k from anyn)
select channel, id, ref_id, round(d, 6) as distance from k where k = 1""")
def closest_pair(spark, sf):
    return rounded(spatial.closest_pair(_any(spark, sf), ["channel"]), ["distance"])


@query(f"""with {DETECTIONS}, k as (select a.image, a.id as src, b.id as dst, {D2} as d2,
  row_number() over (partition by a.id order by {D2}, b.id) k from detections a join detections b on a.image = b.image and a.id <> b.id)
select image, src, dst, round(sqrt(d2), 6) as distance from k where k <= 3""")
def knn_graph(spark, sf):
    return rounded(graph.knn_edges(detections(spark, sf), IMG, spatial.XY, 3), ["distance"])


@query()
def knn_communities(spark, sf):
    """Communities of the neighbour graph of all detections in one plane, with their modularity."""
    # written once, as the search reads them often; read back, the key is no constant that is dropped from windows but not from shuffles
    d = saved(detections(spark, sf).select(F.lit(1).alias("all"), "id", *spatial.XY))
    e = saved(graph.knn_edges(d, ["all"], spatial.XY, 8).select("src", "dst"))
    labels = graph.communities(e, 6)
    size = labels.groupBy("community").agg(F.count("*").alias("objects"))
    return size.join(F.broadcast(graph.modularity(e, labels)), F.lit(True))


@query(f"""with recursive {DETECTIONS}, n as (select a.id, count(*) n from detections a join detections b on a.image = b.image and {D2} <= 64 group by 1),
core as (select d.* from detections d join n using (id) where n >= 4),
e as (select a.id as a, b.id as b from core a join core b on a.image = b.image and {D2} <= 64),
reach as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
comp as (select a as id, min(b) as root from reach group by 1), s as (select root, count(*) n from comp group by 1)
select d.image, d.id, coalesce(case when s.n >= 5 then comp.root end, -1) as cluster from detections d left join comp using (id) left join s using (root)""")
def density_clusters(spark, sf):
    return graph.density_clusters(detections(spark, sf), IMG, spatial.XY, 8.0, 4, 5)


# -- filters and summaries -------------------------------------------------------

@query(f"with {DETECTIONS} select image, id, area from refs where area between 5 and 60")
def detection_range_filter(spark, sf):
    return qc.range_filter(references(spark, sf), {"area": (5.0, 60.0)}).select("image", "id", "area")


@query(f"with {DETECTIONS} select image, id from refs where image in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_filter_ids(spark, sf):
    keep = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("image"))
    return qc.restrict_to(references(spark, sf), keep, IMG).select("image", "id")


@query(f"with {DETECTIONS} select image, id from refs where not (area between 5 and 60)")
def anti_filter_ids(spark, sf):
    d = references(spark, sf)
    return qc.complement(d, qc.range_filter(d, {"area": (5.0, 60.0)}), ["image", "id"]).select("image", "id")


@query(f"""with {DETECTIONS} select channel, count(*) as count, round(avg(area), 6) as mean_area, round(quantile_cont(area, 0.5), 6) as median_area
from detections group by 1""")
def detection_summary(spark, sf):
    return rounded(profile.detection_summary(detections(spark, sf), ["channel"]), ["mean_area", "median_area"])


@query(f"""with {DETECTIONS}, c as (select image, least(floor(centroid_y / 10.3), 9)::bigint gy, least(floor(centroid_x / 10.1), 9)::bigint gx, count(*) n
  from detections group by 1, 2, 3), k as (select *, row_number() over (partition by image order by n desc, gy, gx) k from c)
select image, gx, gy, n from k where k = 1""")
def densest_cell(spark, sf):
    return profile.densest_cell(detections(spark, sf), IMG, 101.0, 103.0, *spatial.XY)


@query(f"""with {DETECTIONS}, s as (select count(*) n, min(area) lo, max(area) hi, quantile_cont(area, 0.5) med from detections),
t as (select *, least(30, greatest(8, ceil(sqrt(n))))::int as bins, lo > 0 and hi / greatest(med, 1.0) > 10 as lg from s),
p as (select *, case when lg then log10(greatest(lo, 0.5)) else lo end as start from t),
q as (select *, (case when lg then log10(hi) else hi end - start) / bins as step from p),
b as (select least(floor((case when lg then log10(area) else area end - start) / step), bins - 1)::int as bin, q.* from detections, q where area > 0 or not lg)
select bin, count(*) as n, bins, round(case when any_value(lg) then power(10, any_value(start) + bin * any_value(step)) else any_value(start) + bin * any_value(step) end, 4) as left_edge
from b where bin >= 0 group by bin, bins""")
def area_histogram(spark, sf):
    return profile.area_histogram(detections(spark, sf)).select("bin", "n", "bins", F.round("left_edge", 4).alias("left_edge"))


@query(f"""with {DETECTIONS}, k as (select *, row_number() over (partition by image, channel order by ts desc, id desc) k from detections)
select image, channel, id, ts from k where k = 1""")
def latest_per_channel(spark, sf):
    return tables.latest(detections(spark, sf), ["image", "channel"], ["ts", "id"]).select("image", "channel", "id", "ts")


@query(f"""with {DETECTIONS} select image, channel, row_number() over (partition by image, channel order by id) as id,
  centroid_x, area, coalesce(case when isfinite(mean_intensity) then printf('%.6g', mean_intensity) end, '') as mean_intensity from detections""")
def detection_export_rows(spark, sf):
    d = export.detection_rows(detections(spark, sf), ["image", "channel"])
    return d.select("image", "channel", "id", "centroid_x", "area", "mean_intensity")


@query(f"""with {DETECTIONS}, k as (select image, id, channel, centroid_x, row_number() over (order by area desc, id) k from refs)
select image, id, centroid_x, cast(k as int) as place from k where k <= 50""")
def sorted_detections(spark, sf):
    """The 50 largest reference detections."""
    top = qc.sorted_detections(references(spark, sf), "area", False).limit(50)
    from pyspark.sql import Window
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("area"), "id"))).select(
        "image", "id", "centroid_x", "place")


assert REFERENCE not in CHANNELS


@query(f"""with {DETECTIONS} select a.image, a.id, c.channel, count(*) as n from refs a join marks c on a.image = c.image
  and (a.centroid_x - c.centroid_x) * (a.centroid_x - c.centroid_x) + (a.centroid_y - c.centroid_y) * (a.centroid_y - c.centroid_y) <= 225
group by 1, 2, 3""")
def neighbour_counts(spark, sf):
    """Markers within 15 px per reference object and channel, counted without making the pairs."""
    n = spatial.neighbours_per_object(references(spark, sf), marker_detections(spark, sf), IMG, 15.0, CHANNELS)
    return n.select("image", F.col("left_id").alias("id"), "channel", F.col("n").cast("long").alias("n"))


@query(f"""with {DETECTIONS} select channel, (id % 3 = 0)::int as colocalized, count(*) as count from detections group by 1, 2""")
def flag_split(spark, sf):
    d = detections(spark, sf).withColumn("colocalized", (F.col("id") % 3 == 0).cast("int"))
    return profile.flag_split(d)


@query(f"""with {DETECTIONS}, far as (select *, centroid_x + 7 * image as gx from refs)
select a.id, b.id as ref_id, round(sqrt(d2), 6) as distance from (select a.id as id, b.id as bid, (a.gx - b.gx) * (a.gx - b.gx) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y) as d2,
  row_number() over (partition by a.id order by (a.gx - b.gx) * (a.gx - b.gx) + (a.centroid_y - b.centroid_y) * (a.centroid_y - b.centroid_y), b.id) k
  from far a join far b on a.id <> b.id) t join far a on a.id = t.id join far b on b.id = t.bid where k <= 2""")
def nearest_in_mosaic(spark, sf):
    """Two nearest reference objects of each other one after all images are laid side by side in one plane."""
    m = references(spark, sf).select(F.lit(1).alias("plane"), "id", (F.col("centroid_x") + 7 * F.col("image")).alias("centroid_x"), "centroid_y")
    n = spatial.k_nearest(m, m, ["plane"], k=2, skip_self=True)
    return rounded(n.select("id", "ref_id", "distance"), ["distance"])
