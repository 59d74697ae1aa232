"""Reference-centred colocalisation tables and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motes.functions.scalars import combination_label
from motes.operators.ordering import exact_quantiles
from motes.operators.profile import share_of_total
from motes.operators.spatial import XY, k_nearest
from motes.session import saved


def nearest_by_channel(refs: DataFrame, markers: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Marker objects of all channels with their nearest reference: keys, channel, left_id, right_id, distance."""
    m = markers.select(*keys, F.struct("channel", "id").alias("id"), *XY)
    n = k_nearest(m, refs, keys, bound=limit)
    return n.select(*keys, F.col("id.channel").alias("channel"), F.col("ref_id").alias("left_id"),
                    F.col("id.id").alias("right_id"), "distance")


def channel_hits(matches: DataFrame, keys: list[str], intensity: DataFrame | None = None) -> DataFrame:
    """Per (reference, channel): count, nearest distance and mean intensity of the matched markers."""
    m = matches
    if intensity is not None:
        finite = F.when(F.abs("mean_intensity") < float("inf"), F.col("mean_intensity"))
        i = intensity.select(*keys, "channel", F.col("id").alias("right_id"), finite.alias("_i"))
        m = m.join(i, [*keys, "channel", "right_id"], "left")
    else:
        m = m.withColumn("_i", F.lit(None).cast("double"))
    return m.groupBy(*keys, F.col("left_id").alias("id"), "channel").agg(
        F.count("*").alias("count"), F.min("distance").alias("nearest_distance"), F.avg("_i").alias("mean_intensity"))


def matched_ids(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted ids of one reference object's own markers, for the stored table."""
    return matches.groupBy(*keys, F.col("left_id").alias("id"), "channel").agg(
        F.sort_array(F.collect_list("right_id")).alias("matched_ids"))


def reference_long(refs: DataFrame, hits: DataFrame, channels: list[str], keys: list[str],
                   background: DataFrame | None = None) -> DataFrame:
    """One row per (reference object, marker channel), hit or not.

    Positive means at least one match; intensities never change it.  ``background``
    holds keys, channel, background_mean; the subtracted intensity never drops below 0.
    """
    grid = refs.select(*keys, "id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    out = grid.join(hits, [*keys, "id", "channel"], "left").na.fill(0, ["count"])
    sub: Column = F.lit(None).cast("double")
    if background is not None:
        out = out.join(background.select(*keys, "channel", "background_mean"), [*keys, "channel"], "left")
        sub = F.greatest(F.lit(0.0), F.col("mean_intensity") - F.col("background_mean"))
        sub = F.when(F.col("mean_intensity").isNotNull() & F.col("background_mean").isNotNull(), sub)
    return out.select(*keys, "id", "channel", "count", (F.col("count") > 0).alias("positive"),
                      F.round("nearest_distance", 3).alias("nearest_distance"),
                      F.round("mean_intensity", 6).alias("mean_intensity"),
                      F.round(sub, 6).alias("intensity_bg_subtracted"))


def reference_status(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per reference object: positive channels, label, matched markers and status."""
    g = long.groupBy(*keys, "id").agg(
        F.array_sort(F.collect_set(F.when(F.col("positive"), F.col("channel")))).alias("positive_channels"),
        F.sum("count").alias("total_positive_marker_count"))
    return g.withColumns({
        "biomarker_combination_label": combination_label(F.col("positive_channels")),
        "overall_status": F.when(F.size("positive_channels") > 0, "Positive").otherwise("Negative")})


def reference_wide(refs: DataFrame, long: DataFrame, channels: list[str], keys: list[str],
                   ids: DataFrame | None = None, marker_names: dict[str, str] | None = None) -> DataFrame:
    """The stored table: one row per reference object, one column group per channel."""
    measures = ["count", "positive", "nearest_distance", "mean_intensity", "intensity_bg_subtracted"]
    src = long
    if ids is not None:
        src = src.join(ids, [*keys, "id", "channel"], "left")
        measures.append("matched_ids")
    wide = src.groupBy(*keys, "id").pivot("channel", channels).agg(*[F.first(m).alias(m) for m in measures])
    if len(measures) > 1:
        wide = wide.select(*keys, "id", *[F.col(f"`{c}_{m}`") for c in channels for m in measures])
    status = reference_status(long, keys)
    if marker_names is not None:
        names = F.create_map(*[F.lit(v) for kv in marker_names.items() for v in kv]) if marker_names else F.create_map()
        status = status.withColumn("positive_biomarkers", F.transform(
            "positive_channels", lambda c: F.coalesce(F.try_element_at(names, c), F.lit(""))))
    shape = [c for c in (*XY, "area", "perimeter", "circularity") if c in refs.columns]
    return (refs.select(*keys, "id", *[F.col(c).alias(f"reference_{c}") for c in shape])
            .join(wide, [*keys, "id"]).join(status, [*keys, "id"])
            .withColumnRenamed("id", "reference_object_id"))


def combination_summary(status: DataFrame, label: str = "biomarker_combination_label", by: list[str] = []) -> DataFrame:
    """Counts per label with rate and percentage, most frequent first."""
    c = status.groupBy(*by, F.col(label).alias("combination")).agg(F.count("*").alias("count"))
    # the shares read the counts twice
    c = share_of_total(saved(c), "count", "rate", by)
    return c.withColumn("percentage", F.col("rate") * 100.0).orderBy(*by, F.desc("count"), "combination")


def channel_summary(long: DataFrame, markers: DataFrame, n_refs: int, mode: str = "live",
                    marker_names: dict[str, str] | None = None) -> DataFrame:
    """Per channel: markers, positives, positive percent, mean count and median nearest distance.

    live: both statistics over positive rows, interpolated median.  reconcile: the
    count sum of all rows over the positives, median over all known distances.
    ui: as live, with the upper middle element for the median.
    """
    if mode not in ("live", "reconcile", "ui"):
        raise ValueError("mode must be live, reconcile or ui")
    # read four times below, and made of joins
    long = saved(long.select("channel", "count", "positive", "nearest_distance"))
    pos = F.col("positive")
    mean_count = (F.sum("count") / F.nullif(F.count_if(pos), F.lit(0)) if mode == "reconcile"
                  else F.avg(F.when(pos, F.col("count"))))
    g = long.groupBy("channel").agg(F.count_if(pos).alias("positive_reference_objects"), mean_count.alias("_avg"))
    rows = long if mode == "reconcile" else long.where(pos)
    med = exact_quantiles(rows, ["channel"], "nearest_distance", {"_med": .5}, discrete=mode == "ui")
    total = markers.groupBy("channel").agg(F.count("*").alias("total_marker_objects"))
    names = F.lit("")
    if marker_names:
        names = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in marker_names.items() for v in kv]),
                                            F.col("channel")), F.lit(""))
    out = g.join(total, "channel", "left").join(med, "channel", "left")
    pct = F.col("positive_reference_objects") / n_refs * 100.0 if n_refs else F.lit(0.0)
    return out.select("channel", names.alias("biomarker"),
                      F.coalesce("total_marker_objects", F.lit(0)).alias("total_marker_objects"),
                      "positive_reference_objects", F.round(pct, 3).alias("positive_rate"),
                      F.round(F.coalesce("_avg", F.lit(0.0)), 3).alias("avg_marker_count_per_positive_reference"),
                      F.round("_med", 3).alias("median_nearest_distance"))


def overall_summary(status: DataFrame) -> DataFrame:
    """Totals over all reference objects; zeros for an empty table."""
    n, p = F.count("*"), F.count_if(F.col("overall_status") == "Positive")
    rate = F.when(n > 0, p / n * 100.0).otherwise(0.0)
    return status.agg(
        n.alias("total_reference_objects"), p.alias("marker_positive_reference_objects"),
        (n - p).alias("marker_negative_reference_objects"), F.round(rate, 3).alias("overall_positive_rate"),
        F.coalesce(F.sum("total_positive_marker_count"), F.lit(0)).alias("total_matched_marker_objects"))


def reconciled(dets: DataFrame, old: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every current detection with its stored result, or a Negative row of defaults; sorted by id.

    Stored rows of objects that no longer exist drop out.
    """
    have = old.withColumn("_old", F.lit(True))
    j = dets.select(*keys, "id").join(have, [*keys, "id"], "left")
    base = {"overall_status": "Negative", "biomarker_combination_label": "Negative",
            "total_positive_marker_count": 0, **defaults}
    fill = {c: v for c, v in base.items() if c in old.columns and v is not None}
    return j.na.fill(fill).withColumn("was_missing", F.col("_old").isNull()).drop("_old").orderBy(*keys, "id")


def formatted_combinations(combos: DataFrame) -> DataFrame:
    """Display rows: rate to 4 places, percentage to 1, missing ones 0."""
    def num(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return combos.select(F.coalesce("combination", F.lit("Negative")).alias("combination"),
                         F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("count"),
                         F.round(num("rate"), 4).alias("rate"), F.round(num("percentage"), 1).alias("percentage"))
