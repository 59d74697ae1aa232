"""Sinks: result bundles, detection files, colocalisation tables and export views."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.scalars import natural_number, q
from motes.operators.cooccur import top_combinations
from motes.operators.ordering import row_numbers
from motes.operators.profile import score_report
from motes.session import shuffled


#: Written last into a bundle: one line of JSON, table name -> format.
COMMITTED = "_COMMITTED"


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its path class."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def bundle_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Names and formats of a committed bundle's tables; an error if the bundle is missing or was broken off."""
    fs, path = _folder(spark, root)
    marker = path(f"{root}/{COMMITTED}")
    if not fs.exists(marker):
        raise ValueError(f"no committed bundle in {root}")
    stream = fs.open(marker)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_bundle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a committed bundle; cells of CSV tables are text."""
    return {name: (spark.read.option("header", True) if fmt == "csv" else spark.read).format(fmt).load(f"{root}/{name}")
            for name, fmt in bundle_tables(spark, root).items()}


def write_bundle(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite", sinks: int = 4) -> None:
    """Every named table to ``root/<name>``; nested cells become JSON text in CSV.

    All tables are written into a staging folder first; a failure there leaves the bundle as it was.  Then
    the marker goes, the tables take their places, and a marker that lists all tables of the bundle
    comes last.  A reader that finds no marker knows that the bundle is not whole.  Other tables of the
    bundle stay.  ``mode`` is ``overwrite``, or ``error`` to refuse names the bundle already has.
    ``sinks`` tables are written at a time, so small ones do not wait for the last task of a large one.
    """
    if mode not in ("overwrite", "error"):
        raise ValueError("mode must be overwrite or error")
    for name in tables:
        if not name or name.startswith(("_", ".")) or "/" in name:
            raise ValueError(f"not a table name: {name!r}")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    fs, path = _folder(spark, root)
    if mode == "error" and (there := sorted(n for n in tables if fs.exists(path(f"{root}/{n}")))):
        raise ValueError(f"{root} already holds {there}")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"

    def write(item: tuple[str, DataFrame]) -> None:
        w = json_cells(item[1]) if fmt == "csv" else item[1]
        (w.write.option("header", True) if fmt == "csv" else w.write).format(fmt).save(f"{staging}/{item[0]}")

    try:
        with ThreadPoolExecutor(sinks) as pool:
            list(pool.map(inheritable_thread_target(spark)(write), tables.items()))
        marker = path(f"{root}/{COMMITTED}")
        listed = (bundle_tables(spark, root) if fs.exists(marker) else {}) | {name: fmt for name in tables}
        fs.delete(marker, False)
        for name in tables:
            fs.delete(path(f"{root}/{name}"), True)
            if not fs.rename(path(f"{staging}/{name}"), path(f"{root}/{name}")):
                raise OSError(f"cannot move {name} into {root}")
        out = fs.create(marker, True)
        out.write(bytearray(json.dumps(listed, sort_keys=True).encode()))
        out.close()
    finally:
        fs.delete(path(staging), True)


def json_cells(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(q(c)).alias(c) if c in nested else q(c) for c in df.columns])


def summary_document(df: DataFrame, markers: list[str], thresholds: DataFrame) -> DataFrame:
    """One row: total objects, samples, positions, markers and thresholds."""
    t = {r["marker"]: r["threshold"] for r in thresholds.collect()}
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(t.get(m)).cast("double").alias("threshold"))
                      for m in markers])
    return df.agg(F.count("*").alias("total_objects"), F.array_sort(F.collect_set("sample")).alias("samples"),
                  F.array_sort(F.collect_set("position")).alias("positions")).withColumns(
        {"markers": F.array(*[F.lit(m) for m in markers]), "thresholds": pairs})


def detection_rows(dets: DataFrame, keys: list[str] = ["sample", "position", "channel"]) -> DataFrame:
    """Detections as stored: ids 1..n per channel, intensity with six significant digits or blank."""
    d = row_numbers(dets, keys, "id", "_n").withColumn("id", F.col("_n")).drop("_n")
    return d.withColumn("mean_intensity", F.coalesce(general_text(F.col("mean_intensity")), F.lit("")))


def general_text(v: Column) -> Column:
    """A number with six significant digits, without zeros at its end, and with an exponent
    below 1e-4 and from 1e6 on (the ``g`` form of C); NULL where it is not finite."""
    text = F.format_string("%.6g", v.cast("double"))
    short = F.when(text.contains("e"), F.regexp_replace(text, r"\.?0+(?=e)", "")).when(
        text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(F.abs(v) < float("inf"), short)


def write_detections(dets: DataFrame, root: str) -> None:
    """One folder per sample, position and channel."""
    detection_rows(dets).write.mode("overwrite").option("header", True).partitionBy(
        "sample", "position", "channel").csv(root)


def numbered_markers(dim: DataFrame) -> list[tuple[str, str]]:
    """(channel column, marker name) in cycle and channel order; repeats get ``_2``, ``_3``."""
    rows = (dim.where((F.upper("cycle") != "C0") & (F.trim("marker") != ""))
            .orderBy(natural_number(F.col("cycle"), "C"), natural_number(F.col("channel"), "CH"), "cycle", "channel")
            .select(F.lower(F.concat_ws("_", "cycle", "channel")), F.trim("marker")).collect())
    seen: dict[str, int] = {}
    out = []
    for channel, marker in rows:
        seen[marker] = seen.get(marker, 0) + 1
        out.append((channel, marker if seen[marker] == 1 else f"{marker}_{seen[marker]}"))
    return out


def renamed(base: str, suffix: str) -> str:
    """``CD9`` -> ``CD9_positive``; a numbered repeat keeps its number last (``CD9_positive_2``)."""
    stem, _, number = base.rpartition("_")
    return f"{stem}_{suffix}_{number}" if stem and number.isdigit() else f"{base}_{suffix}"


# Leading columns of the export views.
LEAD = ["object_id", "sample", "position", "centroid_x", "centroid_y", "area", "perimeter", "circularity"]


def export_views(refs: DataFrame, long: DataFrame, dim: DataFrame, anchor: str = "Pan-EV") -> dict[str, DataFrame]:
    """The three wide views of the annotated objects: full, raw intensity, background-subtracted.

    ``refs`` has the lead columns and ``score``; ``long`` has object_id, channel
    (``c1_ch2`` style or ``c0`` for the anchor), positive, mean_intensity,
    intensity_bg_subtracted and raw_mean.  The background view shows 0 where a marker is not positive.
    """
    names = numbered_markers(dim)
    channels = [c for c, _ in names]
    measures = ["positive", "mean_intensity", "intensity_bg_subtracted", "raw_mean"]
    wide = (long.withColumn("channel", F.lower("channel")).groupBy("object_id").pivot("channel", [*channels, "c0"])
            .agg(*[F.first(m).alias(m) for m in measures]))
    j = refs.join(wide, "object_id", "left")
    lead = [q(c) for c in LEAD]
    anchor_mean = q("c0_raw_mean").alias(anchor)
    full = [c for ch, m in names for c in (
        q(f"{ch}_positive").alias(renamed(m, "positive")), q(f"{ch}_mean_intensity").alias(renamed(m, "mean_intensity")),
        q(f"{ch}_intensity_bg_subtracted").alias(renamed(m, "intensity_bg_subtracted")))]
    raw = [q(f"{ch}_raw_mean").alias(m) for ch, m in names]
    bg = [F.when(q(f"{ch}_positive"), F.coalesce(q(f"{ch}_intensity_bg_subtracted"), F.lit(0.0))).otherwise(0.0).alias(m)
          for ch, m in names]
    return {"full": j.select(*lead, q("score").alias(f"{anchor}_score"), anchor_mean, *full),
            "raw_intensity": j.select(*lead, anchor_mean, *raw),
            "bg_subtracted": j.select(*lead, anchor_mean, *bg)}


def intensity_export(objects: DataFrame, intensities: DataFrame, markers: list[str]) -> DataFrame:
    """Object x marker table of intensities."""
    wide = intensities.groupBy("object_id").pivot("marker", markers).agg(F.first("mean_intensity"))
    return objects.join(wide, "object_id", "left")


# Share of low-anchor objects from which the report warns.
LOW_ANCHOR_WARNING = 0.05


def report_tables(df: DataFrame, score: str, combos: DataFrame, low: DataFrame, kept: DataFrame) -> dict[str, DataFrame]:
    """Tables of the report: score range, low-anchor share and QC result with their sentences, top combinations.

    ``low`` is the share of objects with a low anchor, ``kept`` the summary of the QC filter.
    """
    share = F.col("low_fraction")
    pct = F.format_number(share * 100.0, 1)
    sentence = F.when(share > LOW_ANCHOR_WARNING, F.concat(F.lit("Warning: "), pct, F.lit("% of objects have a low anchor score"))
                      ).otherwise(F.concat(pct, F.lit("% of objects have a low anchor score")))
    counts = F.format_string("Objects before filtering: %d | After: %d | Removed: %d (%.1f%%)",
                             "n_before", "n_after", "n_removed", "removed_pct")
    return {"score": score_report(df, score), "low_anchor": low.withColumn("sentence", sentence),
            "qc": kept.withColumn("sentence", counts), "top_combinations": top_combinations(combos)}


def legacy_rows(dets: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Detections of all channels as one table, coordinates to two places, with the colocalised flag."""
    hit = flags.select(*keys, "channel", "id").withColumn("colocalized", F.lit(True))
    return dets.join(shuffled(hit), [*keys, "channel", "id"], "left").select(
        *keys, "channel", F.col("id").alias("object_id"), F.round("centroid_x", 2).alias("x_coord"),
        F.round("centroid_y", 2).alias("y_coord"), F.col("mean_intensity").alias("intensity"), "area",
        F.col("score").alias("probability"), "circularity",
        F.coalesce("colocalized", F.lit(False)).alias("colocalized"))
