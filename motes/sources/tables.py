"""Scans: object tables, detection tables, dimensions and saved results."""

from __future__ import annotations

import csv
import json
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motes.functions.scalars import lenient_double, natural_number, q
from motes.schema import BG_PREFIX, BG_SUB, FIXED, POSITIVE, RAW_MEAN, RAW_PREFIX, MarkerSchema, column_difference
from motes.session import checkpoint, saved, small_side


def read_table(spark: SparkSession, path, fmt: str | None = None) -> DataFrame:
    """CSV (all text, typed later), JSON lines or Parquet, by name or by ``fmt``."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or ("csv" if first.endswith(".csv") else "json" if first.endswith((".json", ".jsonl")) else "parquet")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def typed_objects(df: DataFrame, schema: MarkerSchema | None = None) -> DataFrame:
    """Strict types for ids, coordinates, shape and score (a bad cell fails the job),
    lenient ones for marker columns (a bad cell is missing).  NaN becomes NULL."""
    schema = schema or MarkerSchema.infer(df.columns)
    out = []
    for c in df.columns:
        if c == "object_id":
            out.append(q(c).cast("long").alias(c))
        elif c in ("sample", "position"):
            out.append(q(c).cast("string").alias(c))
        elif c in FIXED or c == schema.score:
            out.append(F.nullif(q(c).cast("double"), F.lit(float("nan"))).alias(c))
        elif c.endswith((POSITIVE, RAW_MEAN, BG_SUB)) or c.startswith((RAW_PREFIX, BG_PREFIX)):
            flag = F.lower(F.trim(q(c).cast("string")))
            text = F.when(flag == "true", "1").when(flag == "false", "0").otherwise(flag)
            out.append(lenient_double(text).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def missing_shares(df: DataFrame, schema: MarkerSchema) -> dict[str, float]:
    """Share of missing cells per marker in its rate column; one scan for all markers."""
    aggs = [F.avg(q(schema.rate_column(m)).isNull().cast("double")).alias(str(i))
            for i, m in enumerate(schema.markers)]
    row = df.agg(*aggs).first()
    return {m: (row[i] if row[i] is not None else 1.0) for i, m in enumerate(schema.markers)}


def valid_markers(shares: dict[str, float], threshold: float = 0.5) -> list[str]:
    """Markers under the threshold; when none is, all markers tied at the lowest share."""
    keep = [m for m, s in shares.items() if s <= threshold]
    if keep or not shares:
        return keep
    low = min(shares.values())
    return [m for m, s in shares.items() if s == low]


def load_objects(df: DataFrame, threshold: float = 0.5, write_once: bool = False) -> tuple[DataFrame, MarkerSchema]:
    """Typed object table with one value column per marker, and its schema with the valid markers.

    ``write_once`` keeps the typed table in the checkpoint folder: text is parsed once, whatever
    number of tables is derived, and each reads only its own columns.
    """
    schema = MarkerSchema.infer(df.columns)
    typed = typed_objects(df, schema)
    if write_once:
        typed = saved(typed)
    valid = valid_markers(missing_shares(typed, schema), threshold)
    typed = typed.na.fill(0.0, [m + POSITIVE for m in schema.markers])
    typed = typed.withColumns({m: q(schema.value_column(m)) for m in schema.markers})
    return typed, MarkerSchema(schema.columns, schema.score, schema.markers, schema.raw_mean,
                               schema.bg_sub, tuple(valid))


def prefixed_matrix(df: DataFrame, prefix: str) -> DataFrame:
    """``raw__*`` or ``bg__*`` columns with the prefix stripped, keyed by object_id."""
    return df.select("object_id", *[q(c).alias(c[len(prefix):]) for c in df.columns if c.startswith(prefix)])


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with equal columns (any order); otherwise says what differs.

    ``object_id`` is renumbered 1..N only when ids repeat across the union.
    """
    first = frames[0]
    for i, f in enumerate(frames[1:], 2):
        less, more = column_difference(first.columns, f.columns)
        if less or more:
            raise ValueError(f"table {i}: missing columns {less}, extra columns {more}")
    both = reduce(DataFrame.unionByName, [f.select(*[q(c) for c in first.columns]) for f in frames])
    # a repeated id is a group of two or more: no global distinct set is kept anywhere
    repeats = both.groupBy("object_id").count().where(F.col("count") > 1)
    return both if repeats.isEmpty() else renumbered(both)


def renumbered(df: DataFrame, id: str = "object_id") -> DataFrame:
    """Consecutive ids 1..N in row order, without sorting.

    A row's ordinal is its partition and its place in it.  The rows are written
    once, so the ordinals stay what they are; partition sizes give the offsets.
    """
    rows = checkpoint(df.drop(id).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (rows.withColumn("_part", part).join(small_side(starts), "_part")
            .withColumn(id, F.col("_start") + place).select(*[q(c) for c in df.columns]))


def enriched(full: DataFrame, raw: DataFrame, background: DataFrame) -> DataFrame:
    """Object table plus the raw and background tables' own columns under ``raw__`` / ``bg__``."""
    def own(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("object_id", *[q(c).alias(prefix + c) for c in df.columns if c not in FIXED])
    return full.join(own(raw, RAW_PREFIX), "object_id", "left").join(own(background, BG_PREFIX), "object_id", "left")


def first_matching(candidates: list[DataFrame], test) -> DataFrame:
    """First candidate whose columns pass ``test``."""
    for df in candidates:
        if test(df.columns):
            return df
    raise ValueError("no candidate table has the expected columns")


# -- detections ------------------------------------------------------------

# Directory layout .../<sample>/<position>/<channel>/<name>_<yyyymmdd>_<hhmmss>.csv
DETECTION_PATH = r"([^/]+)/([^/]+)/([^/]+)/([^/]*?(\d{8}_\d{6})[^/]*)$"
# Columns of a detection file.
DETECTION_COLUMNS = ("id", "area", "perimeter", "circularity", "centroid_x", "centroid_y", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
                     "score", "mean_intensity")


def path_keys(path: Column) -> dict[str, Column]:
    """sample, position, channel and stamp of a detection file path."""
    part = {"sample": 1, "position": 2, "channel": 3, "stamp": 5}
    return {n: F.regexp_extract(path, DETECTION_PATH, i) for n, i in part.items()}


def latest(df: DataFrame, keys: list[str], newest: list[Column | str]) -> DataFrame:
    """The newest row of every key, ties by the later entries of ``newest`` (descending).

    The row-number filter is applied before the shuffle as well, so a key with very
    many versions sends one row per task.
    """
    order = [F.desc(c) if isinstance(c, str) else c for c in newest]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_newest", F.row_number().over(w)).where(F.col("_newest") == 1).drop("_newest")


def plain_path(path: Column) -> Column:
    """A file path of the scan's metadata without escapes, in the form a listing has."""
    # url_decode reads '+' as a blank, file paths mean it.
    text = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(text, "^([A-Za-z][A-Za-z0-9+.-]*:)//(?=/)", "$1")


def folder_keys(path: Column) -> dict[str, Column]:
    """sample, position, channel (the three folders) and file of a detection file path."""
    part = F.split(path, "/")
    return {n: F.element_at(part, -4 + i) for i, n in enumerate(("sample", "position", "channel", "file"))}


def newest_paths(spark: SparkSession, root: str, pattern: str = "*_results_*.csv") -> DataFrame:
    """sample, position, channel, file, path: the file that comes last by name in every channel folder.

    Lists names only and opens no file.  A file that does not lie three folders below ``root`` is none of these.
    """
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
              .load(root).select("path"))
    below = F.substring(F.col("path"), F.lit(len(top) + 2), F.length("path"))
    listed = listed.where(F.size(F.split(below, "/")) == 4).withColumns(folder_keys(F.col("path")))
    best = F.max(F.struct("file", "path")).alias("_b")
    return listed.groupBy("sample", "position", "channel").agg(best).select("sample", "position", "channel", "_b.file", "_b.path")


def header_of(line: str) -> list[str]:
    """Column names of a CSV header line; unnamed and repeated ones get names of their own."""
    names: list[str] = []
    for i, c in enumerate(next(csv.reader([line.lstrip("\ufeff")]))):
        names.append(c if c and c not in names else f"_c{i}")
    return names


def latest_files(spark: SparkSession, root: str) -> DataFrame:
    """Detections from the newest file of every (sample, position, channel) under ``root``.

    A listing chooses the files, older ones are never opened.  The header of each chosen file counts, whatever
    the others have: files are read in groups of equal headers, each with its own schema, and joined by name.
    The list of chosen paths (one per channel) is held by the driver, as by every scan.
    """
    chosen = [r.path for r in newest_paths(spark, root).select("path").collect()]
    # A reader takes these characters of a path for patterns.
    chosen = [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in chosen]
    blank = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ("sample", "position", "channel", *DETECTION_COLUMNS)))
    if not chosen:
        return detections(blank)
    # The header is the line with a column name for a cell: cells of data are numbers.
    cell = r'(^|,)\s*"?(' + "|".join(DETECTION_COLUMNS) + r')"?\s*(,|$)'
    path = F.col("_metadata.file_path")
    lines = spark.read.text(chosen).where(F.col("value").rlike(cell))
    heads = lines.select(F.rtrim("value").alias("head"), path.alias("path")).groupBy("head").agg(F.collect_set("path").alias("paths")).collect()
    parts = [blank]
    for h in heads:
        names = header_of(h.head)
        part = (spark.read.schema(", ".join(f"`{n.replace('`', '``')}` string" for n in names)).option("header", True)
                .csv([re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(p)) for p in h.paths]))
        keys = folder_keys(plain_path(path))
        parts.append(part.select(*[keys[k].alias(k) for k in ("sample", "position", "channel")],
                                 *[q(c) for c in names if c in DETECTION_COLUMNS]))
    return detections(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def detections(df: DataFrame) -> DataFrame:
    """Detection columns in their types; blanks count as 0 except the intensity."""
    nums = ["area", "perimeter", "circularity", "centroid_x", "centroid_y",
            "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "score"]
    keys = [c for c in ("sample", "position", "channel") if c in df.columns]
    intensity = lenient_double(q("mean_intensity")) if "mean_intensity" in df.columns else F.lit(None).cast("double")
    finite = F.when(F.abs(intensity) != float("inf"), intensity)
    return df.select(*keys, F.coalesce(q("id").try_cast("long"), F.lit(0)).alias("id"),
                     *[F.coalesce(lenient_double(q(c)), F.lit(0.0)).alias(c) for c in nums],
                     finite.alias("mean_intensity"))


def true_text(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def legacy_detections(df: DataFrame) -> DataFrame:
    """Older detection table; ``colocalized`` is text."""
    return df.select("channel", q("object_id").cast("long").alias("object_id"),
                     *[lenient_double(q(c)).alias(c) for c in ("x_coord", "y_coord", "intensity", "area",
                                                               "probability", "circularity") if c in df.columns],
                     true_text(q("colocalized")).alias("colocalized"))


# -- dimensions ------------------------------------------------------------

def marker_dimension(df: DataFrame, blank_channel: str | None = None) -> DataFrame:
    """(cycle, channel, marker) with cycle upper-cased and channel as ``CH<n>``.

    Without ``blank_channel``: rows lacking a channel go, blank markers stay as ''.
    With it: a missing channel takes that name and rows lacking a marker go.
    """
    def clean(name: str) -> Column:
        return F.coalesce(F.trim(q(name).cast("string")), F.lit(""))
    cycle, marker = F.upper(clean("cycle")), clean("marker")
    raw = F.upper(clean("channel"))
    channel = (F.when(raw == "", F.lit(blank_channel or ""))
               .when(raw.startswith("CH"), raw)
               .when(raw.rlike(r"^\d+$"), F.concat(F.lit("CH"), raw))
               .otherwise(raw))
    out = df.select(cycle.alias("cycle"), channel.alias("channel"), marker.alias("marker"))
    out = out.where((F.col("cycle") != "") & (F.col("cycle") != "CYCLE"))
    out = out.where(F.col("channel") != "") if blank_channel is None else out.where(F.col("marker") != "")
    return out.orderBy(natural_number(F.col("cycle"), "C"), natural_number(F.col("channel"), "CH"), "cycle", "channel")


def with_marker(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Marker name by (cycle, channel); unknown ones get ''."""
    return (df.join(small_side(dim.select("cycle", "channel", "marker")), ["cycle", "channel"], "left")
            .na.fill("", ["marker"]))


def channel_key(file_name: Column, index: Column) -> Column:
    """``C<cycle>_ch<n>`` or ``C<cycle>`` from an image file name, else ``C<index>``."""
    both = r"(?i)[_-]C(\d+)[_-]Ch(\d+)\.tiff?$"
    one = r"(?i)[_-]C(\d+)\.tiff?$"
    return (F.when(file_name.rlike(both), F.concat(F.lit("C"), F.regexp_extract(file_name, both, 1),
                                                   F.lit("_ch"), F.regexp_extract(file_name, both, 2)))
            .when(file_name.rlike(one), F.concat(F.lit("C"), F.regexp_extract(file_name, one, 1)))
            .otherwise(F.concat(F.lit("C"), index.cast("string"))))


def ground_truth_points(df: DataFrame, pixel_size: float = 0.21) -> DataFrame:
    """Points in µm and px; the columns are found by part of their names."""
    def named(axis: str) -> str:
        hits = [c for c in df.columns if f"center of mass {axis}" in c.lower()]
        if not hits:
            raise ValueError(f"no 'Center of Mass {axis.upper()}' column")
        return hits[0]
    x, y = lenient_double(q(named("x"))), lenient_double(q(named("y")))
    out = df.select(x.alias("x_um"), y.alias("y_um"))
    inf = float("inf")
    out = out.where((F.abs("x_um") < inf) & (F.abs("y_um") < inf))
    return out.withColumns({"x_px": F.col("x_um") / pixel_size, "y_px": F.col("y_um") / pixel_size})


def confidence_threshold(run_json: Column, default: float = 0.5) -> Column:
    """``settings.confidence_threshold`` of a run document; the default on any failure."""
    return F.coalesce(lenient_double(F.get_json_object(run_json, "$.settings.confidence_threshold")), F.lit(default))


def saved_id_filter(text: str | None) -> list[int] | None:
    """Ids of a saved filter; None keeps everything, an empty list nothing.

    Only ``enabled: false`` switches a filter off; a broken document or one without a list
    of ids is no filter.  Ids may be numbers or their texts; others are skipped.
    """
    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(doc, dict) or doc.get("enabled") is False or not isinstance(doc.get("objectIds"), list):
        return None
    out = []
    for v in doc["objectIds"]:
        try:
            out.append(int(float(v)))
        except (TypeError, ValueError, OverflowError):
            continue
    return out


def saved_filters(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Active filter documents as a table: keys and the list ``ids``, by the rules of
    :func:`saved_id_filter`.  A key without a row has no filter."""
    doc = F.try_parse_json(F.col(text))
    part = lambda p: F.try_variant_get("_v", p, "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    off = (kind(part("$.enabled")) == "BOOLEAN") & (part("$.enabled").cast("string") == "false")
    number = lambda e: F.when(e.cast("string") == "true", 1.0).when(e.cast("string") == "false", 0.0).otherwise(
        lenient_double(e.cast("string")))
    values = F.transform(F.try_variant_get("_v", "$.objectIds", "array<variant>"), number)
    finite = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parsed = df.select(*keys, doc.alias("_v"))
    active = parsed.where(kind(F.col("_v")).startswith("OBJECT") & ~off & kind(part("$.objectIds")).startswith("ARRAY"))
    return active.select(*keys, F.transform(finite, lambda x: x.cast("bigint")).alias("ids"))


def with_saved_filters(dets: DataFrame, filters: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """Detections that their key's filter keeps; all of a key without one."""
    named = filters.select(*keys, F.lit(True).alias("_on"), "ids")
    marked = dets.join(named.select(*keys, "_on").distinct(), keys, "left")
    kept = named.select(*keys, F.explode("ids").alias(id_)).distinct()
    return marked.where(F.col("_on").isNull()).drop("_on").unionByName(
        marked.where("_on").drop("_on").join(kept, [*keys, id_], "left_semi"))


def parsed_json_cells(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Read back a wide table whose nested cells were stored as JSON text."""
    return df.withColumns({c: F.from_json(q(c), t) for c, t in cells.items()})


def model_catalogue(df: DataFrame) -> DataFrame:
    """Newest model per training position (later path wins a tie), newest first."""
    return latest(df, ["position"], ["saved_at", "path"]).orderBy(F.desc("saved_at"), F.desc("path"))


def sample_positions(df: DataFrame, name: str = "name") -> DataFrame:
    """Position folders ``P<n>`` and their crop variants, by number, plain before crop."""
    pat = r"(?i)^P(\d+)(.*)$"
    return (df.where(F.col(name).rlike(r"(?i)^P\d+([_-]?crop.*)?$")).select(
        name, F.regexp_extract(name, pat, 1).cast("int").alias("number"),
        (F.regexp_extract(name, pat, 2) != "").alias("is_crop")).distinct().orderBy("number", "is_crop", name))


# The artefact kinds and the file names that mark them.
ARTEFACTS = {"csv": r"_results_[^/]*\.csv$", "masks": r"_masks_[^/]*\.npz$", "overlay": r"_overlay_[^/]*\.png$", "run": r"_run_[^/]*\.json$"}


def with_biomarker(df: DataFrame, dim: DataFrame, channel: str = "channel") -> DataFrame:
    """Adds ``biomarker``: the marker of channel keys such as ``C1_ch2``; '' for other keys and unknown channels.

    ``dim`` has cycle, channel and marker, and may have ``sample``, when each sample has names of its own.
    Of repeated names the largest counts.
    """
    by = [c for c in ("sample",) if c in dim.columns and c in df.columns]
    names = dim.groupBy(*by, F.upper("cycle").alias("_cycle"), F.upper("channel").alias("_number")).agg(
        F.max("marker").alias("biomarker"))
    parts, plain = F.split(F.upper(q(channel)), "_"), q(channel).contains("_ch")
    keyed = df.withColumns({"_cycle": F.when(plain, F.get(parts, F.lit(0))), "_number": F.when(plain, F.get(parts, F.lit(1)))})
    return (keyed.join(small_side(names), [*by, "_cycle", "_number"], "left").drop("_cycle", "_number")
            .withColumn("biomarker", F.coalesce("biomarker", F.lit(""))))


def artefact_inventory(files: DataFrame, keys: list[str], path: str = "path", dim: DataFrame | None = None) -> DataFrame:
    """Newest artefact of each kind per key; a key counts only when it has a csv.

    With the marker dimension ``dim``, and ``channel`` among the keys, also the ``biomarker`` of each channel.
    """
    kind = reduce(lambda acc, kv: acc.when(F.col(path).rlike(kv[1]), kv[0]),
                  list(ARTEFACTS.items())[1:], F.when(F.col(path).rlike(ARTEFACTS["csv"]), "csv"))
    wide = files.withColumn("_kind", kind).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_kind") == k, F.col(path))).alias(f"{k}_path") for k in ARTEFACTS])
    out = wide.withColumns({f"has_{k}": F.col(f"{k}_path").isNotNull() for k in ARTEFACTS})
    out = out.withColumns({"included": F.col("has_csv"),
                           "skip_reason": F.when(~F.col("has_csv"), "missing_results_csv")})
    return out if dim is None else with_biomarker(out, dim)


def preferred_source(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Path with the lowest ``priority`` per key, ties to the smaller path."""
    best = F.min(F.struct("priority", "path")).alias("_b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_b.path", "_b.priority")


# Where a detection image is looked for, in this order; the stages between are cached ones.
IMAGE_STAGES = ["aligned", "raw", "processed", "contrast_enhance", "step1", "step2", "step3", "step4", "folder"]


def preferred_image(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Image path and its stage per key; both NULL where nothing is found.

    Candidates have ``stage``, ``path`` and ``exists``.  An aligned file comes first if it exists.  Then the
    first cached stage counts, and only that one: if its file is gone the folder is next, not a later stage.
    """
    stage, path, there = F.col("stage"), F.col("path"), F.col("exists")
    place = F.array_position(F.array(*[F.lit(s) for s in IMAGE_STAGES]), stage)
    found = {s: F.min(F.when((stage == s) & there, path)).alias(f"_{s}") for s in ("aligned", "folder")}
    cached = F.min(F.when(stage.isin(IMAGE_STAGES[1:-1]), F.struct(place.alias("place"), "path", "stage", "exists"))).alias("_cached")
    best = candidates.groupBy(*keys).agg(*found.values(), cached)
    hit = lambda name: F.when(F.col("_cached.exists"), F.col(f"_cached.{name}"))
    label = F.when(F.col("_aligned").isNotNull(), "aligned").otherwise(
        F.coalesce(hit("stage"), F.when(F.col("_folder").isNotNull(), "folder")))
    return best.select(*keys, F.coalesce("_aligned", hit("path"), "_folder").alias("path"), label.alias("stage"))
