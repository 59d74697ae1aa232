"""Image manifests and operation logs as event tables; parameter tables and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.functions.scalars import clip, lenient_double, short_hash
from motes.operators.ordering import carried

# Statuses of a manifest record, and those that are processed by default.
STATUSES = ["recommended", "approved", "edited", "applied", "failed", "cancelled"]
READY = ["recommended", "approved", "edited"]

# Name, type, lowest, highest and allowed texts of the known parameters.
PARAMETERS = [
    ("denoising_strength", "float", 0.0, 1.0, None),
    ("background_subtraction_radius", "int", 1.0, 500.0, None),
    ("clahe_clip_limit", "float", 0.1, 10.0, None),
    ("clahe_grid_size", "int", 2.0, 32.0, None),
    ("threshold_value", "int", 0.0, 255.0, None),
    ("threshold_method", "str", None, None, ["otsu", "adaptive", "binary", "fixed"]),
    ("gamma_correction", "float", 0.1, 5.0, None),
    ("sharpening_strength", "float", 0.0, 2.0, None),
    ("contrast_alpha", "float", 0.5, 3.0, None),
    ("brightness_beta", "int", -100.0, 100.0, None),
]


def parameter_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PARAMETERS, "name string, type string, low double, high double, allowed array<string>")


def clamped_params(params: DataFrame, keys: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """Long parameters (keys, name, value text) typed and clamped: adds ``clean``, ``error``, ``known``.

    Unknown names keep their value.  A text that is not allowed, or no number where
    one is needed, gives an error message and no clean value.
    """
    r = F.broadcast(ranges if ranges is not None else parameter_ranges(params.sparkSession))
    j = params.join(r, "name", "left")
    num = lenient_double(F.col("value"))
    num = F.when(F.col("type") == "int", F.when(num >= 0, F.floor(num)).otherwise(F.ceil(num)).cast("double")).otherwise(num)
    bound = F.when(num.isNotNull(), F.least(F.greatest(num, F.col("low")), F.col("high")))
    text = F.when(F.col("type") == "int", bound.cast("long").cast("string")).otherwise(bound.cast("string"))
    bad_text = (F.col("type") == "str") & ~F.array_contains("allowed", F.col("value"))
    bad_num = F.col("type").isin("int", "float") & num.isNull()
    error = F.when(bad_text, "not allowed").when(bad_num, "not a number")
    clean = (F.when(F.col("type").isNull(), F.col("value")).when(error.isNotNull(), None)
             .when(F.col("type") == "str", F.col("value")).otherwise(text))
    return j.select(*keys, "name", "value", clean.alias("clean"), error.alias("error"),
                    F.col("type").isNotNull().alias("known"),
                    F.when(F.col("type").isin("int", "float"), bound).alias("number"))



def clamped_maps(df: DataFrame, params: str = "params") -> DataFrame:
    """The map column with every known number clamped; done in place, without a join."""
    def clean(name: Column, value: Column) -> Column:
        out = value
        for n, kind, low, high, _ in PARAMETERS:
            if kind == "str":
                continue
            num = clip(lenient_double(value), low, high)
            text = num.cast("long").cast("string") if kind == "int" else num.cast("string")
            out = F.when(name == n, text).otherwise(out)
        return out
    return df.withColumn(params, F.transform_values(params, clean))


def current_state(events: DataFrame, key: list[str] = ["image_id"], ts: str = "ts") -> DataFrame:
    """Fold of the event table: latest status and the latest given value of every other column.

    Each column is one map-side maximum by time, so an image with a very long
    history costs no sort.  Events of one time are ordered by all their columns, so the
    same event wins for every column and in every run.
    """
    rest = [c for c in events.columns if c not in [*key, ts]]
    kinds = {f.name: f.dataType.typeName() for f in events.schema.fields}
    order = F.struct(ts, *[F.to_json(c).alias(c) if kinds[c] in ("map", "struct", "array", "variant") else F.col(c) for c in rest])
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
    return events.groupBy(*key).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"),
                                    F.count("*").alias("events"), *aggs)


def recommendation_history(events: DataFrame, key: list[str] = ["image_id"], ts: str = "ts",
                           params: str = "recommended_params") -> DataFrame:
    """Earlier recommendations that were replaced by a different one, with the time of the change."""
    e = events.where(F.col(params).isNotNull())
    text = F.to_json(params) if events.schema[params].dataType.typeName() in ("map", "struct") else F.col(params)
    e = carried(e.withColumn("_text", text), key, ts, "_text", "_prev", include_self=False)
    return e.where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_text"))).select(
        *key, F.col(ts).alias("changed_at"), F.col("_prev").alias("previous"), F.col("_text").alias("current"))


def approvals(events: DataFrame, key: list[str] = ["image_id"], ts: str = "ts",
              recommended: str = "recommended_params", final: str = "final_params") -> DataFrame:
    """Status of each approval: ``edited`` when it differs from the latest recommendation."""
    e = carried(events, key, ts, recommended, "_rec", include_self=True).where(F.col(final).isNotNull())
    same = F.col(final).eqNullSafe(F.col("_rec"))
    return e.select(*key, ts, F.col(final), F.col("_rec").alias("latest_recommended"),
                    F.when(same, "approved").otherwise("edited").alias("status"))


def effective_params(df: DataFrame, final: str = "final_params", recommended: str = "recommended_params") -> DataFrame:
    return df.withColumn("params", F.coalesce(final, recommended))


def to_process(df: DataFrame, statuses: list[str] | None = None, force: bool = False) -> DataFrame:
    """Records to process; ``force`` takes all that have parameters."""
    p = effective_params(df)
    has = F.col("params").isNotNull()
    return p.where(has if force else has & F.col("status").isin(statuses or READY))


def channel_params(channels: DataFrame, given: DataFrame, keys: list[str], name: str,
                   global_value: str | None, constant: str) -> DataFrame:
    """Value of one parameter per channel: the channel's own, else global, else a constant."""
    own = given.where(F.col("name") == name).select(*keys, "channel", F.col("value").alias("_own"))
    return channels.join(own, [*keys, "channel"], "left").select(
        *keys, "channel", F.coalesce("_own", F.lit(global_value), F.lit(constant)).alias(name))


def status_counts(df: DataFrame, keys: list[str] = []) -> DataFrame:
    s = F.col("status")
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == "applied").alias("success"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "cancelled").alias("cancelled"),
        F.count_if(~s.isin("applied", "failed", "cancelled")).alias("skipped"))


def run_list(df: DataFrame, run: str = "run_id", image: str = "image_id", ts: str = "ts") -> DataFrame:
    """Runs with distinct images and first/last time, newest first."""
    per = df.groupBy(run, image).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return per.groupBy(run).agg(F.count("*").alias("images"), F.min("_a").alias("started"),
                                F.max("_b").alias("finished")).orderBy(F.desc("finished"), run)


def sample_outcomes(df: DataFrame, ok: str = "ok") -> DataFrame:
    n, good = F.count("*"), F.count_if(F.col(ok))
    return df.agg(n.alias("samples"), good.alias("succeeded"), (n - good).alias("failed"))


def image_id(path: Column, frame: Column | None = None) -> Column:
    """Stable id: first 16 hex digits of SHA-256 of path, or of path:frame."""
    text = path if frame is None else F.when(frame.isNull(), path).otherwise(
        F.concat(path, F.lit(":"), frame.cast("string")))
    return short_hash(text)


def version_hash(params: Column) -> Column:
    """Hash of a parameter map in key order."""
    ordered = F.array_sort(F.map_entries(params))
    return short_hash(F.to_json(F.map_from_entries(ordered)))



# -- parameter texts -----------------------------------------------------------

# Section markers and key patterns of the answer format, with result types.
DIAGNOSIS = r"(?is)\[IMAGE_DIAGNOSIS\](.*?)(?=\[RECOMMENDED_PREPROCESSING_PARAMETERS\]|\[CONFIDENCE\]|$)"
PARAMETER_SECTION = r"(?is)\[RECOMMENDED_PREPROCESSING_PARAMETERS\](.*?)(?=\[CONFIDENCE\]|$)"
CONFIDENCE = r"(?is)\[CONFIDENCE\].*?Overall confidence score.*?([\d.]+)"
TEXT_PARAMETERS = {
    "bit_depth_conversion": (r"(?i)16-bit → 8-bit\s*\(yes\s*/\s*no\)\s*:\s*(yes|no)", "boolean"),
    "median_filter_kernel_size": (r"(?i)Median filter kernel size:\s*(\d+)", "int"),
    "gaussian_blur_sigma": (r"(?i)Gaussian blur sigma:\s*([\d.]+)", "double"),
    "background_subtraction_sigma": (r"(?is)Background subtraction.*?Sigma:\s*([\d.]+)", "double"),
    "percentile_low": (r"(?i)Percentile low:\s*([\d.]+)", "double"),
    "percentile_high": (r"(?i)Percentile high:\s*([\d.]+)", "double"),
    "clahe_clip_limit": (r"(?i)Clip limit:\s*([\d.]+)", "double"),
    "clahe_grid_size": (r"(?i)Tile grid size:\s*(\d+)\s*x\s*\d+", "int"),
    "sharpening_blur_sigma": (r"(?i)Blur sigma:\s*([\d.]+)", "double"),
    "sharpening_alpha": (r"(?i)Strength\s*\(alpha\):\s*([\d.]+)", "double"),
    "sharpening_beta": (r"(?i)Subtraction weight\s*\(beta\):\s*([\d.]+)", "double"),
}
DEFAULT_CONFIDENCE = 0.8


def text_parameters(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Parameters, confidence and the diagnosis map read from answer texts; built-in regex only."""
    def found(c: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    section = F.regexp_extract(text, PARAMETER_SECTION, 1)
    t = texts.withColumn("_s", section)
    out = []
    for name, (pattern, kind) in TEXT_PARAMETERS.items():
        v = found(F.col("_s"), pattern)
        out.append((F.lower(v) == "yes" if kind == "boolean" else v.try_cast(kind)).alias(name))
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, DIAGNOSIS, 1), "\n"), lambda s: F.trim(s)),
                     lambda s: F.instr(s, ":") > 0)
    pairs = F.transform(lines, lambda s: F.struct(
        F.replace(F.lower(F.trim(F.substring_index(s, ":", 1))), F.lit(" "), F.lit("_")).alias("k"),
        F.lower(F.trim(F.substr(s, F.instr(s, ":") + 1))).alias("v")))
    # the last line of a repeated key counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == p["k"]))
    return t.select(*keys, *out, F.coalesce(found(F.col(text), CONFIDENCE).try_cast("double"),
                                            F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
                    F.map_from_entries(last).alias("diagnosis"))


# -- operation log ---------------------------------------------------------

LOG_SCHEMA = ("time string, user_action string, step_name string, params map<string,string>, "
              "input_stage string, output_stage string, version_hash string, sample string, position string")


def log_state(log: DataFrame, keys: list[str] = ["sample", "position"]) -> DataFrame:
    """Latest step, stage and hash per key with the number of steps."""
    t = F.col("time")
    newest = F.max_by(F.struct("step_name", "output_stage", "version_hash"), t).alias("_l")
    return log.groupBy(*keys).agg(F.count("*").alias("steps"), F.max(t).alias("updated_at"), newest).select(
        *keys, "steps", "updated_at", "_l.*")



# -- answers and patches as JSON -------------------------------------------------

def _members(df: DataFrame, value: str, name: str, member: str) -> DataFrame:
    """A row per member of the JSON objects in ``value`` (VARIANT); rows without any are left out."""
    each = df.sparkSession.tvf.variant_explode(F.col(value).outer())
    return df.lateralJoin(each.select(F.col("key").alias(name), F.col("value").alias(member))).where(F.col(name).isNotNull())


def _is_object(v: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.col(v)).startswith("OBJECT"), F.lit(False))


def json_parameters(answers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Parameters of answers given as JSON objects: keys, ``name`` and ``value`` (JSON text).

    ``recommended_parameters`` counts first: a parameter that is an object with a ``value`` stands for
    it, any other for itself.  Without it, ``parameters`` is taken as it is.  Texts that are no JSON
    object give no rows; :func:`text_parameters` reads those.
    """
    v = answers.select(*keys, F.try_parse_json(text).alias("_v")).where(_is_object("_v"))
    both = v.select(*keys, F.try_variant_get("_v", "$.recommended_parameters", "variant").alias("_r"),
                    F.try_variant_get("_v", "$.parameters", "variant").alias("_p"))
    m = _members(both.where(_is_object("_r")), "_r", "name", "_m")
    inner = F.try_variant_get("_m", "$.value", "variant")
    first = m.select(*keys, "name", F.to_json(F.when(_is_object("_m") & inner.isNotNull(), inner).otherwise(F.col("_m"))).alias("value"))
    rest = _members(both.where(F.col("_r").isNull() & _is_object("_p")), "_p", "name", "_m")
    return first.unionByName(rest.select(*keys, "name", F.to_json("_m").alias("value")))


def folded_patches(patches: DataFrame, keys: list[str], order: str, patch: str = "patch") -> DataFrame:
    """State after all JSON patches of a key, in ``order``: keys, ``name``, ``member`` and ``value`` (JSON text).

    Later values replace earlier ones, but an object patched onto an object is merged one level
    deep.  A member of such an object is a row of its own, a plain value has no member, and an empty
    object has neither member nor value.  The fold is two aggregations, which combine map-side: the
    last plain value of a name, then the last value of each member patched after it.
    """
    v = patches.select(*keys, order, F.try_parse_json(patch).alias("_v")).where(_is_object("_v"))
    top = _members(v, "_v", "name", "_m").withColumn("_obj", _is_object("_m"))
    at = F.col(order)
    last = top.groupBy(*keys, "name").agg(
        F.max(F.when(~F.col("_obj"), at)).alias("_plain"), F.max(F.when(F.col("_obj"), at)).alias("_deep"),
        F.max_by(F.when(~F.col("_obj"), F.to_json("_m")), F.when(~F.col("_obj"), at)).alias("value"))
    deep = F.col("_deep").isNotNull() & (F.col("_plain").isNull() | (F.col("_deep") > F.col("_plain")))
    plain = last.where(~deep).select(*keys, "name", F.lit(None).cast("string").alias("member"), "value")
    later = top.where("_obj").join(last.where(deep).select(*keys, "name", "_plain"), [*keys, "name"]).where(
        F.col("_plain").isNull() | (at > F.col("_plain")))
    inside = _members(later, "_m", "member", "_x").groupBy(*keys, "name", "member").agg(F.max_by(F.to_json("_x"), at).alias("value"))
    bare = last.where(deep).join(inside.select(*keys, "name").distinct(), [*keys, "name"], "left_anti").select(
        *keys, "name", F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("value"))
    return plain.unionByName(inside).unionByName(bare)
