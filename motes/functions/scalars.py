"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """A column by its literal name; marker names may hold dots and dashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    """Missing is NULL and only NULL."""
    return F.when(~F.isnan(c), c)


def lenient_double(c: Column) -> Column:
    """Text or number to double; text that is no number, and NaN, become NULL."""
    return nan_to_null(c.try_cast("double"))


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def clip(c: Column, low: float, high: float) -> Column:
    """Clipped value; missing stays missing (``least`` and ``greatest`` skip NULLs)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def significance_label(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"))


def neg_log10(p: Column) -> Column:
    """``-log10`` of a p-value clipped to [1e-300, 1]."""
    return -F.log10(clip(p, 1e-300, 1.0))


def combination_label(channels: Column) -> Column:
    """``Negative``, ``<ch> only`` or the text-sorted channels joined by `` + ``."""
    return (F.when(F.size(channels) == 0, "Negative")
            .when(F.size(channels) == 1, F.concat(F.element_at(channels, 1), F.lit(" only")))
            .otherwise(F.array_join(F.array_sort(channels), " + ")))


def channel_id(name: Column) -> Column:
    """Short channel id (``ch0``) from a channel or file name; unknown names stay."""
    def digits(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    number = F.coalesce(digits(r"-ch(\d+)"), digits(r"ch(\d+)"))
    return (F.when(name.startswith("ch") & (F.length(name) <= 4), name)
            .otherwise(F.coalesce(F.concat(F.lit("ch"), number), name)))


def channel_number(name: Column) -> Column:
    """The number in a channel id; 999 when there is none."""
    return F.coalesce(F.regexp_extract(name, r"ch(\d+)", 1).try_cast("int"), F.lit(999))


def normalized_combination(channels: Column) -> Column:
    """Distinct channel ids in numeric order."""
    ids = F.array_distinct(F.transform(channels, channel_id))
    keyed = F.transform(ids, lambda i: F.struct(channel_number(i).alias("n"), i.alias("id")))
    return F.transform(F.array_sort(keyed), lambda s: s["id"])


def natural_number(name: Column, prefix: str) -> Column:
    """Sort number of ``<prefix><n>`` names; others last."""
    n = F.regexp_extract(F.upper(name), f"^{prefix.upper()}(\\d+)$", 1).try_cast("long")
    return F.coalesce(n, F.lit(1_000_000_000))


def movement(matrix: Column, kind: Column | None = None) -> Column:
    """dx, dy and magnitude of a transform matrix; identity or short ones do not move."""
    def shift(row: int) -> Column:
        return F.coalesce(F.try_element_at(F.try_element_at(matrix, F.lit(row)), F.lit(3)), F.lit(0.0))
    moves = F.coalesce(F.size(matrix) >= 2, F.lit(False))
    if kind is not None:
        moves = moves & (F.coalesce(kind, F.lit("identity")) != "identity")
    dx = F.when(moves, shift(1)).otherwise(0.0)
    dy = F.when(moves, shift(2)).otherwise(0.0)
    return F.struct(dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("magnitude"))


def movement_class(magnitude: Column) -> Column:
    return F.when(magnitude < 1, "low").when(magnitude < 5, "medium").otherwise("high")


def distance_verdict(mean_distance: Column) -> Column:
    return F.when(mean_distance > 20, "high").when(mean_distance > 10, "moderate").otherwise("low")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def unit_range(value: Column, dtype: Column) -> Column:
    """Scale pixel values to [0, 1] by their storage type."""
    return (F.when(dtype == "uint16", value / 65535.0)
            .when(dtype == "uint32", value / 4294967295.0)
            .when(dtype == "float32", clip(value, 0.0, 1.0))
            .when(dtype == "float64", value)
            .otherwise(value / 255.0))


def between_open(c: Column, low: float | None, high: float | None) -> Column:
    """Closed range with optional ends; a missing value counts as 0."""
    v = F.coalesce(c, F.lit(0.0))
    preds = ([v >= low] if low is not None else []) + ([v <= high] if high is not None else [])
    return all_of(preds)


def epoch_or_zero(text: Column) -> Column:
    """Seconds since epoch of an ISO time text, with their fraction; anything else is 0."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)) / 1e6, F.lit(0.0))
