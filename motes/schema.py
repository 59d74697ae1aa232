"""Marker columns of a wide object table, found by their names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The column names and name parts of an object table.
FIXED = ["object_id", "sample", "position", "centroid_x", "centroid_y", "area", "perimeter", "circularity"]
SCORE = "_score"
POSITIVE = "_positive"
RAW_MEAN = "_raw_tiff_mean"
BG_SUB = "_intensity_bg_subtracted"
RAW_PREFIX = "raw__"
BG_PREFIX = "bg__"


def missing_columns(columns: list[str], required: list[str] = FIXED) -> list[str]:
    return sorted(set(required) - set(columns))


def _bases(columns: list[str], suffix: str) -> list[str]:
    return sorted(c[: -len(suffix)] for c in columns if c.endswith(suffix) and len(c) > len(suffix))


@dataclass(frozen=True)
class MarkerSchema:
    """What the column names say; everything later works from this, not from guesses."""

    columns: tuple[str, ...]
    score: str
    markers: tuple[str, ...]
    raw_mean: bool
    bg_sub: bool
    valid: tuple[str, ...] = field(default=())

    @classmethod
    def infer(cls, columns: list[str]) -> "MarkerSchema":
        lacking = missing_columns(columns)
        if lacking:
            raise ValueError(f"missing columns: {lacking}")
        scores = [c for c in columns if c.endswith(SCORE)]
        if len(scores) != 1:
            raise ValueError(f"expected exactly one *{SCORE} column, found {scores}")
        markers = _bases(columns, POSITIVE)
        if not markers:
            raise ValueError(f"no *{POSITIVE} column")
        families = {}
        for suffix in (RAW_MEAN, BG_SUB):
            bases = _bases(columns, suffix)
            if bases and bases != markers:
                raise ValueError(f"*{suffix} columns {bases} do not cover the markers {markers}")
            families[suffix] = bool(bases)
        return cls(tuple(columns), scores[0], tuple(markers), families[RAW_MEAN], families[BG_SUB])

    @property
    def anchor(self) -> str:
        return self.score[: -len(SCORE)]

    def rate_column(self, marker: str) -> str:
        """Column whose missing share decides a marker's validity, chosen per column."""
        for c in (RAW_PREFIX + marker, marker + RAW_MEAN, marker + BG_SUB):
            if c in self.columns:
                return c
        return marker + POSITIVE

    def value_column(self, marker: str) -> str:
        """Column that supplies the marker's value."""
        if self.raw_mean:
            return marker + RAW_MEAN
        return marker + BG_SUB if self.bg_sub else marker + POSITIVE

    def prefixed(self, prefix: str) -> list[str]:
        return [c for c in self.columns if c.startswith(prefix)]

    def metadata(self, spark: SparkSession) -> DataFrame:
        """Marker table: name, source column, whether it is the score."""
        rows = [(m, self.value_column(m), False) for m in self.markers] + [(self.anchor, self.score, True)]
        return spark.createDataFrame(rows, "marker string, source_column string, is_score boolean")


def matches(columns: list[str]) -> bool:
    try:
        MarkerSchema.infer(columns)
    except ValueError:
        return False
    return True


def column_difference(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """Columns only in the left and only in the right list."""
    return sorted(set(left) - set(right)), sorted(set(right) - set(left))


def requested_markers(requested: list[str] | None, valid: list[str], present: list[str]) -> list[str]:
    """Requested, valid and present markers in schema order."""
    wanted = set(valid if requested is None else requested)
    return [m for m in valid if m in wanted and m in set(present)]


def default_reference(valid: list[str]) -> str:
    if not valid:
        raise ValueError("no valid marker")
    return valid[0]
