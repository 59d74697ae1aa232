"""The two end-to-end analyses: object-table statistics and spatial colocalisation.

Both return named lazy tables; the export sink writes the ones a user wants.  What several of them share
(typed rows, component coordinates, matches, the long reference table) is written once to the checkpoint
folder, so the input is read and matched once for all sinks.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motes.operators import coloc, compare, cooccur, learn, matrix, profile, qc, spatial
from motes.plans.fixtures import MARKERS, objects
from motes.schema import BG_PREFIX, RAW_PREFIX, default_reference, requested_markers
from motes.session import saved
from motes.sources import export, tables


def describe_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """QC, anchor normalisation, then the description of every marker by sample."""
    o = objects(spark, sf)
    kept = qc.qc_filter(o, qc.qc_predicates(o.columns))
    n = matrix.normalize(kept, "pan_score", {m: m for m in MARKERS})
    return compare.describe(matrix.long_form(n, MARKERS))


def object_statistics(raw: DataFrame, *, nan_threshold: float = 0.5, use_filtered: bool = False,
                      binarize: str = "auto", percentile: float = 95.0, reference: str | None = None,
                      draws: int = 1000, clusters: int = 5, markers: list[str] | None = None,
                      space: str = "pca") -> dict[str, DataFrame]:
    """Load, QC, normalise, scale, binarise, co-occurrence, PCA, k-means, comparison, position QC.

    ``binarize`` = ``auto`` thresholds the loaded marker values at 0.5, as the load
    marks them as positives already; ``matrix`` takes a percentile of the normalised
    values.  The QC result is reported but, unless asked for, not used further on.
    ``markers`` narrows the valid markers; ``space`` is where k-means runs: ``pca`` or ``scaled`` features.
    """
    df, schema = tables.load_objects(raw, nan_threshold, write_once=True)
    schema = replace(schema, valid=tuple(requested_markers(markers, list(schema.valid), df.columns)))
    valid = list(schema.valid)
    preds = qc.qc_predicates(df.columns)
    filtered = qc.qc_filter(df, preds)
    work = filtered if use_filtered else df
    anchor, source = matrix.normalization_source(schema)
    normalized = matrix.normalize(work, anchor, source)
    scaled = matrix.scale(normalized, list(source), "zscore")
    if binarize == "auto":
        binary, thresholds = matrix.binarize_source(work, {m: m for m in valid})
    else:
        thresholds = matrix.thresholds_percentile(normalized, valid, percentile)
        binary = matrix.binarize(normalized, valid, thresholds)
    ref = reference or default_reference(valid)
    feats = learn.features(work, learn.feature_source(schema))
    coords, variance = learn.pca(feats, valid, min(2, len(valid)))
    coords = saved(coords)
    where = (coords, [f"pc{i + 1}" for i in range(min(2, len(valid)))]) if space == "pca" else learn.space(feats, valid, space)
    labels, _ = learn.kmeans(*where, clusters)
    compared = compare.compare_samples(matrix.long_form(normalized, list(source)))
    out = {
        "cleaned": df, "qc_filtered": filtered, "qc_summary": qc.qc_summary(df, preds),
        "markers": schema.metadata(raw.sparkSession), "normalized": normalized, "scaled": scaled, "binary": binary,
        "raw_matrix": tables.prefixed_matrix(df, RAW_PREFIX), "background_matrix": tables.prefixed_matrix(df, BG_PREFIX),
        "thresholds": thresholds, "reference_enrichment": cooccur.reference_enrichment(binary, valid, ref),
        "pca": coords, "pca_variance": variance, "clusters": labels,
        "cluster_by_sample": profile.crosstab(labels, "cluster", "sample"),
        "sample_summary": compared["summary"], "sample_overall": compared["overall"], "sample_pairwise": compared["pairwise"],
        "avg_by_sample": profile.means(normalized, ["sample"], list(source)),
        "avg_by_position": profile.means(normalized, ["position"], list(source)),
        "summary": export.summary_document(df, valid, thresholds),
    }
    if len(valid) >= 2:
        out["combinations"] = cooccur.combination_statistics(binary, valid, draws)
    out.update({f"position_{k}": v for k, v in profile.position_qc(df, valid).items()})
    return out


def colocalization(dets: DataFrame, reference: str, channels: list[str], keys: list[str] = ["sample", "position"], *,
                   mode: str = "nearest_centroid", limit: float = 10.0, labels: DataFrame | None = None,
                   background: DataFrame | None = None, marker_names: dict[str, str] | None = None,
                   only_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reference table and its three summaries for every (sample, position) at once.

    ``mode``: nearest_centroid, or overlap by label masks (keys, channel, y, x, label) or boxes.
    """
    dets = saved(dets.where(F.col("channel").isin(reference, *channels)))
    refs = qc.restrict_to(dets.where(F.col("channel") == reference), only_ids, [*keys, "id"])
    marks = dets.where(F.col("channel").isin(channels))
    if mode == "nearest_centroid":
        matches = coloc.nearest_by_channel(refs, marks, keys, limit)
    else:
        # the marker channel is one more key: each channel meets the reference on its own
        by = [*keys, "channel"]
        each = refs.drop("channel").withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
        ref_px = mark_px = None
        if labels is not None:
            own = labels.where(F.col("channel") == reference).drop("channel")
            own = own.join(refs.select(*keys, F.col("id").alias("label")), [*keys, "label"], "left_semi")
            ref_px = own.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
            mark_px = labels.where(F.col("channel").isin(channels))
        matches = spatial.overlap_matches(each, marks, by, ref_px, mark_px)
    matches = saved(matches)
    hits = coloc.channel_hits(matches, keys, marks if "mean_intensity" in dets.columns else None)
    long = saved(coloc.reference_long(refs, hits, channels, keys, background))
    status = coloc.reference_status(long, keys)
    return {
        "matches": matches, "reference_long": long,
        "reference_table": coloc.reference_wide(refs, long, channels, keys, coloc.matched_ids(matches, keys), marker_names),
        "summary": coloc.overall_summary(status), "combination_summary": coloc.combination_summary(status),
        "channel_summary": coloc.channel_summary(long, marks, refs.count(), marker_names=marker_names),
    }
