"""Descriptions and rank tests of markers across samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.functions.scalars import neg_log10, significance_label
from motes.functions.tails import chi2_sf, mann_whitney_p
from motes.operators.ordering import average_ranks, exact_quantiles, value_counts, with_pieces
from motes.session import saved, small_side


def describe(long: DataFrame, keys: list[str] = ["marker", "sample"]) -> DataFrame:
    """count, mean, median, std (sample), min, q25, q75, max of the present values per group."""
    basic = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, keys, "value", {"q25": .25, "median": .5, "q75": .75})
    return basic.where(F.col("count") > 0).join(small_side(qs), keys).select(
        *keys, "count", "mean", "median", "std", "min", "q25", "q75", "max")


# -- adjustment --------------------------------------------------------------

def bonferroni(df: DataFrame, p: str, out: str, by: list[str] = []) -> DataFrame:
    """min(p * n, 1) over the tests of each ``by`` group; a missing p stays missing."""
    if by:
        n = df.groupBy(*by).agg(F.count(p).alias("_n"))
        found = df.join(n, by).withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("_n")))
    else:
        found = df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.lit(df.agg(F.count(p)).first()[0])))
    return found.select(*[c for c in df.columns if c != out], F.when(F.col(p).isNotNull(), F.col(out)).alias(out))


def bh_adjust(df: DataFrame, p: str, out: str, by: list[str] = [], tie: list[str] = []) -> DataFrame:
    """Benjamini-Hochberg step-up p over the tests of each ``by`` group.

    Tests of one p share their result, that of the last of them, so the order is taken over
    distinct p, counted before anything is sorted.  ``tie`` no longer matters.
    """
    own = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    up = group.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = group.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = own.withColumn("_raw", F.col(p) * F.sum("_n").over(group) / F.sum("_n").over(up))
    table = raw.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_n", "_raw")
    return df.drop(out).join(table, [*by, p], "left").select(*[c for c in df.columns if c != out], out)


def adjusted(df: DataFrame, p: str, out: str, method: str, by: list[str] = [], tie: list[str] = []) -> DataFrame:
    if method == "bonferroni":
        return bonferroni(df, p, out, by)
    if method == "fdr_bh":
        return bh_adjust(df, p, out, by, tie)
    raise ValueError("correction must be fdr_bh or bonferroni")


# -- rank tests --------------------------------------------------------------

def rank_sums(long: DataFrame, group: str = "sample") -> DataFrame:
    """Per (marker, sample): count and sum of tie-shared ranks over all samples of the marker."""
    r = average_ranks(long, ["marker"], "value", [group])
    return r.groupBy("marker", group).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("rank_sum"))


def kruskal(long: DataFrame, group: str = "sample") -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) and p per marker with at least two non-empty samples."""
    r = average_ranks(long, ["marker"], "value", [group])
    t, n = F.col("ties").cast("double"), F.col("n")
    # each of a value's rows carries its share of the tie term
    sums = r.groupBy("marker", group).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * n).alias("rs"), F.sum(n * (t * t - 1)).alias("tie"))
    total = F.sum("n").cast("double")
    g = sums.groupBy("marker").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("_q"),
        F.sum("tie").alias("_tie"), total.alias("_t"))
    h = 12 / (F.col("_t") * (F.col("_t") + 1)) * F.col("_q") - 3 * (F.col("_t") + 1)
    factor = 1 - F.col("_tie") / (F.pow("_t", 3) - F.col("_t"))
    g = g.where(F.col("groups") >= 2).withColumn("h_statistic", F.when(factor > 0, h / factor))
    return g.withColumn("pvalue", chi2_sf(F.col("h_statistic"), F.col("groups") - 1)).select(
        "marker", "groups", "n", "h_statistic", "pvalue")


#: Cells (values x samples) of one dense block of counts in a piece.
BLOCK_CELLS = 2_000_000


def _piece_sums(group: str):
    """Per piece of values: what it adds to U and to the tie term of every sample pair.

    Samples that meet a value here are the columns of a count matrix with a row per value; the weight of a
    partner's smaller values starts from its running total before the piece.
    """
    def add(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(before[group].to_numpy(dtype=object).astype(str))
        col = np.searchsorted(names, rows[group].to_numpy(dtype=object).astype(str))
        here = np.unique(col)  # samples with rows in this piece; all others add no U of their own
        upto = np.zeros(len(names))
        upto[np.searchsorted(names, before[group].to_numpy(dtype=object).astype(str))] = before["_before"].to_numpy(float)
        level, value = np.unique(rows["value"].to_numpy(), return_inverse=True)
        order = np.argsort(value, kind="stable")
        value, slot, n = value[order], np.searchsorted(here, col[order]), rows["n"].to_numpy(float)[order]
        u = np.zeros((len(here), len(names)))
        ties = np.zeros((len(here), len(here)))
        step = max(1, BLOCK_CELLS // max(1, len(here)))
        for lo in range(0, len(level), step):
            i, j = np.searchsorted(value, [lo, lo + step])
            x = np.zeros((min(step, len(level) - lo), len(here)))
            np.add.at(x, (value[i:j] - lo, slot[i:j]), n[i:j])
            total = x.sum(0)
            u += np.outer(total, upto)
            u[:, here] += x.T @ (np.cumsum(x, 0) - x / 2)
            upto[here] += total
            cross = (x * x).T @ x
            ties += 3 * (cross + cross.T)
        one, two = np.nonzero((here[:, None] < np.arange(len(names))[None, :]) & (u != 0))
        t = np.zeros(len(one))
        both = np.isin(names[two], names[here])
        t[both] = ties[one[both], np.searchsorted(here, two[both])]
        return pd.DataFrame({"marker": rows["marker"].iloc[0] if len(rows) else None, "sample_1": names[here[one]], "sample_2": names[two],
                             "_u": u[one, two], "_t": t})
    return add


def mann_whitney(long: DataFrame, group: str = "sample") -> DataFrame:
    """Mann-Whitney U of every unordered sample pair per marker, with p and rank-biserial effect.

    Equal values are collapsed first and shuffled once, whatever the number of samples: values are opened
    piece by piece, and a piece knows the running totals of all samples before it, so it adds to all pairs at once.
    """
    counts = value_counts(long, ["marker", group], "value").where(F.col("marker").isNotNull() & F.col(group).isNotNull())
    counts = saved(counts.withColumn(group, F.col(group).cast("string")))
    cut = with_pieces(counts, ["marker"], "value")
    totals = saved(cut.groupBy("marker", "_piece", group).agg(F.sum("n").alias("_in"), F.sum(F.pow("n", F.lit(3))).alias("_cube")))
    sizes = totals.groupBy("marker", group).agg(F.sum("_in").alias("_n"), F.sum("_cube").alias("_cube"))
    grid = totals.select("marker", "_piece").distinct().join(sizes.select("marker", group), "marker")
    earlier = Window.partitionBy("marker", group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (grid.join(totals, ["marker", "_piece", group], "left")
              .select("marker", "_piece", group, F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before")))
    kind = long.schema["marker"].dataType.simpleString()
    added = cut.select("marker", "_piece", group, "value", "n").groupBy("marker", "_piece").cogroup(before.groupBy("marker", "_piece")).applyInPandas(
        _piece_sums(group), f"marker {kind}, sample_1 string, sample_2 string, _u double, _t double")
    sums = added.groupBy("marker", "sample_1", "sample_2").agg(F.sum("_u").alias("_u"), F.sum("_t").alias("_t"))
    one = sizes.select("marker", F.col(group).alias("sample_1"), F.col("_n").alias("n_1"), F.col("_cube").alias("_c1"))
    two = sizes.select("marker", F.col(group).alias("sample_2"), F.col("_n").alias("n_2"), F.col("_cube").alias("_c2"))
    u = one.join(two, "marker").where(F.col("sample_1") < F.col("sample_2")).join(sums, ["marker", "sample_1", "sample_2"], "left")
    u = u.select("marker", "sample_1", "sample_2", "n_1", "n_2", F.coalesce("_u", F.lit(0.0)).alias("u_statistic"),
                 (F.coalesce("_t", F.lit(0.0)) + F.col("_c1") + F.col("_c2") - F.col("n_1") - F.col("n_2")).alias("_ties"))
    effect = 2 * F.col("u_statistic") / (F.col("n_1").cast("double") * F.col("n_2")) - 1
    return (u.withColumn("pvalue", mann_whitney_p("u_statistic", "n_1", "n_2", "_ties"))
            .withColumn("effect_size_rbc", effect).drop("_ties"))


def pairwise_tests(long: DataFrame, correction: str = "fdr_bh") -> DataFrame:
    """Mann-Whitney tests of all sample pairs, adjusted within their marker, with labels."""
    pair = adjusted(mann_whitney(long).na.fill(1.0, ["pvalue"]), "pvalue", "adj_pvalue", correction, ["marker"],
                    ["sample_1", "sample_2"])
    return pair.withColumn("significance", significance_label(F.col("adj_pvalue"))).withColumn(
        "sample_pair", F.concat_ws(" vs ", "sample_1", "sample_2"))


def compare_samples(long: DataFrame, correction: str = "fdr_bh") -> dict[str, DataFrame]:
    """Summary, overall tests and pairwise tests."""
    return {"summary": describe(long), "overall": kruskal(long), "pairwise": pairwise_tests(long, correction)}


def pairwise_matrix(pairwise: DataFrame, pairs: list[str] | None = None) -> DataFrame:
    """Marker x sample pair table of -log10(adjusted p)."""
    g = pairwise.withColumn("_v", neg_log10(F.col("adj_pvalue"))).groupBy("marker")
    return (g.pivot("sample_pair", pairs) if pairs else g.pivot("sample_pair")).agg(F.first("_v"))


def symmetric_pairs(pairwise: DataFrame) -> DataFrame:
    """Long symmetric form with a zero diagonal: marker, row, col, value."""
    v: Column = neg_log10(F.col("adj_pvalue")).alias("value")
    up = pairwise.select("marker", F.col("sample_1").alias("row"), F.col("sample_2").alias("col"), v)
    down = pairwise.select("marker", F.col("sample_2").alias("row"), F.col("sample_1").alias("col"), v)
    both = up.union(down)
    diagonal = both.select("marker", "row", F.col("row").alias("col"), F.lit(0.0).alias("value")).distinct()
    return both.union(diagonal)
