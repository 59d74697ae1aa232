"""Marker combinations: observed and expected counts, null model, reference enrichment.

The object table is reduced once to at most 2^k positive patterns with counts
(map-side); everything after works on patterns, combinations or markers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from motes.functions.scalars import neg_log10, q, significance_label
from motes.functions.tails import exact_overlap_p, fisher_exact, overlap_draws
from motes.operators.compare import bh_adjust, bonferroni
from motes.session import checkpoint

#: Markers whose subsets are summed in one step.
BLOCK = 6


def patterns(binary: DataFrame, markers: list[str], by: list[str] = []) -> DataFrame:
    """One row per set of positive markers (indexes in marker order) with its count."""
    if len(markers) > 62:
        raise ValueError("at most 62 markers")
    bits = sum((F.when(q(m) > 0, F.lit(1 << i)).otherwise(0).cast("long") for i, m in enumerate(markers)),
               F.lit(0).cast("long"))
    n = binary.select(*by, bits.alias("mask")).groupBy(*by, "mask").agg(F.count("*").alias("n"))
    index = F.array(*[F.lit(i) for i in range(len(markers))])
    return n.withColumn("positive", F.filter(index, lambda i: F.getbit("mask", i) == 1))


def combinations(binary: DataFrame, markers: list[str], min_degree: int = 2,
                 max_degree: int | None = None) -> DataFrame:
    """Every marker combination of the wanted degrees with observed and expected counts.

    A pattern counts for each of its subsets.  Sums over supersets go block by block of
    markers: each step adds a mask to the masks without some of the block's bits, so no
    step holds more rows than there are combinations of the markers done so far.
    """
    k = len(markers)
    top = min(max_degree or k, k)
    pat = patterns(binary, markers)
    stats = pat.agg(F.sum("n").alias("n"), *[
        F.sum(F.when(F.array_contains("positive", i), F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)]).first()
    total = stats["n"] or 0
    if total == 0:
        raise ValueError("no objects")
    ones = [int(stats[f"c{i}"]) for i in range(k)]
    # a pattern of all markers with no objects brings in combinations never seen
    full = binary.sparkSession.createDataFrame([(0, (1 << k) - 1)], "n long, mask long")
    sums = pat.select("n", "mask").union(full)
    for first in range(0, k, BLOCK):
        block = ((1 << min(BLOCK, k - first)) - 1) << first
        done = (1 << min(first + BLOCK, k)) - 1
        own = F.col("mask").bitwiseAND(F.lit(block))
        subs = F.transform(F.sequence(F.lit(0), F.lit(block >> first)), lambda j: F.shiftleft(j.cast("long"), first))
        kept = F.filter(subs, lambda j: j.bitwiseAND(own) == j)
        sums = sums.withColumn("_s", F.explode(kept)).select(
            "n", F.col("mask").bitwiseAND(F.lit(~block)).bitwiseOR(F.col("_s")).alias("mask")).where(
            F.bit_count(F.col("mask").bitwiseAND(F.lit(done))) <= top).groupBy("mask").agg(F.sum("n").alias("n"))
    index = F.array(*[F.lit(i) for i in range(k)])
    out = sums.where(F.bit_count("mask").between(min_degree, top)).select(
        F.filter(index, lambda i: F.getbit("mask", i) == 1).alias("members"), F.col("n").alias("observed_count"))
    names = F.array(*[F.lit(m) for m in markers])
    freq = F.array(*[F.lit(c / total) for c in ones])
    count = F.array(*[F.lit(c) for c in ones])
    expected = F.aggregate("members", F.lit(float(total)), lambda a, i: a * F.get(freq, i))
    return (out.withColumn("markers", F.transform("members", lambda i: F.get(names, i)))
            .withColumn("combination", F.array_join("markers", "+"))
            .withColumn("degree", F.size("members"))
            .withColumn("observed_frequency", F.col("observed_count") / total)
            .withColumn("expected_count", expected)
            .withColumn("deviation", F.col("observed_count") - F.col("expected_count"))
            .withColumn("member_counts", F.transform("members", lambda i: F.get(count, i).cast("long")))
            .withColumn("total", F.lit(total).cast("long")))


def empirical_p(combos: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(1 + draws at or above the observed overlap) / (draws + 1).

    Shuffling each marker column and counting the overlap is a chain of
    hypergeometric draws, so no object row is touched again.  The seed of a
    combination depends on its members, not on its place in the cluster.
    """
    @pandas_udf("double")
    def p(total: pd.Series, counts: pd.Series, members: pd.Series, observed: pd.Series) -> pd.Series:
        out = []
        for n, c, m, o in zip(total, counts, members, observed):
            own = sum(1 << int(i) for i in m)
            hits = int((overlap_draws(int(n), [int(x) for x in c], draws, [seed, own]) >= int(o)).sum())
            out.append((1 + hits) / (draws + 1))
        return pd.Series(out, dtype=float)
    # Combinations are few rows in few partitions; the draws are the work.
    spread = combos.repartition(combos.sparkSession.sparkContext.defaultParallelism, "members")
    return spread.withColumn("empirical_pvalue", p("total", "member_counts", "members", "observed_count"))


def exact_p(combos: DataFrame) -> DataFrame:
    """The null probability itself, for tables of moderate size."""
    @pandas_udf("double")
    def p(total: pd.Series, counts: pd.Series, observed: pd.Series) -> pd.Series:
        return pd.Series([exact_overlap_p(int(n), [int(x) for x in c], int(o))
                          for n, c, o in zip(total, counts, observed)], dtype=float)
    return combos.withColumn("exact_pvalue", p("total", "member_counts", "observed_count"))


def combination_statistics(binary: DataFrame, markers: list[str], draws: int = 1000, min_degree: int = 2,
                           max_degree: int | None = None, seed: int = 42) -> DataFrame:
    """Combinations with empirical, Bonferroni and BH p, label; ordered by BH p, then count."""
    # the draws are the work, and three tables below use them
    c = checkpoint(empirical_p(combinations(binary, markers, min_degree, max_degree), draws, seed))
    c = bonferroni(c, "empirical_pvalue", "bonferroni_pvalue")
    c = bh_adjust(c, "empirical_pvalue", "fdr_pvalue", tie=["combination"])
    c = c.withColumn("significance", significance_label(F.col("fdr_pvalue")))
    return c.select("combination", "markers", "degree", "observed_count", "observed_frequency", "expected_count",
                    "deviation", "empirical_pvalue", "bonferroni_pvalue", "fdr_pvalue", "significance"
                    ).orderBy("fdr_pvalue", F.desc("observed_count"), "combination")


def reference_counts(binary: DataFrame, markers: list[str], reference: str) -> DataFrame:
    """Per target marker: reference positives, double positives and the 2x2 table's cells."""
    ref = q(reference) > 0
    cells = [F.struct(F.lit(m).alias("target_marker"), F.count_if(q(m) > 0).alias("target_positive_count"),
                      F.count_if(ref & (q(m) > 0)).alias("double_positive_count")) for m in markers if m != reference]
    row = binary.agg(F.count("*").alias("total"), F.count_if(ref).alias("reference_positive_count"),
                     F.array(*cells).alias("_t"))
    return row.select(F.lit(reference).alias("reference_marker"), "total", "reference_positive_count",
                      F.inline("_t"))


def reference_enrichment(binary: DataFrame, markers: list[str], reference: str) -> DataFrame:
    """Fraction among the reference, background rate, enrichment, Fisher p, BH p and label per target.

    No reference positives give an empty table.
    """
    t = reference_counts(binary, markers, reference).where(F.col("reference_positive_count") > 0)
    a, r = F.col("double_positive_count"), F.col("reference_positive_count")
    c = F.col("target_positive_count") - a
    rate = F.col("target_positive_count") / F.col("total")
    t = t.withColumns({
        "fraction_among_reference": a / r, "background_rate": rate,
        "enrichment_vs_all": F.when(rate > 0, a / r / rate),
        "pvalue": fisher_exact(a, r - a, c, F.col("total") - r - c)})
    t = bh_adjust(t, "pvalue", "fdr_pvalue", tie=["target_marker"])
    return (t.withColumn("significance", significance_label(F.col("fdr_pvalue")))
            .drop("total", "target_positive_count")
            .orderBy("fdr_pvalue", F.desc("double_positive_count"), "target_marker"))


def enrichment_axes(combos: DataFrame, x: str = "deviation", p: str = "fdr_pvalue", min_count: int = 0) -> DataFrame:
    """x: observed - expected or log2 of their ratio; y: -log10 p."""
    o, e = F.col("observed_count"), F.col("expected_count")
    axis = o - e if x == "deviation" else F.log2((o + 1e-9) / (e + 1e-9))
    return combos.where(o >= min_count).withColumns({"x": axis, "y": neg_log10(F.col(p))})


def combination_filter(combos: DataFrame, min_count: int = 1, min_degree: int = 1,
                       without: str | None = None) -> DataFrame:
    out = combos.where((F.col("observed_count") >= min_count) & (F.col("degree") >= min_degree))
    return out if without is None else out.where(~F.array_contains("markers", without))


def top_combinations(combos: DataFrame, n: int = 20) -> DataFrame:
    return combos.orderBy("fdr_pvalue", F.desc("observed_count"), "combination").limit(n)
