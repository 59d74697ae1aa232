"""Tail functions and tests against known values and brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from motes.functions import tails
from motes.operators import compare, cooccur, matrix


def test_fisher_known_values():
    # counts and p-values of a published-size run: 164 reference positives, 164 target positives of 3264
    for a, p in ((75, 8.914107769913057e-60), (71, 4.3681041843627243e-54), (59, 1.6759648908974607e-38)):
        assert tails.fisher_p(a, 164 - a, 164 - a, 3264 - 328 + a) == pytest.approx(p, rel=1e-9)


def test_fisher_small_tables_by_enumeration():
    for a, b, c, d in itertools.product(range(5), repeat=4):
        if a + b + c + d == 0:
            continue
        n, g, k = a + b + c + d, a + b, a + c
        w = {x: math.comb(g, x) * math.comb(n - g, k - x) for x in range(max(0, k - n + g), min(g, k) + 1)}
        want = sum(v for v in w.values() if v <= w[a] * (1 + 1e-7)) / sum(w.values())
        assert tails.fisher_p(a, b, c, d) == pytest.approx(want, rel=1e-9)


def test_fisher_huge_counts_stay_cheap_and_sane():
    n = 10 ** 12
    assert tails.fisher_p(n // 4, n // 4, n // 4, n // 4) == pytest.approx(1.0, abs=1e-5)
    shift = int(1e6)
    p = tails.fisher_p(n // 4 + shift, n // 4 - shift, n // 4 - shift, n // 4 + shift)
    assert p == pytest.approx(math.erfc(4 * shift / math.sqrt(n) / math.sqrt(2)), rel=1e-2)


def test_mann_whitney_known_values():
    assert tails.mwu_p(645180.0, 1336, 957, 0) == pytest.approx(0.705719818753068, rel=1e-9)
    assert tails.mwu_p(613715.0, 1336, 971, 0) == pytest.approx(0.027088019164961508, rel=1e-9)
    assert 2 * 645180.0 / (1336 * 957) - 1 == pytest.approx(0.009235447600097535)
    assert tails.mwu_p(9, 3, 3, 0) == pytest.approx(0.1)
    assert tails.mwu_p(8, 2, 4, 0) == pytest.approx(2 / 15)


def test_chi2_tail():
    for x, df, p in ((3.841458820694124, 1, .05), (5.991464547107979, 2, .05), (7.814727903251179, 3, .05),
                     (11.070497693516351, 5, .05), (18.307038053275146, 10, .05)):
        assert tails.chi2_tail(x, df) == pytest.approx(p, rel=1e-9)


def test_overlap_draws_have_the_shuffle_mean():
    n, c = 500, [200, 150, 100]
    h = tails.overlap_draws(n, c, 4000, 1)
    assert h.mean() == pytest.approx(200 * 150 / n * 100 / n, rel=.05)
    r = np.random.default_rng(2)
    cols = [np.arange(n) < k for k in c]
    real = [np.all([r.permutation(x) for x in cols], axis=0).sum() for _ in range(2000)]
    assert h.std() == pytest.approx(np.std(real), rel=.1)
    assert tails.overlap_draws(10 ** 11, [10 ** 10, 10 ** 10], 500, 3).mean() == pytest.approx(1e9, rel=1e-3)


def test_empirical_p_lies_near_the_exact_one(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"object_id": range(400), "a": r.random(400) < .3, "b": r.random(400) < .4, "c": r.random(400) < .5})
    pdf["b"] |= pdf.a & (r.random(400) < .25)
    df = spark.createDataFrame(pdf.astype(int))
    got = cooccur.exact_p(cooccur.empirical_p(cooccur.combinations(df, ["a", "b", "c"]), 2000)).collect()
    assert len(got) == 4
    for g in got:
        members = [["a", "b", "c"][i] for i in g.members]
        assert g.observed_count == int(pdf[members].all(axis=1).sum())
        assert g.empirical_pvalue == pytest.approx(g.exact_pvalue, abs=.03)
    again = {tuple(x.members): x.empirical_pvalue for x in
             cooccur.empirical_p(cooccur.combinations(df.repartition(5), ["a", "b", "c"]), 2000).collect()}
    assert again == {tuple(g.members): g.empirical_pvalue for g in got}


def test_combination_degree_limit(spark):
    r = np.random.default_rng(5)
    m = [f"m{i}" for i in range(6)]
    pdf = pd.DataFrame(r.integers(0, 2, (300, 6)), columns=m)
    got = {g.combination: g.observed_count for g in cooccur.combinations(spark.createDataFrame(pdf), m, 2, 3).collect()}
    want = {"+".join(c): int(pdf[list(c)].all(axis=1).sum()) for d in (2, 3) for c in itertools.combinations(m, d)}
    assert got == want


def test_no_reference_positives_give_an_empty_table(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "a int, b int")
    e = cooccur.reference_enrichment(df, ["a", "b"], "a")
    assert e.count() == 0 and "fdr_pvalue" in e.columns


def test_kruskal_with_three_small_groups(spark):
    # hand-ranked: values 1..9 in three groups, H = 7.2
    df = spark.createDataFrame([("m", "abc"[i // 3], float(i)) for i in range(9)], "marker string, sample string, value double")
    k = compare.kruskal(df).first()
    assert k.h_statistic == pytest.approx(7.2) and k.pvalue == pytest.approx(math.exp(-3.6))


def test_pairs_are_adjusted_within_their_marker(spark):
    r = np.random.default_rng(6)
    rows = [(m, s, float(v)) for m in ("p", "q") for s, off in (("a", 0), ("b", .3), ("c", .9)) for v in r.normal(off, 1, 40)]
    pair = compare.compare_samples(spark.createDataFrame(rows, "marker string, sample string, value double"))["pairwise"].toPandas()
    for _, g in pair.groupby("marker"):
        p = np.sort(g.pvalue)
        want = np.minimum.accumulate((p * 3 / [1, 2, 3])[::-1])[::-1]
        assert np.sort(g.adj_pvalue) == pytest.approx(want)
    mat = compare.symmetric_pairs(compare.compare_samples(
        spark.createDataFrame(rows, "marker string, sample string, value double"))["pairwise"])
    assert mat.count() == 18


def test_scaling_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, None), (3, None, 3.0)], "object_id int, a double, b double")
    got = {r.object_id: (r.a, r.b) for r in matrix.scale(df, ["a", "b"], "zscore").collect()}
    assert got == {1: (0.0, -1.0), 2: (0.0, None), 3: (0.0, 1.0)}


def test_otsu_splits_two_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 100, 101, 101, 102]] , "a double")
    t = matrix.thresholds_otsu(df.withColumn("b", matrix.F.lit(5.0)), ["a", "b"]).collect()
    t = {r.marker: r.threshold for r in t}
    assert 2 < t["a"] < 100 and t["b"] == 5.0


def test_otsu_does_not_depend_on_the_scale(spark):
    from motes.operators import matrix
    base = [0.1, 0.11, 0.12, 0.1, 0.9, 0.91, 0.92, 0.9]
    rows = [(scale, v * scale) for scale in (1.0, 1e-5, 1e-12, 1e9) for v in base]
    df = spark.createDataFrame(rows, "g double, v double")
    got = {r.g: r.threshold / r.g for r in matrix.otsu(matrix.histogram(df, ["g"], "v", 256), ["g"]).collect()}
    assert all(0.12 < t < 0.9 and abs(t - got[1.0]) < 1e-6 for t in got.values())


def test_mann_whitney_is_exact_at_any_size():
    import itertools
    from motes.functions import tails
    for n1, n2 in ((1, 4), (3, 4), (5, 3), (4, 4)):
        us = [sum(r - i for i, r in enumerate(s)) for s in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert abs(tails._mwu_exact(u, n1, n2) - sum(x >= u for x in us) / len(us)) < 1e-12
    big = tails.mwu_p(8 * 10**9 * 0.7, 8, 10**9, 0)
    assert abs(big - 2 * tails._mwu_exact(8 * 10**9 * 0.7, 8, 10**9)) < 1e-15 and 0.01 < big < 0.1


def test_large_hypergeometric_draws_keep_the_law():
    import numpy as np
    from motes.functions import tails
    rng = np.random.default_rng(0)
    for total, good, drawn in ((4 * 10**9, 2 * 10**9, 1000), (2 * 10**9, 5, 10**9), (2 * 10**9, 2 * 10**9 - 3, 10**9), (3 * 10**9, 10**9, 10**9)):
        x = np.array([tails._draw_large(rng, total, good, drawn) for _ in range(1500)], float)
        mean = drawn * good / total
        sd = (mean * (1 - good / total) * (total - drawn) / (total - 1)) ** 0.5
        assert abs(x.mean() - mean) < 5 * sd / 1500**0.5 and abs(x.std() / sd - 1) < 0.1


def test_regions_of_one_line_and_one_pixel(spark):
    from motes.operators import pixels, qc
    rows = [(1, 5, x, 1) for x in range(12)] + [(1, 9, 9, 2)]
    p = pixels.region_properties(spark.createDataFrame(rows, "image int, y int, x int, label int"), ["image"])
    got = {r.label: r.elongation for r in p.collect()}
    assert abs(got[1] - 12.0) < 1e-9 and got[2] == 1.0
    assert [r.label for r in qc.blob_filter(p, area=(1, 50), circularity=(0, 2), min_inertia=0).collect()] == [1]


def test_pairwise_ranks_of_many_samples_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(m, f"s{s}", float(v)) for m in ("a", "b") for s in range(12)
            for v in (rng.integers(0, 40, 30) if s % 3 else rng.normal(20, 9, 25))]
    rows += [("a", "hot", 7.0)] * 500 + [("a", "low", -100.0), ("a", "high", 1e9), ("a", "none", None), ("b", "nan", float("nan")), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "marker string, sample string, value double")
    got = {(r.marker, r.sample_1, r.sample_2): r for r in compare.mann_whitney(df).collect()}
    values = {}
    for m, s, v in rows:
        if v is not None and s is not None:
            values.setdefault((m, s), []).append(float("inf") if v != v else v)
    keys = {(m, s, t) for m, s in values for n, t in values if m == n and s < t}
    assert set(got) == keys
    for m, s, t in keys:
        a, b = np.array(values[m, s]), np.array(values[m, t])
        u = (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
        r = got[m, s, t]
        assert (r.n_1, r.n_2, r.u_statistic) == (len(a), len(b), u)
        c = np.unique(np.concatenate([a, b]), return_counts=True)[1].astype(float)
        assert r.pvalue == pytest.approx(tails.mwu_p(float(u), len(a), len(b), float((c ** 3 - c).sum())), rel=1e-9, nan_ok=True)


def test_pairwise_ranks_shuffle_values_once(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK_CELLS", 50)
    rows = [("a", f"s{s}", float((v * 7 + s) % 31)) for s in range(9) for v in range(60)]
    df = spark.createDataFrame(rows, "marker string, sample string, value double")
    got = {(r.sample_1, r.sample_2): r.u_statistic for r in compare.mann_whitney(df).collect()}
    for (s, t), u in got.items():
        a, b = (np.array([v for _, k, v in rows if k == x]) for x in (s, t))
        assert u == (a[:, None] > b).sum() + (a[:, None] == b).sum() / 2
    assert len(got) == 36


def test_bh_query_sums_p_in_any_order(spark, tmp_path):
    """Groups of 32 rows whose p ends on a half: the exact half goes up, whatever the order of the rows."""
    from decimal import ROUND_HALF_UP, Decimal

    from motes.plans import objects
    rng = np.random.default_rng(3)
    tax, discount = rng.integers(0, 9, (300, 32)), rng.integers(0, 11, (300, 32))
    rows = [(s, "A", int(t) / 100, int(d) / 100) for s in range(300) for t, d in zip(tax[s], discount[s])]
    rows = [(k, *r) for k, r in enumerate(rows)]
    want = {s: float((Decimal(int((tax[s] * discount[s]).sum())) / 3200).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for s in range(300)}
    for name, order in (("up", rows), ("down", rows[::-1])):
        spark.createDataFrame(order, "l_orderkey long, l_suppkey long, l_returnflag string, l_tax double, l_discount double") \
            .coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got = {r.test: r.p for r in objects.bh_adjust(spark, str(tmp_path / name)).collect()}
        assert got == want


def test_restarts_read_each_different_point_once(spark, monkeypatch):
    from motes.operators import learn
    seen, kmeans = [], learn.KMeans

    class Watched:
        def __init__(self, **kw):
            self.kw = kw

        def fit(self, df):
            seen.append((df.count(), df.agg({self.kw["weightCol"]: "sum"}).first()[0]))
            return kmeans(**self.kw).fit(df)
    monkeypatch.setattr(learn, "KMeans", Watched)
    df = spark.createDataFrame([(i, float(i % 4 * 10), float(i % 2)) for i in range(80)], "object_id long, x double, y double")
    labels, cost = learn.kmeans(df, ["x", "y"], k=4, restarts=2, keep=["object_id", "x"])
    assert seen == [(4, 80.0)] * 2 and cost == pytest.approx(0.0)
    rows = labels.collect()
    assert labels.columns == ["object_id", "x", "cluster"] and len(rows) == 80
    assert len({(r.x, r.cluster) for r in rows}) == 4
