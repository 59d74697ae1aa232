import numpy as np
import pandas as pd
import pytest

from motes.operators import compare, geometry, ordering
from tests.test_spatial import rows


@pytest.fixture
def table(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(np.arange(4000) < 1400, "hot", r.choice(["a", "b", "c"], 4000)),
                        "s": r.choice(["x", "y", "z"], 4000), "v": r.integers(0, 300, 4000) / 4.0})
    pdf.loc[:300, "v"] = 7.25
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(params=[4_000_000, 2])
def piece_rows(request, monkeypatch):
    monkeypatch.setattr(ordering, "PIECE_ROWS", request.param)


def test_average_ranks(table, piece_rows):
    pdf, df = table
    got = {(r.g, r.v): r["rank"] for r in ordering.average_ranks(df, ["g"], "v", ["s"]).collect()}
    pdf["rank"] = pdf.groupby("g").v.rank()
    assert got == {(g, v): k for g, v, k in zip(pdf.g, pdf.v, pdf["rank"])}


@pytest.mark.parametrize("margin", [ordering.MARGIN, 0.0])
def test_exact_quantiles(table, piece_rows, monkeypatch, margin):
    pdf, df = table
    monkeypatch.setattr(ordering, "MARGIN", margin)
    ps = {"lo": 0.0, "a": .005, "m": .5, "q": .9, "hi": 1.0}
    got = {r.g: r for r in ordering.exact_quantiles(df, ["g"], "v", ps).collect()}
    for g, sub in pdf.groupby("g"):
        for n, p in ps.items():
            assert got[g][n] == pytest.approx(np.percentile(sub.v, p * 100))


def test_discrete_quantile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    r = ordering.exact_quantiles(df, [], "v", {"m": .5, "p99": .99}, discrete=True).first()
    assert (r["m"], r["p99"]) == (6.0, 10.0)


def test_row_numbers_of_a_hot_group(table, spark):
    pdf, _ = table
    pdf = pdf.assign(i=np.arange(len(pdf)) * 3)
    got = ordering.row_numbers(spark.createDataFrame(pdf), ["g"], "i", "n", hot=1000)
    pdf["n"] = pdf.groupby("g").i.rank().astype(int)
    assert rows(got, "g", "i", "n") == sorted(zip(pdf.g, pdf.i, pdf.n))


@pytest.mark.parametrize("own", [True, False])
def test_carried(spark, piece_rows, own):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": r.integers(0, 3, 500), "t": np.arange(500), "v": r.integers(0, 9, 500)})
    pdf["v"] = pdf.v.where(r.random(500) < .3).astype("Int64")
    spark_df = spark.createDataFrame([(int(a), int(b), None if pd.isna(c) else int(c)) for a, b, c in
                                      zip(pdf.g, pdf.t, pdf.v)], "g int, t long, v int")
    want = pdf.groupby("g").v.ffill()
    if not own:
        want = want.groupby(pdf.g).shift()
    got = {x.t: x.p for x in ordering.carried(spark_df, ["g"], "t", "v", "p", own).collect()}
    assert got == {t: None if pd.isna(w) else int(w) for t, w in zip(pdf.t, want)}


def test_gap_groups(spark, piece_rows):
    v = np.random.default_rng(2).integers(0, 2000, 300)
    s = np.sort(v)
    want = np.split(s, np.where(np.diff(s) > 5)[0] + 1)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    got = geometry.gap_groups(df, ["k"], "v", 5.0).orderBy("island").collect()
    assert [(g.n, g.low, g.high) for g in got] == [(len(w), w[0], w[-1]) for w in want]


def test_bh_is_monotone_and_bounded(spark):
    p = np.random.default_rng(3).random(60) ** 2
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double")
    got = [r.q for r in compare.bh_adjust(df, "p", "q", tie=["i"]).orderBy("p").collect()]
    s = np.sort(p)
    want = np.minimum.accumulate((s * 60 / np.arange(1, 61))[::-1])[::-1].clip(max=1)
    assert got == pytest.approx(want)


def test_row_numbers_of_repeated_values_are_unique_in_hot_groups(spark):
    df = spark.createDataFrame([("a", v) for v in (0, 0, 0, 7, 7, 9)] + [("b", 1)], "g string, v int")
    for hot in (2, 1000):
        got = sorted((r.g, r.row_number, r.v) for r in ordering.row_numbers(df, ["g"], "v", hot=hot).collect())
        assert got == [("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 4, 7), ("a", 5, 7), ("a", 6, 9), ("b", 1, 1)]


def test_images_are_dealt_by_their_number(spark, sf, monkeypatch):
    """A partition holds no more images of a larger table; before, there were as many partitions as cores."""
    from motes.plans import fixtures
    monkeypatch.setitem(fixtures.PART_ROWS, "embeddings", 5)
    t = fixtures.table(spark, sf, "embeddings")
    assert t.rdd.getNumPartitions() == -(-t.count() // 5) > spark.sparkContext.defaultParallelism


def test_a_side_of_many_rows_is_worked_out_once_and_not_broadcast(spark):
    from motes.session import written_side
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    side = spark.range(0, 1000, 1, 20).mapInArrow(each, "id long")
    for limit, plan in ((10, "SortMergeJoin"), (1000, "BroadcastHashJoin")):
        before = seen.value
        j = spark.range(2000).join(written_side(side, limit), "id")
        assert plan in j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 1000 and seen.value - before == 1000


def test_summaries_read_their_tables_once(spark):
    from motes.operators import coloc
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = [("a", i % 3, i % 3 > 0, float(i) if i % 3 else None) for i in range(30)]
    long = spark.createDataFrame(rows, "channel string, count long, positive boolean, nearest_distance double")
    got = coloc.channel_summary(long.mapInArrow(each, long.schema), long.select("channel"), 30).collect()
    assert (got[0]["positive_reference_objects"], got[0]["median_nearest_distance"], seen.value) == (20, 15.0, 30)
    labels = spark.createDataFrame([("x",), ("x",), ("y",)], "label string")
    c = coloc.combination_summary(labels.mapInArrow(each, labels.schema), "label").collect()
    assert [(r["combination"], r["count"]) for r in c] == [("x", 2), ("y", 1)] and seen.value == 33
