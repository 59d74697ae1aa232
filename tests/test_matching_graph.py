import numpy as np
import pandas as pd
import pytest

from motes.operators import graph, matching
from tests.test_spatial import brute, field, rows


def sequential(a, b, limit):
    j = brute(a, b, limit).sort_values(["d2", "id", "id_r"])
    used, out = set(), []
    for im, i, r in zip(j.image, j.id, j.id_r):
        if (0, im, i) in used or (1, im, r) in used:
            continue
        used |= {(0, im, i), (1, im, r)}
        out.append((im, i, r))
    return sorted(out)


@pytest.mark.parametrize("seed,grid,crowd", [(11, 30, 0), (12, 20, 60), (13, None, 60), (14, 6, 0)])
def test_greedy_equals_sequential(spark, seed, grid, crowd):
    a, b = field(seed, 130, grid=grid, crowd=crowd), field(seed + 50, 120, grid=grid, crowd=crowd)
    got = matching.greedy_match(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 4.0)
    assert rows(got, "image", "left_id", "right_id") == sequential(a, b, 4.0)


def test_crowds_of_copies_pair_up_at_once(spark, monkeypatch):
    calls = []
    real = matching._rounds
    monkeypatch.setattr(matching, "_rounds", lambda *a: calls.append(1) or real(*a))
    a, b = field(21, 160, images=1, grid=30), field(22, 150, images=1, grid=30)
    a.loc[:70, ["centroid_x", "centroid_y"]] = 5.0, 5.0
    b.loc[:50, ["centroid_x", "centroid_y"]] = 6.0, 6.0
    b.loc[51:90, ["centroid_x", "centroid_y"]] = 40.0, 40.0
    a.loc[71:130, ["centroid_x", "centroid_y"]] = 40.0, 40.0
    got = matching.greedy_match(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 4.0)
    assert rows(got, "image", "left_id", "right_id") == sequential(a, b, 4.0)
    assert len(calls) < 8


def test_components(spark):
    r = np.random.default_rng(3)
    e = [(int(x), int(y)) for x, y in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    root = {n: n for p in e for n in p}
    for _ in range(500):
        for x, y in e:
            root[x] = root[y] = min(root[x], root[y])
    got = graph.connected_components(spark.createDataFrame(e, "a long, b long"),
                                     spark.createDataFrame([(n,) for n in root] + [(999,)], "node long"))
    assert rows(got, "node", "component") == sorted([*root.items(), (999, 999)])


def dets(spark, rows_):
    return spark.createDataFrame([(1, c, i, float(x), 0.0) for c, i, x in rows_],
                                 "image int, channel string, id long, centroid_x double, centroid_y double")


@pytest.mark.parametrize("points,want", [
    # three channels in a chain are one object
    ([("ch1", 1, 0), ("ch2", 1, 2), ("ch3", 1, 4)], {("ch1", "ch2", "ch3"): 1}),
    # two separate pairs
    ([("ch1", 1, 0), ("ch2", 1, 1), ("ch1", 2, 50), ("ch3", 1, 51)], {("ch1", "ch2"): 1, ("ch1", "ch3"): 1}),
    # singles stay
    ([("ch1", 1, 0), ("ch2", 1, 30)], {("ch1",): 1, ("ch2",): 1})])
def test_signatures(spark, points, want):
    d = dets(spark, points)
    m = matching.channel_pair_matches(d, ["image"], 3.0)
    t = graph.signature_table(graph.channel_signatures(d, m, ["image"]))
    assert {tuple(r["channels"]): r["count"] for r in t.collect()} == want


def test_density_clusters(spark):
    r = np.random.default_rng(8)
    xy = np.concatenate([r.normal(0, .6, (90, 2)), r.normal(12, .6, (80, 2)), r.uniform(-30, 30, (25, 2)),
                         np.full((60, 2), -9.0)])
    n, eps, need = len(xy), 0.9, 5
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= need
    lab = np.arange(n)
    link = (d <= eps) & core[:, None] & core[None]
    for _ in range(n):
        new = np.where(core, np.where(link, lab[None], n).min(1), lab)
        if (new == lab).all():
            break
        lab = new
    want = []
    for i in range(n):
        size = (core & (lab == lab[i])).sum()
        want.append((i, int(lab[i]) if core[i] and size >= 20 else -1))
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "image": 1}))
    got = graph.density_clusters(p, ["image"], ["x", "y"], eps, need, 20)
    assert rows(got, "id", "cluster") == want


def chain_and_star():
    star = [(i, 0) for i in range(1, 20_000)]
    chain = [(100_000 + i, 100_001 + i) for i in range(2_000)]
    return star + chain, {**{i: 0 for i in range(20_000)}, **{100_000 + i: 100_000 for i in range(2_001)}}


@pytest.mark.parametrize("piece,most", [(1_000_000, 0), (700, 9)])
def test_a_star_and_a_chain_take_few_rounds(spark, monkeypatch, piece, most):
    edges, want = chain_and_star()
    calls = []
    real = graph._fingerprint
    monkeypatch.setattr(graph, "_fingerprint", lambda e: calls.append(1) or real(e))
    monkeypatch.setattr(graph, "PIECE", piece)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    assert dict(rows(got, "node", "component")) == want
    assert len(calls) <= most + 1


def test_no_contraction_holds_the_edges_of_a_hub(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(graph, "PIECE", 500)
    e = spark.createDataFrame([(i, 0) for i in range(1, 6_000)], "hi long, lo long")
    parts = e.repartitionByRange(8, "lo", "hi").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2_000


def test_components_of_texts_and_structs(spark):
    from pyspark.sql import functions as F
    r = np.random.default_rng(5)
    e = [(f"n{x:03d}", f"n{y:03d}") for x, y in r.integers(0, 400, (230, 2))]
    root = {n: n for p in e for n in p}
    for _ in range(400):
        for x, y in e:
            root[x] = root[y] = min(root[x], root[y])
    d = spark.createDataFrame(e, "a string, b string")
    got = graph.connected_components(d, spark.createDataFrame([(n,) for n in root], "node string"))
    assert rows(got, "node", "component") == sorted(root.items())
    deep = d.select(F.struct(F.lit(1).alias("k"), F.col("a").alias("n")).alias("a"), F.struct(F.lit(1).alias("k"), F.col("b").alias("n")).alias("b"))
    got = graph.connected_components(deep).select("node.n", F.col("component.n").alias("c"))
    assert set(rows(got, "n", "c")) == {(n, c) for n, c in root.items() if any(n in p and p[0] != p[1] for p in e)}


def growing_chain(n):
    """Left and right objects in turn on a line, each gap a little wider, so one pair waits for the next."""
    at, side = 0.0, {0: [], 1: []}
    for i in range(n):
        side[i % 2].append((1, i, at, 0.0))
        at += 1.0 + (n - i) * 1e-4
    return (pd.DataFrame(side[k], columns=["image", "id", "centroid_x", "centroid_y"]) for k in (0, 1))


@pytest.mark.parametrize("piece", [500_000, 300])
def test_a_long_chain_is_one_piece(spark, monkeypatch, piece):
    a, b = growing_chain(2_000 if piece > 1000 else 60)
    monkeypatch.setattr(matching, "PIECE", piece)
    rounds = []
    real = matching._rounds
    monkeypatch.setattr(matching, "_rounds", lambda *x: rounds.append(1) or real(*x))
    got = matching.greedy_match(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 1.9)
    assert rows(got, "image", "left_id", "right_id") == sequential(a, b, 1.9)
    assert not rounds


def test_pieces_of_a_large_image_and_the_rest(spark, monkeypatch):
    a, b = field(31, 150, images=2, grid=25), field(32, 140, images=2, grid=25)
    for piece in (40, 3):
        monkeypatch.setattr(matching, "PIECE", piece)
        got = matching.greedy_match(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 1.5)
        assert rows(got, "image", "left_id", "right_id") == sequential(a, b, 1.5)


def test_power_vector_of_copies_against_a_plain_iteration(spark):
    """30 copies of a point hang on the same 3 neighbours: one row for them, and the values of the whole matrix."""
    hubs = {(a, b) for p in range(4) for a in range(10 * p, 10 * p + 3) for b in range(a + 1, 10 * p + 3)}
    leaves = {(10 * p + i, 1000 + 30 * p + c) for p in range(3) for i in range(3) for c in range(30)}
    chain = {(0, 10), (10, 20), (20, 30), (30, 31)}
    links = sorted(hubs | leaves | chain)
    ids = sorted({x for e in links for x in e})
    w = np.zeros((len(ids), len(ids)))
    for a, b in links:
        w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = 1
    deg = w.sum(axis=1)
    v = deg / deg.sum()
    for _ in range(6):
        v = (w @ v) / deg
        v /= v.sum()
    at, nodes = graph.power_vector(spark.createDataFrame(links, "lo long, hi long"), 6)
    got = {r["node"]: r["value"] for r in nodes.join(at, "like").collect()}
    assert np.allclose([got[i] for i in ids], v, rtol=1e-9)
    assert at.count() == len({tuple(row) for row in w.tolist()}) < len(ids) / 5
    both = graph.communities(spark.createDataFrame([(b, a) for a, b in links] + links, "src long, dst long"), 2)
    assert sorted(r["id"] for r in both.collect()) == ids
