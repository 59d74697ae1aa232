"""Spatial joins against brute force on small fields, crowded ones included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motes.operators import spatial
from motes.session import saved


def field(seed, n, images=2, grid=None, span=60.0, crowd=0):
    r = np.random.default_rng(seed)
    xy = r.integers(0, grid, (n, 2)).astype(float) if grid else r.uniform(0, span, (n, 2))
    if crowd:
        xy[:crowd] = xy[0] + (r.integers(0, 3, (crowd, 2)) if grid else r.normal(0, 0.01, (crowd, 2)))
    return pd.DataFrame({"image": r.integers(0, images, n), "id": np.arange(n) + 1,
                         "centroid_x": xy[:, 0], "centroid_y": xy[:, 1]})


def brute(a, b, limit=None, inclusive=True):
    j = a.merge(b, on="image", suffixes=("", "_r"))
    dx, dy = j.centroid_x - j.centroid_x_r, j.centroid_y - j.centroid_y_r
    j["d2"] = dx * dx + dy * dy
    if limit is not None:
        j = j[j.d2 <= limit * limit] if inclusive else j[j.d2 < limit * limit]
    return j


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("hot", [50_000, 4])
def test_pairs_within(spark, monkeypatch, hot):
    monkeypatch.setattr(spatial, "HOT_ROWS", hot)
    a, b = field(1, 200, grid=40, crowd=60), field(2, 180, grid=40, crowd=50)
    got = rows(spatial.pairs_within(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 5),
               "image", "left_id", "right_id")
    j = brute(a, b, 5)
    assert got == sorted(zip(j.image, j.id, j.id_r))


@pytest.mark.parametrize("points", [4096, 8])
@pytest.mark.parametrize("k,bound,skip,grid,crowd", [
    (1, 6.0, False, 30, 0), (1, 6.0, False, 30, 150), (1, None, False, None, 200), (1, None, False, 30, 0),
    (4, None, True, 25, 150), (3, 5.0, False, 30, 150), (5, None, True, None, 200)])
def test_k_nearest(spark, monkeypatch, points, k, bound, skip, grid, crowd):
    monkeypatch.setattr(spatial, "LEAF_POINTS", points)
    a = field(3, 250, grid=grid, crowd=crowd)
    b = a if skip else field(4, 300, grid=grid, crowd=crowd)
    got = spatial.k_nearest(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], k=k,
                            bound=bound, skip_self=skip)
    j = brute(a, b, bound, inclusive=False)
    if skip:
        j = j[j.id != j.id_r]
    j = j.sort_values(["id", "d2", "id_r"])
    j["place"] = j.groupby("id").cumcount() + 1
    j = j[j.place <= k]
    assert rows(got, "id", "place", "ref_id") == sorted(zip(j.id, j.place, j.id_r))


def test_an_image_of_many_points_meets_nowhere(spark, monkeypatch):
    """All points of one image lie in one top cell; pairs of cells and points of a finest cell stay few."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(spatial, "LEAF_POINTS", 64)
    seen = []
    real = spatial._cell_pairs
    monkeypatch.setattr(spatial, "_cell_pairs", lambda *a: seen.append((a, real(*a))) or seen[-1][1])
    a, b = field(41, 6000, images=1, span=5.0), field(42, 900, images=1, span=5.0)
    got = spatial.k_nearest(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], bound=50.0)
    d = ((a[["centroid_x", "centroid_y"]].to_numpy()[:, None] - b[["centroid_x", "centroid_y"]].to_numpy()[None]) ** 2).sum(2)
    assert rows(got, "id", "ref_id") == sorted(zip(a.id, b.id.to_numpy()[d.argmin(1)]))
    (grid, spots, _, level, _), front = seen[0]
    assert front.groupBy(*grid.asking).count().agg(F.max("count")).first()[0] <= 40
    assert grid.crowd(spots, level) <= 64


@pytest.mark.parametrize("grid,crowd", [(40, 0), (25, 150), (None, 200)])
def test_counts_within(spark, grid, crowd):
    a, b = field(31, 200, grid=grid, crowd=crowd), field(32, 260, grid=grid, crowd=crowd)
    got = spatial.counts_within(spark.createDataFrame(a), spark.createDataFrame(b), ["image"], 6.0)
    want = brute(a, b, 6.0).groupby(["image", "id"]).size()
    assert rows(got, "image", "id", "n") == sorted((i, j, int(n)) for (i, j), n in want.items())


def test_nearest_bound_is_exclusive(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0)], "image int, id long, centroid_x double, centroid_y double")
    b = spark.createDataFrame([(1, 9, 3.0, 4.0)], a.schema)
    assert spatial.nearest_reference(a, b, ["image"], 5).count() == 0
    assert spatial.nearest_reference(a, b, ["image"], 5, inclusive=True).count() == 1


@pytest.mark.parametrize("hot", [50_000, 4])
def test_box_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spatial, "HOT_ROWS", hot)
    r = np.random.default_rng(5)

    def boxes(seed, n):
        f = field(seed, n, grid=80)
        w = r.choice([0.0, 1.0, 3.0, 9.5, 64.0], (n, 2))
        f["bbox_x1"], f["bbox_y1"] = f.centroid_x, f.centroid_y
        f["bbox_x2"], f["bbox_y2"] = f.bbox_x1 + w[:, 0], f.bbox_y1 + w[:, 1]
        return f
    a, b = boxes(6, 150), boxes(7, 160)
    j = a.merge(b, on="image", suffixes=("", "_r"))
    j = j[(j.bbox_x1 < j.bbox_x2_r) & (j.bbox_x1_r < j.bbox_x2) & (j.bbox_y1 < j.bbox_y2_r) & (j.bbox_y1_r < j.bbox_y2)]
    got = rows(spatial.box_pairs(spark.createDataFrame(a), spark.createDataFrame(b), ["image"]), "left_id", "right_id")
    assert got == sorted(zip(j.id, j.id_r))


def test_masks_that_never_touch_fall_back_to_boxes(spark):
    cols = "image int, id long, centroid_x double, centroid_y double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"
    ref = spark.createDataFrame([(1, 1, 1.0, 1.0, 0.0, 0.0, 3.0, 3.0), (2, 1, 1.0, 1.0, 0.0, 0.0, 3.0, 3.0)], cols)
    mark = spark.createDataFrame([(1, 5, 2.0, 2.0, 2.0, 2.0, 4.0, 4.0), (2, 5, 2.0, 2.0, 2.0, 2.0, 4.0, 4.0)], cols)
    px = "image int, y int, x int, label int"
    rp = spark.createDataFrame([(1, 0, 0, 1), (2, 2, 2, 1)], px)
    mp = spark.createDataFrame([(1, 3, 3, 5), (2, 2, 2, 5)], px)
    loose = spatial.overlap_matches(ref, mark, ["image"], rp, mp)
    assert rows(loose, "image", "left_id", "right_id") == [(1, 1, 5), (2, 1, 5)]
    strict = spatial.overlap_matches(ref, mark, ["image"], rp, mp, strict_mask=True)
    assert rows(strict, "image", "left_id", "right_id") == [(2, 1, 5)]


def test_exploded_sides_are_not_broadcast(spark):
    """Spark sees rows made by explode as small as their source and gathers them on the driver."""
    a, b = (saved(spark.createDataFrame(field(s, 50))) for s in (1, 2))
    boxes = [d.withColumns({c: F.col("centroid_x") + i for i, c in enumerate(spatial.BOX)}) for d in (a, b)]
    for df in (spatial.pairs_within(a, b, ["image"], 5), spatial.k_nearest(a, b, ["image"], k=2, bound=5.0),
               spatial.box_pairs(*boxes, ["image"])):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
