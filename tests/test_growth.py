"""Steps whose memory, driver traffic or passes must not grow with the number of passes, images or pairs."""

import os
import re
import time

import numpy as np

from pyspark.sql import functions as F

from motes import session
from motes.operators import learn, lookups, matching, pixels, runs, spatial
from motes.session import saved


def test_features_are_read_from_one_written_table(spark):
    left = spark.range(50).select(F.col("id").alias("object_id"), F.lit("s").alias("sample"), F.lit("p").alias("position"),
                                  (F.col("id") % 7).cast("double").alias("a"))
    right = spark.range(50).select(F.col("id").alias("object_id"), (F.col("id") * 2).cast("double").alias("b"))
    f = learn.features(left.join(F.broadcast(right), "object_id"), {"a": "a", "b": "b"})
    # every pass of a fit would send the small side to the driver again
    assert "Join" not in f._jdf.queryExecution().optimizedPlan().toString()
    coords, _ = learn.pca(f, ["a", "b"], 2)
    assert "Join" not in coords._jdf.queryExecution().optimizedPlan().toString() and coords.count() == 50


def _pixels(spark, images: int):
    """Images of 1 to 9 rows and columns with scattered foreground and a gap of rows."""
    px = spark.range(images).select(F.col("id").alias("image"), F.explode(F.expr("sequence(0, id % 9)")).alias("y")).select(
        "image", "y", F.explode(F.expr("sequence(-2L, image % 7)")).alias("x"))
    return px.where("(image * 7 + y * 5 + x * x * 3 + y * x) % 5 < 2 and y <> 4")


def test_small_images_are_labelled_without_a_graph(spark, monkeypatch):
    fg = _pixels(spark, 60).select(F.when(F.col("image") % 2 == 0, "a").otherwise("b").alias("s"), "image", "y", "x")
    r = saved(runs.runs_of(fg, ["s", "image"]))
    wide = runs._across_tasks(r, ["s", "image"])
    names = ["s", "image", "y", "x0", "x1", "label"]
    want = sorted(map(tuple, wide.select(*names).collect()))
    assert len({w[:2] for w in want}) > 40 and max(w[-1] for w in want) > 3
    mixed = runs.component_runs(r, ["s", "image"], most=6)
    assert sorted(map(tuple, mixed.select(*names).collect())) == want

    def graph(*a):
        raise AssertionError("images that fit a task need no rounds of joins")
    monkeypatch.setattr(runs, "connected_components", graph)
    got = runs.component_runs(r, ["s", "image"])
    assert sorted(map(tuple, got.select(*names).collect())) == want and got.schema["label"].dataType.simpleString() == "bigint"
    assert runs.component_runs(r.where("image < 0"), ["s", "image"]).count() == 0


def test_matching_of_regions_reads_written_sides(spark, monkeypatch):
    px = spark.range(12).select(F.col("id").alias("image"), F.explode(F.expr("sequence(0L, 5)")).alias("y")).select(
        "image", "y", F.explode(F.expr("sequence(0L, 5)")).alias("x")).withColumn("value", (F.col("x") + F.col("y") * 10 + F.col("image")).cast("double"))
    fg = px.where("x in (0, 1) or (image % 2 = 0 and x = 4)").drop("value")
    dets = spark.range(14).select(F.col("id").alias("image"), F.explode(F.expr("sequence(1L, 1 + id % 3)")).alias("id")).withColumns(
        {"centroid_x": F.col("id") * 1.5, "centroid_y": F.lit(2.0)})
    seen = []

    def match(d, p, *a):
        seen.extend(x._jdf.queryExecution().optimizedPlan().toString() for x in (d, p))
        assert d.select("image").distinct().count() == p.select("image").distinct().count() > 0
        return matching.greedy_match(d, p, *a)
    monkeypatch.setattr(lookups, "greedy_match", match)
    got = {(r["image"], r["id"]): r["mean_intensity"] for r in lookups.detection_intensity(dets, fg, px, ["image"]).collect()}
    assert len(seen) == 2 and not any("Join" in s or "Aggregate" in s for s in seen)
    assert len(got) == dets.count() and got[(12, 1)] is None and got[(3, 1)] == 28.5
    assert got[(1, 1)] is None or got[(1, 2)] is None
    assert got[(4, 1)] == 29.5 and got[(4, 2)] == 33.0


def _parts(df):
    """Partition numbers of the shuffles that a plan deals by row count."""
    return {int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())}


def _points(spark, n, step):
    return spark.range(n).select((F.col("id") % 3).alias("image"), F.col("id"), F.expr(f"cast((id * {step}) % 59 as double) / 4 - 5").alias("centroid_x"),
                                 F.expr(f"cast((id * {step + 4}) % 61 as double) / 4 - 5").alias("centroid_y"))


def test_pair_join_deals_by_rows_and_makes_few_copies(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    a, b = _points(spark, 90, 7), _points(spark, 400, 11)
    odd = spark.createDataFrame([(0, 1000, float("nan"), 1.0), (0, 1001, float("inf"), 1.0), (0, 1002, None, 1.0)], b.schema)
    for limit in (0.5, 1.25):
        out = spatial.pairs_within(a, b.union(odd), ["image"], limit)
        assert _parts(out) and min(_parts(out)) > 40
        got = sorted((r["image"], r["left_id"], r["right_id"]) for r in out.collect())
        far = [b.collect(), a.collect()]
        want = sorted((p["image"], p["id"], r["id"]) for p in far[1] for r in far[0] if p["image"] == r["image"] and
                      (p["centroid_x"] - r["centroid_x"]) ** 2 + (p["centroid_y"] - r["centroid_y"]) ** 2 <= limit * limit)
        assert got == want and want


def test_neighbours_are_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    for n in (90, 400):
        pts = _points(spark, n, 7)
        out = spatial.k_nearest(pts, pts, ["image"], k=3, skip_self=True)
        assert max(_parts(out), default=0) > 10
        rows = pts.collect()
        want = {(p["id"], place + 1): r for p in rows for place, (_, r) in enumerate(sorted(
            ((p["centroid_x"] - r["centroid_x"]) ** 2 + (p["centroid_y"] - r["centroid_y"]) ** 2, r["id"])
            for r in rows if r["image"] == p["image"] and r["id"] != p["id"])[:3])}
        assert {(r["id"], r["place"]): r["ref_id"] for r in out.collect()} == want


def test_small_images_share_one_array(spark):
    px = _pixels(spark, 60).groupBy("image").agg(F.max("y").alias("h")).select("image", F.explode(F.expr("sequence(0L, h)")).alias("y"), "h").select(
        "image", "y", F.explode(F.expr("sequence(0L, image % 11)")).alias("x")).withColumn("value", (F.col("x") * 3 + F.col("y") * 7 + F.col("image")).cast("double"))
    out = pixels.tiled(px, ["image"], 1, {"ndim": lambda a: np.full_like(a, a.ndim), "right": lambda a: np.roll(a, -1, axis=-1)}, "edge", tile=4).collect()
    stored = {(r["image"], r["y"], r["x"]): r["value"] for r in px.collect()}
    assert len(out) == len(stored) > 300
    for r in out:
        k = (r["image"], r["y"], r["x"])
        # tiles of an image shape are handed over together, and a neighbour is the pixel's own
        assert r["ndim"] == 3 and r["value"] == stored[k] and r["right"] == stored.get((k[0], k[1], k[2] + 1), stored[k])


def test_robust_scale_joins_once_and_broadcasts_no_large_part_table(spark, tmp_path, monkeypatch):
    from motes.operators import matrix, ordering
    from motes.plans import fixtures, objects
    spark.range(60).selectExpr("id as l_orderkey", "id % 3 as l_linenumber", "id % 8 as l_partkey", "id % 2 as l_suppkey", "'A' as l_returnflag",
                               "'F' as l_linestatus", "cast(id as double) as l_extendedprice", "cast(id % 20 as double) as l_quantity",
                               "cast(id % 11 as double) / 100 as l_discount", "cast(id % 9 as double) / 100 as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(8).selectExpr("id as p_partkey", "cast(id + 1 as int) as p_size", "cast(id * id as double) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, objects.scale_robust(spark, str(tmp_path)).collect()))
    assert "BroadcastHashJoin" in plan(fixtures.objects(spark, str(tmp_path)))
    monkeypatch.setattr(fixtures, "SMALL_PART", 7)
    large = fixtures.objects(spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan(large) and "SortMergeJoin" in plan(large)
    # an array among the results of an aggregate makes Spark sort all rows; many rows of few values are counted once
    seen = []
    for name in ("written_side", "saved"):
        monkeypatch.setattr(ordering, name, lambda df, f=getattr(ordering, name): seen.append(plan(df)) or f(df))
    monkeypatch.setattr(ordering, "PIECE_ROWS", 4)
    out = objects.scale_robust(spark, str(tmp_path))
    assert len(seen) == 3 and not any("SortAggregate" in s or "Join" in s and "part.parquet" in s for s in seen)
    assert "SortMergeJoin" not in plan(matrix.scale(large, ["m1", "m4"], "robust"))
    got = sorted(map(tuple, out.collect()))
    q = np.quantile([i % 20 for i in range(60)], [.25, .5, .75])
    assert got == want and len(got) == 60 and all(r[1] == round((r[0] // 100000 // 1000000 // 8 % 20 - q[1]) / (q[2] - q[0]), 5) for r in got)


def _nearest_others(rows, k):
    """The k nearest others of every row by brute force: (id, place) -> squared distance and id."""
    return {(p[0], i + 1): (d, j) for p in rows for i, (d, j) in enumerate(sorted(
        ((p[1] - r[1]) ** 2 + (p[2] - r[2]) ** 2, r[0]) for r in rows if r[0] != p[0])[:k])}


def test_neighbours_in_cells_are_sought_once_a_position_in_short_lists(spark, monkeypatch):
    """Rows shuffled below are short lists a position, never a row for each site of a cell; points of one place ask once."""
    monkeypatch.setattr(spatial, "LEAF_SITES", 4)
    asked = []
    real = spatial._by_position
    monkeypatch.setattr(spatial, "_by_position", lambda *a: asked.append((a[2].count(), a[1].count())) or real(*a))
    for spread, copies in ((1000, 1), (9, 7)):
        pts = spark.range(150).selectExpr("1 as all", "id", f"cast(pmod(xxhash64(id), {spread}) as double) / 7 as centroid_x",
                                          f"cast(pmod(xxhash64(id, 1), {spread}) as double) / 7 as centroid_y")
        pts = saved(pts)
        out = spatial.k_nearest(pts, pts, ["all"], k=5, skip_self=True)
        rows = [(r["id"], r["centroid_x"], r["centroid_y"]) for r in pts.collect()]
        want = _nearest_others(rows, 5)
        assert {(r["id"], r["place"]): (r["distance"], r["ref_id"]) for r in out.collect()} == {k: (d ** .5, j) for k, (d, j) in want.items()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode" in plan and "collect_list(_near" in plan
        assert asked[-1] == (len({r[1:] for r in rows}), 150)
    # rows that share an id share their candidates, by another way
    count, two = len(asked), saved(pts.union(pts))
    got = spatial.k_nearest(two, two, ["all"], k=4, skip_self=True).collect()
    assert len(asked) == count and got and all(r["distance"] >= want[r["id"], 1][0] ** .5 for r in got)


def test_written_tables_leave_no_shuffle_files_and_can_be_dropped(spark):
    from motes.session import CLEANUP, forget
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {b for b in held.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")}
    before = files()
    t = saved(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(.1)
    assert files() <= before and spark.conf.get(CLEANUP) == "false"
    assert t.count() == 7 and os.path.exists(t._saved_at.removeprefix("file:"))
    forget(t)
    assert not os.path.exists(t._saved_at.removeprefix("file:"))


def test_a_forest_too_large_for_the_driver_is_grown_in_parts(spark, monkeypatch, tmp_path):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("double").alias("label"),
                                 (F.col("id") % 2 + F.rand(3) * 1.2).alias("a"), F.rand(4).alias("b"), F.rand(5).alias("c"))
    df = saved(df)
    whole = learn.train_classifier(df, ["a", "b", "c"], trees=12, max_depth=30)
    assert not isinstance(whole, learn.Forest)
    made = []
    real = learn.RandomForestClassifier
    monkeypatch.setattr(learn, "RandomForestClassifier", lambda **kw: made.append(kw) or real(**kw))
    monkeypatch.setattr(learn, "FOREST_NODES", 500)
    parts = learn.train_classifier(df, ["a", "b", "c"], trees=12, max_depth=30)
    assert isinstance(parts, learn.Forest) and sum(n for _, n in parts.parts) == 12 and parts.parts[0][1] == 1
    assert max(kw["numTrees"] for kw in made) < 12 and len({kw["seed"] for kw in made}) == len(made) == len(parts.parts) > 2
    assert {kw["maxDepth"] for kw in made} == {30} and {kw["featureSubsetStrategy"] for kw in made} == {"sqrt"}
    # the probability is the mean over the trees of all parts
    trees = [t for path, _ in parts.parts for t in learn.RandomForestClassificationModel.load(path).trees]
    rows = learn.predict(parts, df, ["a", "b", "c"]).orderBy("id").collect()
    assert len(rows) == 600 and len(trees) == 12 and rows[0].asDict().keys() == learn.predict(whole, df, ["a", "b", "c"]).first().asDict().keys()
    from pyspark.ml.linalg import Vectors
    for r in rows[:40]:
        votes = [list(t.predictProbability(Vectors.dense(r["a"], r["b"], r["c"])))[1] for t in trees]
        assert abs(sum(votes) / 12 - r["probability"]) < 1e-9 and r["predicted"] == int(r["probability"] >= 0.5)
    assert sum(r["predicted"] == r["label"] for r in rows) > 560
    learn.save_model(parts, str(tmp_path / "m"), ["a", "b", "c"], spark, run="7")
    again, doc = learn.load_model(str(tmp_path / "m"), ["a", "b", "c"], spark)
    assert doc == {"features": ["a", "b", "c"], "run": "7"}
    assert [r["probability"] for r in learn.predict(again, df, ["a", "b", "c"]).orderBy("id").collect()] == [r["probability"] for r in rows]
    assert abs(sum(r["importance"] for r in learn.importances(again, ["a", "b", "c"], spark).collect()) - 1) < 1e-9
