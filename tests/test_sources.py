"""Scans, sinks, streams, saved models and the two end-to-end analyses."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motes.operators import learn, lookups, pixels, qc
from motes.plans import workflows
from motes.schema import MarkerSchema
from motes.sources import export, tables
from motes.streaming import streams


def object_csv(path, n=240, raw=True, seed=1):
    r = np.random.default_rng(seed)
    d = {"object_id": np.arange(n) + 1, "sample": r.choice(["A", "B", "C"], n), "position": r.choice(["P1", "P2"], n),
         "centroid_x": r.uniform(0, 500, n), "centroid_y": r.uniform(0, 500, n), "area": r.integers(0, 60, n) * 1.0,
         "perimeter": r.uniform(1, 30, n), "circularity": r.uniform(0, 1, n), "Pan-EV_score": r.uniform(.1, 1, n)}
    for m in ("CD9", "CD63", "CD81"):
        d[f"{m}_positive"] = np.where(r.random(n) < .4, "True", "False")
        if raw:
            d[f"{m}_raw_tiff_mean"] = np.where(r.random(n) < .1, "bad", (r.gamma(2, 50, n)).round(3).astype(str))
    pd.DataFrame(d).to_csv(path, index=False)
    return d


def test_object_table_end_to_end(spark, tmp_path):
    object_csv(tmp_path / "o.csv")
    raw = tables.read_table(spark, str(tmp_path / "o.csv"))
    out = workflows.object_statistics(raw, binarize="matrix", percentile=60.0, draws=50, clusters=3)
    assert out["combinations"].count() == 4
    assert out["reference_enrichment"].count() == 2
    assert out["sample_pairwise"].count() == 9
    assert out["clusters"].count() == 240
    assert out["pca_variance"].orderBy(F.desc("component")).first()["cumulative_ratio"] == pytest.approx(1.0)
    root = str(tmp_path / "bundle")
    export.write_bundle({k: out[k] for k in ("normalized", "thresholds", "qc_summary")}, root)
    export.write_bundle({"summary": out["summary"]}, root, "json")
    assert spark.read.parquet(f"{root}/normalized").count() == 240
    doc = spark.read.json(f"{root}/summary").first()
    assert doc["total_objects"] == 240 and doc["samples"] == ["A", "B", "C"]


def counted(df, acc):
    """``df`` with every row that passes added to an accumulator."""
    def each(parts):
        for p in parts:
            acc.add(len(p))
            yield p
    return df.mapInPandas(each, df.schema)


def test_a_bundle_reads_its_input_once_and_matches_once(spark, tmp_path, monkeypatch):
    object_csv(tmp_path / "o.csv", n=90)
    rows, dets, pairs = (spark.sparkContext.accumulator(0) for _ in range(3))
    raw = counted(tables.read_table(spark, str(tmp_path / "o.csv")), rows)
    out = workflows.object_statistics(raw, binarize="matrix", percentile=60.0, draws=5, clusters=2, markers=["CD81", "CD9", "other"])
    export.write_bundle(out, str(tmp_path / "bundle"), "json")
    assert rows.value == 90
    assert set(export.bundle_tables(spark, str(tmp_path / "bundle"))) == set(out)
    assert out["combinations"].select("combination").first()[0] == "CD81+CD9"  # schema order
    near = workflows.coloc.nearest_by_channel
    monkeypatch.setattr(workflows.coloc, "nearest_by_channel", lambda *a, **kw: counted(near(*a, **kw), pairs))
    detection_folder(tmp_path / "in")
    d = counted(tables.latest_files(spark, str(tmp_path / "in")), dets)
    res = workflows.colocalization(d, "C0", ["C1_ch1"], limit=2.0)
    export.write_bundle(res, str(tmp_path / "coloc"), "csv")
    assert (dets.value, pairs.value) == (11, res["matches"].count())
    back = export.read_bundle(spark, str(tmp_path / "coloc"))
    assert {k: v.count() for k, v in back.items()} == {k: v.count() for k, v in res.items()}


def test_clusters_in_the_chosen_space(spark, tmp_path):
    object_csv(tmp_path / "o.csv", n=60)
    raw = tables.read_table(spark, str(tmp_path / "o.csv"))
    for space in ("pca", "scaled"):
        assert workflows.object_statistics(raw, draws=5, clusters=2, space=space)["clusters"].count() == 60
    with pytest.raises(ValueError, match="space"):
        workflows.object_statistics(raw, draws=5, clusters=2, space="other")


def test_bundles_are_whole_or_as_they_were(spark, tmp_path):
    root = str(tmp_path / "b")
    a, b = spark.range(3), spark.range(5)
    broken = b.withColumn("x", F.expr("cast(raise_error('lost') as int)"))
    with pytest.raises(ValueError, match="no committed bundle"):
        export.read_bundle(spark, root)
    export.write_bundle({"a": a, "b": a}, root)
    with pytest.raises(Exception, match="lost"):
        export.write_bundle({"a": b, "b": broken}, root)
    assert {k: v.count() for k, v in export.read_bundle(spark, root).items()} == {"a": 3, "b": 3}
    export.write_bundle({"b": b, "c": b.withColumn("l", F.array("id"))}, root, "csv")
    back = export.read_bundle(spark, root)
    assert {k: v.count() for k, v in back.items()} == {"a": 3, "b": 5, "c": 5}
    assert sorted(r.l for r in back["c"].collect()) == [f"[{i}]" for i in range(5)]
    with pytest.raises(ValueError, match="already holds \\['a'\\]"):
        export.write_bundle({"a": b, "d": b}, root, mode="error")
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith(".")) == ["_COMMITTED", "a", "b", "c"]
    for name in ("_x", "a/b", ""):
        with pytest.raises(ValueError, match="not a table name"):
            export.write_bundle({name: a}, root)
    # tables that come from the bundle itself are read before anything of it is replaced
    export.write_bundle({"a": export.read_bundle(spark, root)["a"].union(a)}, root)
    assert export.read_bundle(spark, root)["a"].count() == 6


def test_labels_come_from_all_restarts_and_iterations(spark, sf, tmp_path, monkeypatch):
    from motes.operators import graph
    from motes.plans import spatial_queries
    seeds, rounds = [], []
    kmeans, power = learn.KMeans, graph.PowerIterationClustering
    monkeypatch.setattr(learn, "KMeans", lambda **kw: seeds.append(kw["seed"]) or kmeans(**kw))
    monkeypatch.setattr(graph, "PowerIterationClustering", lambda **kw: rounds.append(kw["maxIter"]) or power(**kw))
    object_csv(tmp_path / "o.csv", n=60)
    workflows.object_statistics(tables.read_table(spark, str(tmp_path / "o.csv")), binarize="matrix", percentile=60.0, draws=5, clusters=2)
    spatial_queries.knn_communities(spark, sf)
    assert len(set(seeds)) == 10 and rounds == [20]


def test_strict_and_lenient_cells(spark):
    cols = {c: "1" for c in ("sample", "position", "centroid_x", "centroid_y", "area", "perimeter", "circularity", "p_score")}
    def frame(**kw):
        return spark.createDataFrame([{"object_id": "1", **cols, "m_positive": "x", **kw}])
    ok = tables.typed_objects(frame(circularity="NaN")).first()
    assert ok["m_positive"] is None and ok["circularity"] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.typed_objects(frame(object_id="one")).collect()


def test_schema_rules():
    base = ["object_id", "sample", "position", "centroid_x", "centroid_y", "area", "perimeter", "circularity"]
    with pytest.raises(ValueError, match="score"):
        MarkerSchema.infer([*base, "a_positive"])
    with pytest.raises(ValueError, match="do not cover"):
        MarkerSchema.infer([*base, "x_score", "a_positive", "b_positive", "a_raw_tiff_mean"])
    s = MarkerSchema.infer([*base, "x_score", "a_positive", "raw__a"])
    assert s.rate_column("a") == "raw__a" and s.value_column("a") == "a_positive"


def test_union_says_what_differs_and_renumbers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "object_id long, v string")
    b = spark.createDataFrame([("z", 1)], "v string, object_id long")
    got = tables.union_tables([a, b]).orderBy("object_id").collect()
    assert [(r.object_id, r.v) for r in got] == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ValueError, match="missing columns \\['v'\\]"):
        tables.union_tables([a, b.withColumnRenamed("v", "w")])


def detection_rows(n, shift=0.0):
    return pd.DataFrame({"id": np.arange(n) + 10, "area": 4.0, "perimeter": 7.0, "circularity": .9, "centroid_x": np.arange(n) * 5 + shift,
                         "centroid_y": 3.0, "bbox_x1": np.arange(n) * 5, "bbox_y1": 1, "bbox_x2": np.arange(n) * 5 + 3, "bbox_y2": 4,
                         "score": .8, "mean_intensity": ["" if i % 3 == 0 else f"{i + .123456789:.9f}" for i in range(n)]})


def detection_folder(root):
    for ch, stamp, n, shift in (("C0", "20240101_000000", 3, 0), ("C0", "20240202_000000", 6, 0), ("C1_ch1", "20240101_120000", 5, 1.0)):
        d = root / "S1" / "P1" / ch
        d.mkdir(parents=True, exist_ok=True)
        detection_rows(n, shift).to_csv(d / f"det_results_{stamp}.csv", index=False)


def test_latest_detection_files_and_colocalization(spark, tmp_path):
    detection_folder(tmp_path / "in")
    d = tables.latest_files(spark, str(tmp_path / "in"))
    assert {r.channel: r["count"] for r in d.groupBy("channel").count().collect()} == {"C0": 6, "C1_ch1": 5}
    assert d.where("mean_intensity is null").count() == 4
    for mode in ("nearest_centroid", "overlap"):
        out = workflows.colocalization(d, "C0", ["C1_ch1"], mode=mode, limit=2.0, marker_names={"C1_ch1": "CD9"})
        s = out["summary"].first()
        assert (s.total_reference_objects, s.marker_positive_reference_objects) == (6, 5)
        assert {r.combination: r["count"] for r in out["combination_summary"].collect()} == {"C1_ch1 only": 5, "Negative": 1}
    wide = export.json_cells(out["reference_table"])
    wide.write.option("header", True).csv(str(tmp_path / "wide"))
    back = tables.parsed_json_cells(spark.read.option("header", True).csv(str(tmp_path / "wide")),
                                    {"C1_ch1_matched_ids": "array<bigint>"})
    assert back.selectExpr("sum(size(C1_ch1_matched_ids))").first()[0] == 5
    export.write_detections(d, str(tmp_path / "out"))
    again = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(int(r.id) for r in again.where("channel = 'C0'").collect()) == [1, 2, 3, 4, 5, 6]
    assert {r.mean_intensity for r in again.where("channel = 'C0'").collect()} == {None, "1.12346", "2.12346", "4.12346", "5.12346"}


def test_streams_equal_batch(spark, tmp_path):
    detection_folder(tmp_path / "in")
    s = streams.running_detection_counts(streams.detection_stream(spark, str(tmp_path / "in"), 1))
    streams.to_table(s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    got = {r.channel: r.detections for r in streams.newest_counts(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert got == {"C0": 6, "C1_ch1": 5}

    logs = tmp_path / "log"
    logs.mkdir()
    for i in range(4):
        lines = [{"time": f"2024-01-0{i + 1}T00:00:0{j}", "user_action": "add_step", "step_name": f"step{j}", "params": {"a": str(j)},
                  "input_stage": "raw", "output_stage": f"s{i}{j}", "version_hash": "h", "sample": f"S{j % 2}", "position": "P1"} for j in range(5)]
        (logs / f"{i}.json").write_text("\n".join(json.dumps(x) for x in lines))
    q = streams.to_table(streams.running_log_state(streams.log_stream(spark, str(logs), 1)), str(tmp_path / "ls"), str(tmp_path / "lc"))
    q.awaitTermination(120)
    from motes.operators.manifest import LOG_SCHEMA, log_state
    batch = log_state(spark.read.schema(LOG_SCHEMA).json(str(logs)))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "ls")).collect())) == sorted(map(tuple, batch.collect()))


def test_only_the_newest_files_are_opened_and_each_header_counts(spark, tmp_path):
    root = tmp_path / "in put+x"
    def put(where, name, rows, drop=()):
        (root / where).mkdir(parents=True, exist_ok=True)
        rows.drop(columns=list(drop)).to_csv(root / where / name, index=False)
    put("S 1/P+1/C0", "a_results_20240101_000000.csv", detection_rows(9))
    put("S 1/P+1/C0", "a_results_20240202_000000.csv", detection_rows(3), ["mean_intensity"])
    put("S 1/P+1/C1", "a_results_20240101_000000.csv", detection_rows(4)[detection_rows(4).columns[::-1]])
    put("S 1/P+1/C2", "a_results_last.csv", detection_rows(2).assign(extra="x"))
    put("S 1/P+1/C[3]", "a_results_20240101_000000.csv", detection_rows(1))
    put("S 1/P+1/C4", "a_results_20240101_000000.csv", detection_rows(0))
    put("S 1/P+1", "a_results_20240101_000000.csv", detection_rows(7))
    d = tables.latest_files(spark, str(root))
    opened = [f for f in d.inputFiles()]
    assert len(opened) == 5 and not any("C0/a_results_20240101" in f for f in opened)
    rows = d.collect()
    assert {(r.sample, r.position) for r in rows} == {("S 1", "P+1")}
    by = {c: [r for r in rows if r.channel == c] for c in ("C0", "C1", "C2", "C[3]", "C4")}
    assert {c: len(v) for c, v in by.items()} == {"C0": 3, "C1": 4, "C2": 2, "C[3]": 1, "C4": 0}
    assert {r.mean_intensity for r in by["C0"]} == {None}
    assert sorted(r.mean_intensity for r in by["C1"] if r.mean_intensity is not None) == [1.123456789, 2.123456789]
    assert sorted(r.centroid_x for r in by["C1"]) == [0, 5, 10, 15] and {r.score for r in rows} == {.8}
    (tmp_path / "none").mkdir()
    assert tables.latest_files(spark, str(tmp_path / "none")).collect() == []


def test_upserts_hold_one_row_a_key_and_equal_batch(spark, tmp_path):
    root = tmp_path / "in"
    def put(ch, stamp, n):
        (root / "S1" / "P1" / ch).mkdir(parents=True, exist_ok=True)
        detection_rows(n).to_csv(root / "S1" / "P1" / ch / f"det_results_{stamp:08d}_000000.csv", index=False)
    def run(files):
        q = streams.upsert_newest_counts(streams.detection_stream(spark, str(root), files), str(tmp_path / "t"), str(tmp_path / "c"))
        assert q.awaitTermination(120) and q.exception() is None
        table = {(r.channel, r.file): r.detections for r in streams.state_table(spark, str(tmp_path / "t")).collect()}
        newest = {(r.channel, r.file) for r in tables.newest_paths(spark, str(root)).collect()}
        counts = {r.channel: r["count"] for r in tables.latest_files(spark, str(root)).groupBy("channel").count().collect()}
        assert set(table) == newest and {c: n for (c, _), n in table.items()} == counts
    for stamp in range(30):
        for ch in ("C0", "C1"):
            put(ch, stamp, 1 + (stamp * 7) % 5)
    run(15)
    put("C0", 40, 8)
    put("C1", 3, 2)
    put("C2", 1, 6)
    run(15)
    assert len([p for p in (tmp_path / "t").iterdir()]) <= 2

    from motes.operators.manifest import LOG_SCHEMA, log_state
    logs = tmp_path / "log"
    logs.mkdir()
    for i in range(4):
        lines = [{"time": f"2024-01-0{i + 1}T00:00:0{j}", "user_action": "add_step", "step_name": f"step{j}", "params": {"a": str(j)},
                  "input_stage": "raw", "output_stage": f"s{i}{j}", "version_hash": "h", "sample": f"S{i + j % 2}", "position": "P1"} for j in range(5)]
        (logs / f"{i}.json").write_text("\n".join(json.dumps(x) for x in lines))
    state = streams.running_log_state(streams.log_stream(spark, str(logs), 1))
    q = streams.upsert_state(state, ["sample", "position"], str(tmp_path / "lt"), str(tmp_path / "lc"))
    assert q.awaitTermination(120) and q.exception() is None
    batch = log_state(spark.read.schema(LOG_SCHEMA).json(str(logs)))
    got = streams.state_table(spark, str(tmp_path / "lt")).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_saved_filter_states():
    assert tables.saved_id_filter('{"enabled": true, "objectIds": [3, "4"]}') == [3, 4]
    assert tables.saved_id_filter('{"enabled": true, "objectIds": []}') == []
    for text in ('{"enabled": false, "objectIds": [1]}', "broken", None, '{"enabled": true}'):
        assert tables.saved_id_filter(text) is None
    assert tables.saved_id_filter('{"objectIds": ["4.0", "x", null, 7.9, [1]]}') == [4, 7]


def test_saved_filters_as_a_table_follow_the_same_rules(spark):
    docs = ['{"enabled": true, "objectIds": [3, "4"]}', '{"enabled": true, "objectIds": []}', '{"enabled": false, "objectIds": [1]}', "broken", None,
            '{"enabled": true}', '{"objectIds": ["4.0", "x", null, 7.9, [1]]}', '{"enabled": "false", "objectIds": [1]}', '{"enabled": null, "objectIds": 5}',
            "[1, 2]", '{"objectIds": [true, "1e2", "nan"]}']
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    got = {r.k: r.ids for r in tables.saved_filters(df, ["k"], "doc").collect()}
    assert {k: got.get(k) for k in range(len(docs))} == {k: tables.saved_id_filter(d) for k, d in enumerate(docs)}
    dets = spark.createDataFrame([(k, i) for k in range(len(docs)) for i in (1, 3, 4, 7, 100)], "k int, id long")
    kept = sorted(map(tuple, tables.with_saved_filters(dets, tables.saved_filters(df, ["k"], "doc"), ["k"]).collect()))
    assert kept == sorted((k, i) for k, d in enumerate(docs) for i in (1, 3, 4, 7, 100)
                          if tables.saved_id_filter(d) is None or i in tables.saved_id_filter(d))


def test_intensity_text_is_the_general_form(spark):
    values = [5.0, 1.234567e-5, 1234567.0, 0.0, -12.5, 0.0001, 999999.5, 123456.0, 1e100, 0.1 + 0.2, float("inf"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r.k: r.t for r in df.select("k", export.general_text(F.col("v")).alias("t")).collect()}
    assert [got[k] for k in range(len(values))] == [None if v is None or v == float("inf") else f"{v:.6g}" for v in values]


def test_model_is_refused_for_other_features(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.random((200, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a > .5)) for a, b in x], "f1 double, f2 double, label int")
    m = learn.train_classifier(df, ["f1", "f2"], trees=5, max_depth=3)
    learn.save_model(m, str(tmp_path / "m"), ["f1", "f2"], spark, source="unit test")
    again, doc = learn.load_model(str(tmp_path / "m"), ["f1", "f2"], spark)
    assert doc["source"] == "unit test"
    p = learn.predict(again, df, ["f1", "f2"])
    assert p.where("predicted = label").count() > 190
    assert learn.importances(again, ["f1", "f2"], spark).orderBy(F.desc("importance")).first()["feature"] == "f1"
    with pytest.raises(ValueError, match="trained on"):
        learn.load_model(str(tmp_path / "m"), ["f1"], spark)
    with pytest.raises(ValueError, match="two classes"):
        learn.train_classifier(df.where("label = 1"), ["f1", "f2"])


@pytest.mark.parametrize("tile", [7, 256])
def test_tiles_do_not_show(spark, tile):
    """A blur cut into small tiles equals the blur of the whole image."""
    r = np.random.default_rng(2)
    a = r.random((23, 31))
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(23) for x in range(31)], "image int, y long, x long, value double")
    k = pixels.gaussian_kernel(1.0)
    out = pixels.tiled(px, ["image"], 4, {"g": k}, "edge", tile=tile)
    want = k(np.pad(a, 4, mode="edge"))[4:-4, 4:-4]
    for q in out.collect():
        assert q.g == pytest.approx(want[q.y, q.x])


def test_region_numbers_and_solidity(spark):
    art = ["##..#", "#...#", "....#", "##..."]
    fg = spark.createDataFrame([(1, y, x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"], "image int, y long, x long")
    lab = pixels.components8(fg, ["image"])
    assert {(r.y, r.x): r.label for r in lab.collect()} == {
        (0, 0): 1, (0, 1): 1, (1, 0): 1, (0, 4): 2, (1, 4): 2, (2, 4): 2, (3, 0): 3, (3, 1): 3}
    p = {r.label: r for r in pixels.region_properties(lab, ["image"]).collect()}
    assert (p[1].area, p[1].perimeter_crack, p[2].perimeter_crack) == (3, 8, 8)
    s = {r.label: r.solidity for r in pixels.region_solidity(lab, ["image"]).collect()}
    assert s[2] == pytest.approx(1.0) and s[1] == pytest.approx(3 / 3.5)


def test_box_means_equal_slices(spark):
    r = np.random.default_rng(3)
    a = r.random((9, 12))
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(9) for x in range(12)], "image int, y long, x long, value double")
    boxes = [(i, int(x1), int(y1), int(x1 + w), int(y1 + h)) for i, (x1, y1, w, h) in enumerate(
        zip(r.integers(0, 6, 20), r.integers(0, 5, 20), r.integers(0, 6, 20), r.integers(0, 4, 20)))]
    df = spark.createDataFrame([(1, *b) for b in boxes], "image int, id int, _ix1 long, _iy1 long, _ix2 long, _iy2 long")
    got = {q.id: q.m for q in lookups.box_means(df, px, ["image"], ["id"], "m").collect()}
    for i, x1, y1, x2, y2 in boxes:
        assert got[i] == pytest.approx(a[y1:y2 + 1, x1:x2 + 1].mean())


def test_unknown_marker_filter_is_an_error():
    with pytest.raises(ValueError, match="unknown marker"):
        qc.qc_predicates(["area"], min_marker={"zz": 1.0})


def test_no_query_without_tables(spark):
    """Every registered query asks for tables of the given folder: none works where there are none."""
    from pyspark.errors import AnalysisException

    from motes.plans import catalog
    qs, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 120
    for name, fn in qs.items():
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND.*no-such-folder"):
            fn(spark, "/tmp/no-such-folder")
            pytest.fail(f"{name} runs without tables")


def test_preferred_image_takes_one_cached_stage_only(spark):
    rows = [("a", "aligned", "a0", True), ("a", "raw", "a1", True), ("b", "aligned", "b0", False), ("b", "step1", "b5", True),
            ("b", "processed", "b3", True), ("c", "raw", "c1", False), ("c", "processed", "c3", True), ("c", "folder", "c9", True),
            ("d", "raw", "d1", False), ("d", "step4", "d7", True), ("e", "folder", "e9", True), ("f", "elsewhere", "f", True)]
    got = tables.preferred_image(spark.createDataFrame(rows, "k string, stage string, path string, exists boolean"), ["k"]).collect()
    assert {r.k: (r.path, r.stage) for r in got} == {
        "a": ("a0", "aligned"), "b": ("b3", "processed"), "c": ("c9", "folder"), "d": (None, None), "e": ("e9", "folder"), "f": (None, None)}


def test_biomarkers_by_sample(spark):
    f = spark.createDataFrame([("s", "C1_ch2", "a_results_1.csv"), ("t", "C1_ch2", "a_run_1.json"), ("s", "c2_ch1", "x"), ("s", "C1", "x"), ("s", "C9_ch9", "x")],
                              "sample string, channel string, path string")
    dim = spark.createDataFrame([("s", "c1", "Ch2", "CD9"), ("t", "C1", "CH2", "CD63"), ("s", "C2", "CH1", "A"), ("s", "C2", "CH1", "B"), ("s", "C1", "", "Z")],
                                "sample string, cycle string, channel string, marker string")
    got = tables.artefact_inventory(f, ["sample", "channel"], dim=dim).collect()
    assert {(r.sample, r.channel): r.biomarker for r in got} == {
        ("s", "C1_ch2"): "CD9", ("t", "C1_ch2"): "CD63", ("s", "c2_ch1"): "B", ("s", "C1"): "", ("s", "C9_ch9"): ""}


def test_tiles_carry_all_columns_as_they_are(spark):
    """Columns beside the value come back untouched, repeated pixels each with their own."""
    px = spark.sql("select 1 as image, cast(id div 6 as int) as y, id % 6 as x, cast(id as float) as value, "
                   "if(id % 2 = 0, 9007199254740993 + id, null) as big, array(id) as l, timestamp'2024-01-01 00:00:00' as at from range(30)")
    px = px.union(px.where("x = 5 and y = 4"))
    out = pixels.tiled(px, ["image"], 1, {"same": lambda a: a}, "edge", tile=4)
    assert out.columns == ["image", "y", "x", "value", "big", "l", "at", "same"]
    assert [f.dataType for f in out.schema][:7] == [f.dataType for f in px.select("image", "y", "x", "value", "big", "l", "at").schema]
    assert sorted(map(str, out.drop("same").collect())) == sorted(map(str, px.select("image", "y", "x", "value", "big", "l", "at").collect()))
    assert out.where("same <> value").count() == 0
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") <= 1  # with the sizes of the images
