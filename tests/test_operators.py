"""Operators against numpy restatements and small hand-made cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.functions import bands, geometry, scoring
from terrafold.operators import components, grids, labels, metrics, pixels, scoring_models, spatial, splits, tiles, tracks
from terrafold.sources import files, geotiff, sinks


def test_missing_samples_stay_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), 1.0)], "a double, b double")
    out = df.select(bands.ndvi(bands.missing_as_null(F.col("a")), F.col("b")).alias("v")).collect()
    assert [r.v for r in out] == [None, None]


def test_zero_divisor_does_not_raise(spark):
    df = spark.createDataFrame([(1.0, -1e-8)], "a double, b double")
    assert df.select(bands.safe_ratio(F.col("a"), F.col("b"))).collect()[0][0] is None


def test_utm_golden(spark):
    df = spark.createDataFrame([(-1.2105003651998283, 6.203190843346759)], "lon double, lat double")
    e, n = geometry.to_utm(F.col("lon"), F.col("lat"), geometry.utm_epsg(F.col("lat"), F.col("lon")))
    r = df.select(e.alias("e"), n.alias("n")).head()
    assert abs(r.e - 698000) < 1e-3 and abs(r.n - 686000) < 1e-3
    back = df.select(e.alias("e"), n.alias("n")).select(*[c.alias(k) for c, k in zip(geometry.from_utm(F.col("e"), F.col("n"), F.lit(32630)), ("lon", "lat"))]).head()
    assert abs(back.lon + 1.2105003651998283) < 1e-9 and abs(back.lat - 6.203190843346759) < 1e-9


def test_pixel_round_trip(spark):
    t = (10.0, 0.0, 698000.0, 0.0, -10.0, 686000.0)
    df = spark.createDataFrame([(3, 5)], "row int, col int")
    x, y = geometry.pixel_to_map(F.col("col"), F.col("row"), tuple(F.lit(v) for v in t), centre=True)
    r, c = geometry.map_to_pixel(F.col("x"), F.col("y"), t)
    assert tuple(df.select(x.alias("x"), y.alias("y")).select(r, c).head()) == (3, 5)


def test_any_two_signals_make_a_vote(spark):
    df = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a int, b int, c int")
    out = df.select((F.col("a") + F.col("b") + F.col("c")).alias("n"), bands.mining_vote(F.col("a") == 1, F.col("b") * 3.0, F.col("c") * 1.0).alias("v")).collect()
    assert all(r.v == (r.n >= 2) for r in out)


def test_repeated_edge_windows(spark):
    n = lambda d: tiles.tile_grid_for(spark, 4141, 1951, 512, 0.2, d).count()
    assert n(True) < n(False)
    t = tiles.tile_grid_for(spark, 300, 200, 512, 0.2).collect()
    assert len(t) == 1 and (t[0].pad_r, t[0].pad_c) == (212, 312)


def test_kalman_matches_matrices(spark):
    z = [1.0, 1.4, 1.1, 2.0, 2.6]
    x, p, f = np.array([z[0], 0.0]), np.eye(2), np.array([[1.0, 1], [0, 1]])
    want = [z[0]]
    for v in z[1:]:
        x, p = f @ x, f @ p @ f.T + 1e-3 * np.eye(2)
        k = p[:, :1] / (p[0, 0] + 0.1)
        x, p = x + k[:, 0] * (v - x[0]), p - k @ p[:1]
        want.append(x[0])
    df = spark.createDataFrame([(z,), ([],), ([3.0],)], "z array<double>").select(tracks.kalman_smooth(F.col("z")).alias("s")).collect()
    assert np.allclose(df[0].s, want, atol=1e-12) and df[1].s == [] and df[2].s == [3.0]


def test_track_status_compat(spark):
    df = spark.createDataFrame([(3, "INACTIVE", 0.5, 0.0)], "n int, a string, r double, c double")
    s = lambda compat: df.select(tracks.track_status(*[F.col(c) for c in "narc"], compat=compat)).head()[0]
    assert s(False) == "STABLE_INACTIVE" and s(True) == "EXPANDING"


def greedy(boxes, thr):
    keep = []
    for b in sorted(boxes, key=lambda b: (-b["c"], b["id"])):
        ok = True
        for k in keep:
            w = min(b["x2"], k["x2"]) - max(b["x1"], k["x1"])
            h = min(b["y2"], k["y2"]) - max(b["y1"], k["y1"])
            i = max(w, 0) * max(h, 0)
            u = 2 * 100 - i
            ok &= i / u <= thr
        if ok:
            keep.append(b)
    return {b["id"] for b in keep}


def test_nms_is_the_greedy_scan(spark):
    rng = np.random.default_rng(1)
    b = [dict(id=i, c=float(rng.integers(0, 9)) / 10, x1=float(x), y1=float(y), x2=float(x) + 10, y2=float(y) + 10) for i, (x, y) in enumerate(rng.integers(0, 60, (80, 2)))]
    got = spatial.nms(spark.createDataFrame(pd.DataFrame(b)), "id", "c", 0.2, 16.0)
    assert {r.id for r in got.collect()} == greedy(b, 0.2)


def test_match_ties_go_to_the_first(spark):
    c = spark.createDataFrame([(0, 1, 7, 0.5), (0, 1, 8, 0.5), (0, 2, 7, 0.9), (0, 2, 8, 0.1)], "g int, n int, o int, s double")
    assert {(r.n, r.o) for r in spatial.greedy_match(c, ["g"], "n", "o", "s").collect()} == {(1, 7), (2, 8)}


def test_track_numbers_beyond_four_digits_stay_apart(spark):
    x = F.col("id") * 1000.0
    sites = spark.range(10_020).select(F.col("id").alias("site_id"), x.alias("cx"), x.alias("cy"), x.alias("x1"), x.alias("y1"), (x + 1).alias("x2"), (x + 1).alias("y2"))
    ids = {r.track_id for r in tracks.assign_tracks([sites]).collect()}
    assert len(ids) == 10_020 and {"TRACK_0001", "TRACK_10020"} <= ids


def test_tracks_follow_drift(spark):
    def epoch(*rows):
        return spark.createDataFrame([(i, x, y, x - 5, y - 5, x + 5, y + 5) for i, x, y in rows], "site_id long, cx double, cy double, x1 double, y1 double, x2 double, y2 double")

    out = tracks.assign_tracks([epoch((1, 0.0, 0.0), (2, 500.0, 0.0)), epoch((3, 3.0, 0.0), (4, 900.0, 0.0)), epoch((5, 4.0, 1.0))]).collect()
    at = {r.site_id: r.track_id for r in out}
    assert at[1] == at[3] == at[5] and len({at[1], at[2], at[4]}) == 3


def test_components_across_chunks(spark):
    rng = np.random.default_rng(2)
    g = rng.random((24, 24)) < 0.55
    cells = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(g))], "s int, row int, col int")
    want = grids.label4(g)
    got = {(r.row, r.col): r.label for r in components.chunk_labels(cells, "s", 7).collect()}
    pairs = {(want[k], v) for k, v in got.items()}
    assert len(got) == g.sum() and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_focal_chunks_equal_the_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.random((20, 17))
    px = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(20) for c in range(17)], "row int, col int, v double")
    ch = grids.map_chunks(grids.chunks_of(px, 8, 2), {"m": lambda a: grids.local_variance(a, 5)})
    want = grids.local_variance(x, 5)
    for r in ch.collect():
        m = np.array(r.m, float).reshape(r.h, r.w)
        for i in range(r.block_row * 8, min(20, r.block_row * 8 + 8)):
            for j in range(r.block_col * 8, min(17, r.block_col * 8 + 8)):
                assert math.isclose(m[i - r.row0, j - r.col0], want[i, j], abs_tol=1e-12)


def test_chunks_with_holes(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (2, 1, 3.0)], "row int, col int, v double")
    r = grids.map_chunks(grids.chunks_of(px, 4, 1), {"same": lambda x: x}).head()
    assert r.same == [1.0, None, 2.0, None, None, None, None, 3.0, None]


def test_edges_and_morphology():
    x = np.zeros((12, 12))
    x[:, 6:] = 255
    e = grids.canny(x)
    assert e[:, 5:7].any() and not e[:, :4].any() and not e[:, 9:].any()
    full = np.ones((6, 6))
    assert not grids.closing(full, 5).all() and grids.closing(full, 5, "edge").all()
    assert grids.remove_small(np.array([[1, 0, 1], [1, 0, 0]]), 2).sum() == 2
    d = grids.distance_within(np.eye(5) > 0, 2)
    assert d[0, 2] == math.sqrt(2) and np.isinf(d[0, 4])


def test_labels(spark):
    rows = ["0 0.5 0.5 0.1 0.1", "9 0.5 0.5 0.1 0.1", "0 1.5 0.5 0.1 0.1", "0 .5 .5 .1", "a 1 1 1 1", "   ", "1  0.25\t0.75 1 0"]
    v = labels.validate(spark.createDataFrame([(r,) for r in rows], "line string"), "line", 5)
    assert [r.issue for r in v.collect()] == [None, "bad class", "cx out of range", "malformed", "malformed", None]


def test_curves_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert metrics.roc_auc(df, "y", "p").head()[0] is None
    assert metrics.object_metrics(0, 3, 0)["false_alarm_rate"] == 3.0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, c double, x1 double, y1 double, x2 double, y2 double")
    assert spatial.nms(e, "id", "c").count() == 0
    assert metrics.scores(metrics.confusion(e, F.col("c") > 1, F.col("c") > 1)).head().f1 == 0.0
    p = spark.createDataFrame([], "row int, col int, v double")
    assert pixels.stretch(p, ["v"]).count() == 0 and pixels.resample(p, 2, "area").count() == 0


def test_splits_do_not_leak(spark):
    s = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    b = splits.split_blocks(splits.spatial_blocks(s, "y", "x"))
    assert {r.split for r in b.select("split").distinct().collect()} == {"train", "val", "test"}
    assert b.groupBy("block").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    kept = splits.drop_near(b, "id", "y", "x", 1.5).toPandas()
    train, rest = kept[kept.split == "train"], kept[kept.split != "train"]
    for t in train.itertuples():
        assert ((rest.x - t.x) ** 2 + (rest.y - t.y) ** 2).min() > 2.25


@pytest.mark.parametrize("compress", ["none", "lzw", "deflate"])
def test_geotiff_round_trip(spark, tmp_path, compress):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40, (2, 70, 90)).astype(np.float32)
    p = f"{tmp_path}/scene_20230115.tif"
    geotiff.write_array(p, x, (10.0, 0.0, 698000.0, 0.0, -10.0, 686000.0), 32630, nodata=7.0, compress=compress, tile=32)
    y, t = geotiff.read_array(p)
    assert np.array_equal(np.where(x == 7, np.nan, x), y, equal_nan=True) and t.epsg == 32630 and t.transform[2] == 698000.0
    spark.dataSource.register(geotiff.GeoTiffSource)
    px = geotiff.pixels(spark.read.format("geotiff").option("bands", "2").load(p)).toPandas()
    assert len(px) == 70 * 90 and set(px.date) == {"20230115"} and px.v.isna().sum() == (x[1] == 7).sum()
    blocks = geotiff.decode_blocks(spark.read.format("binaryFile").load(p))
    assert geotiff.clip_blocks(blocks, 698000, 685990, 698010, 686000).count() == 2


def test_lzw_long_runs():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", bytes(50_000), rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes(), b"abcabc" * 9000):
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


def test_sources(spark, tmp_path):
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}, indent=1))
    b = files.geojson(spark, f"{tmp_path}/b.geojson")
    assert b.count() == 1 and b.select(geometry.ring_area(F.col("rings")[0])).head()[0] == 100.0
    (tmp_path / "g.csv").write_text("latitude,longitude\n5,5\n50,5\nx,1\n")
    g = files.ground_truth(spark, f"{tmp_path}/g.csv", b).collect()
    assert [(r.latitude, r.active_status) for r in g] == [(5.0, "unknown")]
    (tmp_path / "k.kml").write_text("<kml><Document><Folder><Placemark><name>p</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0 0,1,0 0,0,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder></Document></kml>")
    k = files.placemarks(spark, f"{tmp_path}/k.kml").head()
    assert (k.lon, k.lat) == (0.5, 0.5) and abs(k.area_m2 - 111_319**2) < 1
    assert files.date_in_name("synthetic_20230115.tif") == "20230115" and files.date_in_name("synthetic_20230115.tif", compat=True) is None
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "t1.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    assert files.label_folder(spark, f"{tmp_path}/labels").head().tile_id == "t1"
    assert files.read_json(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "s.yaml").write_text("tile_size: 256\nunused: 1\n")
    assert files.load_settings(f"{tmp_path}/s.yaml").tile_size == 256


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "pit", 0.0, 0.0, 1.0, 1.0)], "id int, class_name string, x1 double, y1 double, x2 double, y2 double")
    box = sinks.box_polygon(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    c = json.loads(sinks.feature_collection(d, box, ["id", "class_name"], "class_name"))
    assert c["metadata"] == {"total_detections": 1, "classes": ["pit"]} and len(c["features"][0]["geometry"]["coordinates"][0]) == 5
    assert "<ol>" in sinks.dashboard({"sites": json.dumps(c)}, [{"id": "<1>"}]) and "&lt;1&gt;" in sinks.popup({"id": "<1>"})
    made = []
    build = lambda: made.append(1) or d
    for s in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.resume(spark, f"{tmp_path}/r", s, build).count() == 1
    assert len(made) == 2


def test_scorers(spark):
    ch = spark.createDataFrame([(0, 0, 2, 2, [0.0, 1.0, None, 2.0])], "row0 int, col0 int, h int, w int, data array<double>")
    out = scoring_models.score_chunks(ch, lambda: lambda x: 1 / (1 + np.exp(-x))).head()
    assert out.prob[0] == 0.5 and out.prob[2] == 0.5
    found = scoring_models.score_boxes(ch, lambda: lambda x: [(1, 0.9, 0, 0, 1, 1)], ["row0"]).head()
    assert (found.class_id, found.x2) == (1, 1.0)
    t = scoring_models.thresholds(spark.createDataFrame([(0.6,)], "p double"), "p", {"low": 0.3, "medium": 0.5, "high": 0.7})
    assert {r.level for r in t.collect()} == {"low", "medium"}


def test_seeded_fits():
    d = np.arange(10.0)
    y = 2 * d + 1
    y[3] = 90
    assert abs(tracks.ransac_slope(d, y) - 2) < 1e-9 and tracks.ransac_slope([1], [1]) == 0.0
    p = pd.DataFrame({"sdx": [5.0, 5.2, 4.8, 80.0], "sdy": [1.0, 1.0, 1.0, 9.0]})
    assert np.allclose(spatial.offset_ransac(p, tolerance=2), (5.0, 1.0))


def test_scores_of_unknown_activity(spark):
    df = spark.createDataFrame([("ACTIVE",), ("other",), (None,)], "a string")
    assert [r[0] for r in df.select(scoring.class_score(F.col("a"), scoring.ACTIVITY)).collect()] == [1.0, 0.5, 0.5]


def test_stream_of_epochs(spark, tmp_path):
    from terrafold.streaming.live_tracks import live_tracks

    for i, d in enumerate(("2023-01-15", "2023-02-15")):
        spark.createDataFrame([(i * 10 + 1, d, 10.0 + i, 10.0, 1.0 + i)], "site_id long, date string, cx double, cy double, area double").withColumn("date", F.to_timestamp("date")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("site_id long, date timestamp, cx double, cy double, area double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live_tracks(s).writeStream.format("memory").queryName("tracks_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = spark.table("tracks_out").collect()
    assert len(rows) == 2 and len({r.track_id for r in rows}) == 1 and {r.event for r in rows} == {"new", "seen"}


def test_percentiles_by_brackets(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=20_000)
    y = np.where(rng.random(20_000) < 0.9, 5.0, rng.integers(0, 9, 20_000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": np.nan})).withColumn("w", F.when(F.col("x") > 1, F.col("x")))
    got = pixels.exact_percentiles(df, ["x", "y", "z", "w"], (0.02, 0.5, 0.98), bracket=50)
    for c, v in (("x", x), ("y", y), ("w", x[x > 1])):
        assert np.allclose(got[c], np.percentile(v, [2, 50, 98]), atol=1e-12)
    assert got["z"] == [None, None, None]
    one = spark.createDataFrame([(3.0,)], "x double")
    assert pixels.exact_percentiles(one, ["x"], (0.02, 0.98)) == {"x": [3.0, 3.0]}


def test_priority_by_hand(spark):
    """Weights 0.30 area, 0.25 equipment, 0.20 water, 0.15 confidence, 0.10 activity."""
    rows = [("a", "d", 100.0, 1, 0.8, "ACTIVE", 1.0), ("b", "d", 300.0, 3, 0.4, "INACTIVE", None), ("c", "d", 100.0, 1, 0.8, "ACTIVE", 0.0)]
    df = spark.createDataFrame(rows, "site string, date string, area_m2 double, equipment_count int, confidence double, activity string, water_proximity double")
    got = {r.site: r for r in scoring.priority(df, "date", "site").collect()}
    assert got["a"].priority_score == pytest.approx(0.25 / 2 + 0.20 * 1.0 + 0.15 * 0.8 + 0.10 * 1.0, abs=1e-6)
    assert got["b"].priority_score == pytest.approx(0.30 + 0.25 / (1 + math.exp(-2)) + 0.20 * 0.5 + 0.15 * 0.4 + 0.10 * 0.2, abs=1e-6)
    assert [got[s].priority_rank for s in "abc"] == [2, 1, 3]
    water = {r.site: r.priority_score for r in scoring.priority(df, "date", "site", weights={"water_proximity": 0.5}).collect()}
    assert water["a"] - got["a"].priority_score == pytest.approx(0.3, abs=1e-6)
    with pytest.raises(ValueError):
        scoring.priority(df, "date", "site", weights={"water": 1.0})


def test_settings_read_their_sections(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("prioritization: {weights: {area: 0.5}}\nfusion: {ransac_max_iter: 7}\nvalidation: {spatial_cv_folds: 3, spatial_cv_buffer_km: 1.5}\ninference: {thresholds: {low: 0.1}}\n")
    s = files.load_settings(str(path))
    assert (s.weights, s.ransac_rounds, s.folds, s.block_m, s.thresholds) == ({"area": 0.5}, 7, 3, 1500.0, {"low": 0.1})


def test_percentiles_of_ties_send_little(spark, monkeypatch):
    """A million rows of few values: the search ends on ties and gathers next to nothing."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 10.0).when(F.col("id") % 3 == 1, 11.0).otherwise((F.col("id") % 500).cast("double")).alias("v"))
    held = []
    real = F.collect_list
    monkeypatch.setattr(F, "collect_list", lambda c: held.append(c) or real(c))
    got = pixels.exact_percentiles(df, ["v"], (0.0, 0.02, 0.5, 0.98, 1.0))["v"]
    v = df.toPandas().v.to_numpy()
    assert np.allclose(got, np.percentile(v, [0, 2, 50, 98, 100]))
    two = spark.range(200_000).select((10.0 + F.col("id") % 2).alias("v"))
    held.clear()
    assert pixels.exact_percentiles(two, ["v"], (0.02, 0.98), bracket=1000)["v"] == [10.0, 11.0] and not held


@pytest.mark.parametrize("connect", [4, 8])
def test_regions_across_chunks(spark, connect):
    rng = np.random.default_rng(11)
    grid = rng.random((40, 37)) < (0.6 if connect == 4 else 0.4)
    df = spark.createDataFrame([("s", int(r), int(c), float(r * c)) for r, c in zip(*np.nonzero(grid))], "scene string, row int, col int, v double")
    got = {(r.row, r.col): r.label for r in components.chunk_labels(df, "scene", 7, connect).collect()}
    whole = {(r.row, r.col): r.label for r in components.chunk_labels(df, "scene", 1024, connect).collect()}
    assert got == whole and len(got) == grid.sum()
    near = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connect == 8 else [])
    seen, want = set(), {}
    for cell in sorted(got):
        if cell in seen:
            continue
        todo, seen = [cell], seen | {cell}
        while todo:
            r, c = todo.pop()
            want[r, c] = cell[0] * (1 << 31) + cell[1]
            for i, j in near + [(-i, -j) for i, j in near]:
                if (r + i, c + j) in got and (r + i, c + j) not in seen:
                    seen.add((r + i, c + j))
                    todo.append((r + i, c + j))
    assert got == want


def test_outlines_with_holes(spark):
    rows = ["######", "#....#", "#.##.#", "#....#", "######"]
    cells = [(1 if ch == "#" and not (r == 2 and c in (2, 3)) else 2, r, c) for r, line in enumerate(rows) for c, ch in enumerate(line) if ch == "#"]
    df = spark.createDataFrame(cells, "label int, row int, col int")
    got = {r.label: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in components.rings(df, ["label"], (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)).collect()}
    assert got[1] == [[(100, 50), (112, 50), (112, 40), (100, 40), (100, 50)], got[1][1]] and len(got[1][1]) == 5
    assert len(got[2]) == 1 and set(got[2][0]) == {(104, 46), (108, 46), (108, 44), (104, 44)}
    touch = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 2, 0), (1, 1, -1), (1, 0, -1), (1, 2, -1)], "label int, row int, col int")
    rings = components.rings(touch, ["label"]).head().rings
    assert [len(r) for r in rings] == [5, 5]  # a square of three with a hole


def test_matching_by_rounds_is_the_greedy_scan(spark):
    rng = np.random.default_rng(12)
    rows = sorted({(int(g), int(n), int(o)) for g, n, o in zip(rng.integers(0, 2, 400), rng.integers(0, 40, 400), rng.integers(0, 40, 400))})
    rows = [(g, n, o, float(rng.integers(0, 5))) for g, n, o in rows]
    df = spark.createDataFrame(rows, "g int, n int, o int, s double")
    for score in ("s", None):
        used, done, want = set(), set(), []
        for g, n, o, s in sorted(rows, key=lambda r: (r[0], r[1], -r[3] if score else 0, r[2])):
            if (g, n) not in done and (g, o) not in used:
                done.add((g, n))
                used.add((g, o))
                want.append((g, n, o))
        assert sorted(tuple(r) for r in spatial.greedy_match(df, ["g"], "n", "o", score).collect()) == want
    assert spatial.greedy_match(df.limit(0), ["g"], "n", "o", "s").count() == 0


def test_tracks_follow_shapes(spark):
    """Two boxes that overlap, whose cells do not: by shape they are two sites, by box one track."""
    e = [spark.createDataFrame([(f"{k}", 70.0 * k, 0.0, 0.0, 0.0, 200.0, 200.0)], "site_id string, cx double, cy double, x1 double, y1 double, x2 double, y2 double") for k in (0, 1)]
    cells = spark.createDataFrame([("0", 0, c) for c in range(20)] + [("1", 5, c) for c in range(20)], "site_id string, row int, col int")
    tracks_of = lambda **k: len({r.track_id for r in tracks.assign_tracks(e, **k).collect()})
    assert tracks_of() == 1 and tracks_of(cells=cells) == 2


def test_numbers_without_gathering(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = sorted((r.k, r.n) for r in components.rank_rows(df, "n", "k").collect())
    assert [n for _, n in got] == list(range(5000))
    assert components.rank_rows(df.limit(0), "n", "k").count() == 0


def test_shares_follow_their_beta(spark):
    x = spark.range(20_000).select(splits.beta_share(F.col("id"), 0.4).alias("s")).toPandas().s
    assert abs(x.mean() - 0.5) < 0.01 and abs(x.var() - 0.25 / 1.8) < 0.005  # variance 1 / (4 (2 a + 1))


def test_rings_touched_everywhere(spark):
    ring = [(0.5, 0.5), (3.5, 1.5), (1.5, 3.2), (0.5, 0.5)]
    df = spark.createDataFrame([(1, [{"x": a, "y": b} for a, b in ring])], "k int, ring array<struct<x:double,y:double>>")
    got = {(r.row, r.col) for r in components.rasterise_rings(df, "k", all_touched=True).collect()}
    want = set()
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        for t in np.linspace(0, 1, 4001):
            want.add((int(ay + t * (by - ay)), int(ax + t * (bx - ax))))
    inner = {(r.row, r.col) for r in components.rasterise_rings(df, "k").collect()}
    assert got == want | inner


def test_feature_collection_of_any_size(spark, tmp_path):
    rows = spark.range(0, 500, 1, 4).select("id", (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("x"))
    sinks.write_feature_collection(spark, f"{tmp_path}/f/all.geojson", rows, sinks.box_polygon("x", "x", F.col("x") + 1, F.col("x") + 2), ["id", "kind"], "kind")
    assert [p.name for p in (tmp_path / "f").glob("[!.]*")] == ["all.geojson"]
    whole = json.loads((tmp_path / "f" / "all.geojson").read_text())
    assert whole["metadata"] == {"total_detections": 500, "classes": ["0", "1", "2"]} and [f["properties"]["id"] for f in whole["features"]] == list(range(500))
    (tmp_path / "f" / "pretty.geojson").write_text(json.dumps({**whole, "features": whole["features"][:3]}, indent=1))
    (tmp_path / "f" / "empty.geojson").write_text('{"type": "FeatureCollection", "features": [\n]}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
        got = files.geojson(spark, f"{tmp_path}/f").select("feature_id", F.col("properties")["id"].cast("int").alias("id"), F.col("rings")[0][2]["y"].alias("y")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted([(i, i, i + 2.0) for i in range(500)] + [(i, i, i + 2.0) for i in range(3)])
    sinks.write_feature_collection(spark, f"{tmp_path}/none.geojson", rows.limit(0), sinks.box_polygon("x", "x", "x", "x"), ["id"])
    assert json.loads((tmp_path / "none.geojson").read_text())["features"] == [] and files.geojson(spark, f"{tmp_path}/none.geojson").count() == 0


def test_kml_of_any_size(spark, tmp_path):
    at = lambda x, y: F.struct((F.col("id") + x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0), at(0.0, 0.0))
    sinks.write_kml(spark, f"{tmp_path}/k/doc.kml", spark.range(0, 100, 1, 4), F.concat(F.lit("a & <b> "), F.col("id").cast("string")), ring)
    got = files.placemarks(spark, f"{tmp_path}/k").select("name", F.col("ring")[1]["x"].alias("x"), F.size("ring").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted((f"a & <b> {i}", i + 1.0, 4) for i in range(100))


def test_outline_counts_without_pairs(spark):
    rng = np.random.default_rng(3)
    at = [(s, int(r), int(c)) for s in range(60) for r, c in rng.integers(-3, 4, (rng.integers(1, 25), 2)) + rng.integers(-60, 60, 2)]
    kinds = ["pit", "truck", "excavator", None, "other"]
    found = [(float(x), float(y), kinds[i % 5]) for i, (x, y) in enumerate(rng.integers(-700, 700, (3000, 2)))]
    sites = spark.createDataFrame([(s,) for s in range(61)], "site long")
    cells = spark.createDataFrame(at + at[:10], "site long, row int, col int")
    machines = spark.createDataFrame([*found, (None, 0.0, "pit")], "x double, y double, class_name string")
    got = {r["site"]: r for r in spatial.equipment_near_cells(sites, cells, machines, "site", ("x", "y"), 10.0, 70.0).collect()}
    for s in range(61):
        near = []
        for x, y, k in found:
            gap = [(max(0, c * 10 - x, x - c * 10 - 10), max(0, r * 10 - y, y - r * 10 - 10)) for t, r, c in at if t == s]
            if any(a * a + b * b <= 4900 for a, b in gap):
                near.append(k)
        named = sorted(k for k in near if k)
        assert got[s]["equipment_total"] == len(near) and got[s]["equipment_types"] == named
        assert [tuple(k) for k in got[s]["equipment_counts"]] == [(k, named.count(k)) for k in sorted(set(named))]
        assert got[s]["active_equipment_count"] == sum(k in ("truck", "excavator") for k in named) and got[s]["infrastructure_count"] == named.count("pit")


@pytest.mark.parametrize("at_once", [10_000, 3])
def test_boxes_are_matched_in_order_across_tiles(spark, at_once):
    rng = np.random.default_rng(9)
    table = lambda n: [(int(i), float(x), float(y), float(x - r), float(y - r), float(x + r), float(y + r)) for i, (x, y), r in zip(rng.permutation(n), rng.integers(-400, 400, (n, 2)), rng.integers(2, 9, n))]
    new, old = table(900), table(800)
    names = ("cx", "cy", "x1", "y1", "x2", "y2")
    n = spark.createDataFrame(new, "site_id long, " + ", ".join(f"{c} double" for c in names))
    o = spark.createDataFrame(old, "track_no long, " + ", ".join(f"t_{c} double" for c in names))
    left, want = {t[0]: t for t in old}, set()
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    for i, x, y, *b in sorted(new):
        best = None
        for j, u, v, *c in left.values():
            inter = area((max(b[0], c[0]), max(b[1], c[1]), min(b[2], c[2]), min(b[3], c[3])))
            iou, d = inter / (area(b) + area(c) - inter), math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
            if d <= 40 and (iou >= 0.1 or d < 15):
                best = min(best or (1.0, 0), (-(0.7 * iou + 0.3 * (1 - d / 40)), j))
        if best:
            want.add((i, best[1]))
            del left[best[1]]
    assert {tuple(r) for r in tracks.match_boxes(n, o, 40.0, 0.1, 15.0, at_once, 20).collect()} == want
