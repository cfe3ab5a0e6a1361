"""Scenes of known shape, sources, and what must not depend on partitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborlake.config import SurveyConfig, from_values
from arborlake.operators import descriptors, graph, grid, neighbours, stems, terrain, trees, validate, views
from arborlake.plans import evaluate, fixtures, inventory
from arborlake.sources import las, tables
from arborlake.streaming.counts import streaming_voxel_counts

from .conftest import SF


def frame(spark, columns, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns))


def trunk(cx, cy, r, n=900, lean=0.0, seed=0, low=0.3, high=6.0, ground=0.0):
    rng = np.random.default_rng(seed)
    a, h = rng.uniform(0, 2 * np.pi, n), rng.uniform(low, high, n)
    return np.column_stack((cx + r * np.cos(a) + lean * h, cy + r * np.sin(a), h + ground)) + rng.normal(0, 0.001, (n, 3))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_do_not_matter(spark, parts):
    cloud = fixtures.cloud(spark, SF).select("pid", "tree_id", "x", "y", "z", "h")
    spread = cloud.repartition(parts, F.xxhash64("pid"))
    for f in (lambda c: grid.remove_isolated(c), lambda c: grid.thin(c, 0.15), lambda c: trees.heights(c)):
        assert sorted(map(str, f(cloud).collect())) == sorted(map(str, f(spread).collect()))


def test_thinning_is_idempotent_and_the_filter_monotone(spark):
    cloud = fixtures.cloud(spark, SF).select("pid", "x", "y", "z")
    once = grid.thin(cloud, 0.2)
    assert grid.thin(once, 0.2).count() <= once.count()
    ids = [set(r.pid for r in grid.remove_isolated(cloud, 0.5, n).select("pid").collect()) for n in (2, 4, 8)]
    assert ids[0] >= ids[1] >= ids[2]


def test_stems_of_cylinders(spark):
    # dense enough that eight of a layer's thinned points lie within 0.10 m all around the widest stem
    rows = np.vstack([trunk(0, 0, 0.10, 4000, seed=1), trunk(3, 1, 0.15, 4000, seed=2, lean=0.1), trunk(6, 2, 0.07, 4000, seed=3)])
    rng = np.random.default_rng(9)
    clutter = np.column_stack((rng.uniform(-2, 8, (400, 2)), rng.uniform(0.3, 4, 400)))
    xyz = np.vstack((rows, clutter))
    cloud = frame(spark, ["pid", "x", "y", "z"], {"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}).withColumn("h", F.col("z"))
    cfg = SurveyConfig(stem_dbscan_min_pts=8, stem_dbscan_eps=0.10)
    seeds, _, stacks, own = stems.detect_stems(cloud, cfg)
    found = sorted((r.x, r.stack_diameter, r.axis_z) for r in seeds.collect())
    assert len(found) == 3
    for (x, d, az), (cx, r, lean) in zip(found, ((0, 0.10, 0), (3.13, 0.15, 0.1), (6, 0.07, 0))):
        assert abs(x - cx) < 0.02 and abs(d - 2 * r) < 0.012
        assert abs(math.degrees(math.acos(min(1, abs(az)))) - math.degrees(math.atan(lean))) < 1.5
    points = cloud.join(own, "pid")
    table = trees.breast_height_diameters(cloud.join(own.select("pid", "tree_id"), "pid"), seeds, cfg)
    assert points.count() > 500
    for r in table.collect():
        assert r.dbh_source == "axis_fit" and r.dbh_arc > 0.8


def test_no_stems_in_clutter(spark):
    rng = np.random.default_rng(4)
    xyz = rng.uniform(0, 4, (3000, 3))
    cloud = frame(spark, ["pid", "x", "y", "z"], {"pid": np.arange(3000), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}).withColumn("h", F.col("z"))
    assert stems.detect_stems(cloud, SurveyConfig())[0].count() == 0


def test_geodesic_beats_straight_lines(spark):
    """A branch of tree 0 hangs over tree 1; along the graph it still belongs to tree 0."""
    chain = [(i, i + 1, 1.0) for i in range(10)] + [(20, 21, 1.0), (21, 10, 5.0)]
    edges = frame(spark, ["a", "b", "w"], {k: [e[i] for e in chain] for i, k in enumerate("abw")})
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    seeds = frame(spark, ["node", "label"], {"node": [0, 20], "label": [0, 1]})
    got = {r.node: (r.label, r.dist) for r in graph.geodesic_labels(both, seeds).collect()}
    assert got[9] == (1, 7.0) and got[7] == (0, 7.0) and got[8] == (0, 8.0) and got[10] == (1, 6.0)


@pytest.mark.parametrize("n_parts", [1, 40])
def test_geodesic_over_many_parts_and_rounds(spark, n_parts):
    """A long grid dealt in strips, more rounds than tables are kept, against shortest paths from all seeds."""
    rng = np.random.default_rng(6)
    wide, high = 80, 4
    index = np.arange(wide * high).reshape(wide, high)
    pairs = np.concatenate([np.column_stack((index[:-1].ravel(), index[1:].ravel())), np.column_stack((index[:, :-1].ravel(), index[:, 1:].ravel()))])
    pairs = pairs[rng.random(len(pairs)) < 0.9]
    w = rng.integers(1, 9, len(pairs)).astype(float)
    far = {int(index[0, 0]): (0.0, 3), int(index[79, 3]): (0.0, 1), int(index[30, 2]): (0.0, 2), 9999: (0.0, 7)}
    best = dict(far)
    while True:
        offers = [(b, best[a][0] + x, best[a][1]) for (p, q), x in zip(pairs.tolist(), w, strict=True) for a, b in ((p, q), (q, p)) if a in best]
        better = [(b, d, k) for b, d, k in offers if (d, k) < best.get(b, (np.inf, 0))]
        if not better:
            break
        for b, d, k in better:
            best[b] = min(best.get(b, (np.inf, 0)), (d, k))
    rows = [(a, b, x) for (p, q), x in zip(pairs.tolist(), w.tolist(), strict=True) for a, b in ((p, q), (q, p))]
    edges = spark.createDataFrame(rows, "a long, b long, w double")
    seeds = spark.createDataFrame([(n, k) for n, (_, k) in far.items()], "node long, label long")
    parts = spark.createDataFrame([(int(n), int(n) // high * n_parts // wide) for n in [*index.ravel(), 9999]], "node long, part long")
    got = {r.node: (r.dist, r.label) for r in graph.geodesic_labels(edges, seeds, parts).collect()}
    assert got == best


def test_components_and_clusters(spark):
    nodes = frame(spark, ["node"], {"node": range(12)})
    edges = frame(spark, ["a", "b"], {"a": [0, 1, 5, 9, 9], "b": [1, 2, 4, 8, 9]})
    got = {r.node: r.root for r in graph.components(nodes, edges).collect()}
    assert [got[i] for i in range(12)] == [0, 0, 0, 3, 4, 4, 6, 7, 8, 8, 10, 11]
    line = frame(spark, ["pid", "x", "y"], {"pid": range(8), "x": [0, 0.5, 1, 1.5, 5, 5.5, 6, 20], "y": [0.0] * 8})
    found = {r.pid: r.cluster for r in graph.density_clusters(line, 0.6, 2).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: None}


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(7)
    p = np.round(rng.uniform(-3, 3, (150, 3)), 3)
    df = frame(spark, ["pid", "x", "y", "z"], {"pid": np.arange(150), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    got = {(r.src, r.dst) for r in neighbours.nearest_k(df, 4, 1.0, "pid").collect()}
    want = set()
    for i in range(150):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        want |= {(i, int(j)) for j in sorted((j for j in range(150) if j != i and d[j] <= 1.0), key=lambda j: (d[j], j))[:4]}
    assert got == want


def test_terrain_of_a_slope_with_a_hole_and_a_spike(spark):
    rng = np.random.default_rng(11)
    x, y = rng.uniform(0, 20, 12000), rng.uniform(0, 16, 12000)
    z = 0.05 * x + 0.02 * y
    hole = (np.hypot(x - 8, y - 8) < 1.0)
    z = np.where(np.hypot(x - 15, y - 5) < 0.2, z + 4, z)
    x, y, z = x[~hole], y[~hole], z[~hole]
    cloud = frame(spark, ["pid", "x", "y", "z"], {"pid": np.arange(len(x)), "x": x, "y": y, "z": z})
    cfg = SurveyConfig(tile_cells=32, tile_margin=24)
    ground = terrain.ground_points(cloud, cfg)
    assert ground.count() > 0.95 * len(x)
    model = terrain.build_terrain(cloud, cloud, cfg)
    high = terrain.with_heights(cloud, model, cfg).where("h is not null")
    off = high.where(F.hypot(F.col("x") - 15, F.col("y") - 5) > 0.8).agg(F.max(F.abs("h"))).first()[0]
    assert off < 0.15
    assert high.where(F.hypot(F.col("x") - 15, F.col("y") - 5) < 0.15).agg(F.avg("h")).first()[0] > 3


def test_quality_rules(spark):
    base = {"dbh_source": "axis_fit", "height_m": 10.0, "dbh_arc": 0.7, "dbh_rmse_cm": 1.0, "n_stem_layers": 8, "dbh_vs_stack": 1.0}
    rows = [base, base | {"dbh_arc": 0.5}, base | {"height_m": None}, base | {"dbh_source": "stack_interp"}, base | {"n_stem_layers": 5}, base | {"dbh_arc": None}]
    df = spark.createDataFrame(rows, "dbh_source string, height_m double, dbh_arc double, dbh_rmse_cm double, n_stem_layers int, dbh_vs_stack double")
    assert [r.q for r in df.select(trees.quality().alias("q")).collect()] == ["good", "fair", "poor", "poor", "fair", "poor"]


def test_features_are_51(spark):
    from arborlake.plans.queries import QUERIES

    assert len(QUERIES["tree_feature_table"](spark, SF).columns) == 52
    assert descriptors.BINS == 10


def test_matching_prefers_the_whole(spark):
    found = frame(spark, ["id", "x", "y"], {"id": [1, 2], "x": [0.0, 1.0], "y": [0.0, 0.0]})
    ref = frame(spark, ["id", "x", "y"], {"id": [7, 8], "x": [0.9, 2.4], "y": [0.0, 0.0]})
    got = {(r.pred_id, r.ref_id) for r in validate.match_trees(found, ref, 1.5).collect()}
    assert got == {(1, 7), (2, 8)}


def test_agreement_with_a_survey(spark, tmp_path):
    found = spark.createDataFrame([(4, 0.0, 0.0, 20.0, "good"), (5, 5.0, 0.0, 30.0, "good"), (6, 9.0, 0.0, 12.0, "poor")], "tree_id int, x double, y double, dbh_cm double, quality string")
    (tmp_path / "s.csv").write_text("E,N,d\n0.5,0,21\n5,1,28\n30,0,9\n")
    survey = tables.tree_list(spark, str(tmp_path / "s.csv"), evaluate.column_names('{"E": "x", "N": "y", "d": "dbh_cm", "": "z"}'))
    result = evaluate.agreement(found, survey, 2.0, ["good"])
    stats, errors = result.detection.first(), result.errors.first()
    assert (stats.tp, stats.fp, stats.fn) == (2, 0, 1) and (errors.field, errors.n, errors.bias) == ("dbh_cm", 2, 0.5)
    evaluate.write_agreement(result, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "matched_trees.csv"), header=True, inferSchema=True)
    assert {(r.tree_id_pred, r.dbh_cm_ref) for r in back.collect()} == {(4, 21), (5, 28)}


def test_sample_sizes_are_held_in_bounds():
    assert [views.sample_size(n) for n in (-3, 5_000, 60_000, 10**9)] == [5_000, 5_000, 60_000, 500_000]


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    rows = [(0, 1.234, -5.5, 100.001, 3, 1.5), (1, 2.0, 3.0, 4.0, 4294967295, None), (2, -7.25, 0.001, 0.0, 0, 0.25)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, tree_id long, height_norm float").coalesce(1)
    path = str(tmp_path / "cloud")
    df.drop("pid").write.format("las").mode("overwrite").option("path", path).save()
    back = spark.read.format("las").option("path", path).load().orderBy("pid").collect()
    assert [(round(r.x, 3), round(r.y, 3), round(r.z, 3)) for r in back] == [r[1:4] for r in rows]
    head = spark.read.format("las_header").option("path", path).load().first()
    assert (head.version, head.point_format, head.point_count, head.extra_dims) == ("1.4", 6, 3, ["tree_id", "height_norm"])


def test_las_by_uri_in_many_tasks(spark, tmp_path):
    """Written by several tasks to a URI with scales of its own, read in ranges that cut batches, and headers that count."""
    las.register(spark)
    n = 20_000
    df = spark.range(n).selectExpr("(id % 977) / 100D as x", "-(id % 31) / 8D as y", "id / 1000D as z", "id as tree_id", "cast(if(id % 5 = 0, null, id / 7) as float) as height_norm")
    uri = f"file://{tmp_path}/cloud"
    for _ in range(2):
        df.repartition(3).write.format("las").mode("overwrite").option("path", uri).option("scale", "0.01,0.125,0.001").save()
    heads = spark.read.format("las_header").option("path", uri).load().collect()
    assert len(heads) == 3 and sum(h.point_count for h in heads) == n and heads[0].scales == [0.01, 0.125, 0.001]
    assert min(h.mins[2] for h in heads) == 0 and abs(max(h.maxs[2] for h in heads) - (n - 1) / 1000) < 1e-9
    back = spark.read.format("las").option("path", uri).option("points", "777").load()
    assert back.count() == back.select("pid").distinct().count() == n
    spots = lambda d: sorted((round(r.x, 2), round(r.y, 3), round(r.z, 3)) for r in d.select("x", "y", "z").collect())
    assert spots(back) == spots(df)


def test_las_refuses_what_it_cannot_hold(spark, tmp_path):
    las.register(spark)
    for bad in ("-1L", "null", "4294967296L"):
        df = spark.range(3).selectExpr("0D as x", "0D as y", "0D as z", f"cast({bad} as bigint) as tree_id")
        with pytest.raises(Exception, match="extra dimension holds whole numbers"):
            df.write.format("las").mode("append").option("path", f"{tmp_path}/bad").save()
    wide = spark.range(2).selectExpr("id * 1e9 as x", "0D as y", "0D as z").coalesce(1)
    with pytest.raises(Exception, match="more than 32 bits"):
        wide.write.format("las").mode("append").option("path", f"{tmp_path}/bad").save()
    assert not [f for f in (tmp_path / "bad").iterdir() if f.suffix == ".las"]


def test_laz_is_refused(spark, tmp_path):
    raw = bytearray(375)
    raw[:4], raw[24:26], raw[104] = b"LASF", bytes((1, 2)), 0x83
    (tmp_path / "a.laz").write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="compressed"):
        las.read_header(str(tmp_path / "a.laz"))


def test_tree_lists_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text("E,N,dbh_cm\n1.5,2,30\n")
    assert tables.tree_list(spark, str(tmp_path / "t.csv"), {"E": "x", "N": "y"}).first().x == 1.5
    with pytest.raises(ValueError, match="no x"):
        tables.tree_list(spark, str(tmp_path / "t.csv"), {"N": "y"})
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "a int, b double")
    assert [r.json for r in tables.json_rows(df).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":null}', '{"a":3,"b":0.5}']


def test_settings():
    cfg = from_values({"stem_min_layers": "5.0", "dtm_res": "0.5", "unknown": 1, "seg_voxel": None})
    assert (cfg.stem_min_layers, cfg.dtm_res, cfg.seg_voxel) == (5, 0.5, 0.15)
    assert cfg.terrain_key("a") != SurveyConfig().terrain_key("a") == SurveyConfig(stem_min_layers=9).terrain_key("a")


def test_fixed_sample(spark):
    cloud = fixtures.cloud(spark, SF).select("pid", "x")
    a, b = (sorted(r.pid for r in views.fixed_sample(cloud.repartition(n), 300).collect()) for n in (2, 5))
    assert a == b and len(a) == 300


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    cloud = fixtures.cloud(spark, SF).select("x", "y", "z")
    cloud.write.parquet(src)
    stream = streaming_voxel_counts(spark.readStream.schema(cloud.schema).parquet(src), 1.0)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("voxels").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("voxels").agg(F.sum("n")).first()[0] == cloud.count()


@pytest.mark.parametrize("cache", [True])
def test_whole_inventory(spark, tmp_path, cache):
    rng = np.random.default_rng(21)
    parts = [trunk(2, 2, 0.12, 1500, seed=5), trunk(7, 3, 0.09, 1500, seed=6), trunk(4, 7, 0.15, 1500, seed=7)]
    gx, gy = rng.uniform(-1, 10, (2, 6000))
    parts.append(np.column_stack((gx, gy, rng.normal(0, 0.005, 6000))))
    for cx, cy in ((2, 2), (7, 3), (4, 7)):
        b = rng.normal(size=(700, 3))
        b /= np.linalg.norm(b, axis=1)[:, None]
        parts.append(np.column_stack((cx + 1.2 * b[:, 0], cy + 1.2 * b[:, 1], 6.2 + 0.9 * b[:, 2])))
    xyz = np.vstack(parts)
    cloud = frame(spark, ["pid", "x", "y", "z"], {"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    cfg = SurveyConfig(stem_dbscan_min_pts=8, stem_dbscan_eps=0.10, tile_cells=64)
    found = inventory.run(spark, cloud, cfg, cache=str(tmp_path / "cache"), identity="scene", groups=2)
    got = sorted((round(r.x), r.dbh_cm, r.height_m, r.quality) for r in found.trees.collect())
    assert [g[0] for g in got] == [2, 4, 7]
    for (_, dbh, height, quality), want in zip(got, (24, 30, 18)):
        assert abs(dbh - want) < 1.5 and 5.5 < height < 7.5 and quality in ("good", "fair")
    assert found.summary.first().n_trees == 3
    inventory.write_outputs(found, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "trees.csv"), header=True).count() == 3
