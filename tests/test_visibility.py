"""Closed forms, properties, error contracts and A/B checks of the rewrites."""

import math
from types import SimpleNamespace as NS

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospecta.functions import geometry as g
from prospecta.operators import camera, graphs, space3d, visibility2d, walk
from prospecta.plans import workflow
from prospecta.sources import readers, writers

SQUARE = [[[-2, -2], [2, -2]], [[2, -2], [2, 2]], [[2, 2], [-2, 2]], [[-2, 2], [-2, -2]]]
FAR_WALL = [[[-50, 1], [50, 1]]]


def one(df, column="area"):
    return df.first()[column]


def run(spark, method, segments, n=360, radius=30.0, origin=(0.03125, 0.0625)):
    return one(workflow.single_point(radius, n, origin, np.array(segments, float).reshape(-1, 2, 2), method=method, spark=spark))


def test_open_field(spark):
    n, d = 360, 30.0
    assert run(spark, "segments_angle", []) == pytest.approx(0.5 * n * d * d * math.sin(2 * math.pi / n))
    assert run(spark, "discretized", []) == pytest.approx(0.5 * (n - 1) * d * d * math.sin(2 * math.pi / (n - 1)), rel=1e-5)
    assert run(spark, "corner", []) == pytest.approx(math.pi * d * d)


def test_square_room_tends_to_its_area(spark):
    assert run(spark, "segments_angle", SQUARE, n=3600) == pytest.approx(16, rel=1e-3)
    # The walls' points must outnumber the bins, so the room is larger here.
    assert run(spark, "discretized", 5 * np.array(SQUARE), n=720) == pytest.approx(400, rel=0.05)


def test_wall_with_both_ends_beyond_the_radius_is_ignored(spark):
    for method in visibility2d.KERNELS:
        assert run(spark, method, FAR_WALL) == pytest.approx(run(spark, method, []))


def test_collinear_wall_does_not_block_its_ray(spark):
    hits = workflow.visibility_polygon(30.0, 8, (0.0, 0.0), np.array([[[1.0, 0.0], [2.0, 0.0]]]), spark=spark)[1]
    assert hits.where("ray_id = 0").first()["r"] == 30.0


def test_ray_rewrite_equals_all_rays(spark):
    rng = np.random.default_rng(3)
    segments = rng.uniform(-20, 20, (60, 2, 2))
    for origin in ([0.0, 0.0], segments[5].mean(0), segments[7][0]):
        got = {r.ray_id: r.r for r in workflow.visibility_polygon(25.0, 90, origin, segments, spark=spark)[1].collect()}
        for k in range(90):
            d, best = np.array([math.cos(k * 2 * math.pi / 90), math.sin(k * 2 * math.pi / 90)]), 25.0
            for a, b in segments:
                if min(np.hypot(*(a - origin)), np.hypot(*(b - origin))) > 25.0:
                    continue
                e, r = b - a, a - origin
                det = d[0] * -e[1] - d[1] * -e[0]
                if det:
                    t, u = (r[0] * -e[1] - r[1] * -e[0]) / det, (d[0] * r[1] - d[1] * r[0]) / det
                    if 0 < t < best and 0 <= u <= 1:
                        best = t
            assert got[k] == pytest.approx(best, abs=1e-9), k


def test_areas_shrink_with_walls_and_move_with_the_scene(spark):
    rng = np.random.default_rng(5)
    walls = rng.uniform(-10, 10, (20, 2, 2))
    assert run(spark, "segments_angle", walls) <= run(spark, "segments_angle", walls[:10]) + 1e-9
    moved = run(spark, "segments_angle", walls + [64.0, -32.0], origin=(64.03125, -31.9375))
    assert moved == pytest.approx(run(spark, "segments_angle", walls))
    for method in ("segments_angle", "corner"):
        assert run(spark, method, walls[:, ::-1]) == pytest.approx(run(spark, method, walls))


def test_origin_on_a_wall_end_has_no_corner_area(spark):
    assert run(spark, "corner", SQUARE, origin=(2.0, 2.0)) is None


def test_boundary_and_stats(spark):
    origins, areas = workflow.boundary(30.0, 36, SQUARE, samples_per_segment=2, return_stats=True, spark=spark)
    assert origins.count() == 8
    for r in areas.collect():
        assert r.min_distance <= r.mean_distance <= r.max_distance <= 30.0 + 1e-9


def test_errors(spark):
    bad = [
        dict(dist_max=0), dict(N=0), dict(origin=[1, 2, 3]), dict(segments=np.zeros((2, 2))), dict(FOV=7.0), dict(view_dir=[0, 0]), dict(method="none"),
    ]
    for change in bad:
        given = {"dist_max": 10, "N": 12, "origin": [0, 0], "segments": SQUARE} | change
        with pytest.raises(ValueError):
            workflow.single_point(given.pop("dist_max"), given.pop("N"), given.pop("origin"), given.pop("segments"), spark=spark, **given)
    with pytest.raises(NotImplementedError):
        workflow.single_point(10, 12, [0, 0], SQUARE, FOV=1.0, spark=spark)
    with pytest.raises(ValueError):
        visibility2d.boundary_samples(workflow.as_segments(spark, SQUARE), step=0)
    with pytest.raises(ValueError):
        visibility2d.boundary_samples(workflow.as_segments(spark, SQUARE), samples_per_segment=0)
    with pytest.raises(NotImplementedError):
        workflow.volume_point(0, 5, 10, [0, 0, 0], spark.createDataFrame([], readers.CLOUD_SCHEMA), method="meshes")
    with pytest.raises(ValueError):
        workflow.volume_point(0, 5, 10, [0, 0], spark.createDataFrame([], readers.CLOUD_SCHEMA))


def test_workspace(spark):
    w = workflow.Workspace()
    for call in (lambda: w.row_as_dict(), lambda: w.calculate_2d(5, 12, [0, 0]), lambda: w.import_array([1.0]), lambda: w.import_array([[1, 2]], columns=["a"]), lambda: w.import_array([[1, 2]], kind="other"), lambda: w.import_array([[1, 2]], kind="segments")):
        with pytest.raises(ValueError):
            call()
    w.import_array([[1, 2], [3, 4]], columns=["a", "b"])
    assert w.row_as_dict(-1) == {"a": 3.0, "b": 4.0} and w.row_as_dict(0, columns=["x", "y"]) == {"x": 1.0, "y": 2.0}
    assert w.table(spark).columns == ["row_idx", "a", "b"]
    w.import_array(SQUARE)
    area = w.calculate_2d(30, 90, [0.0, 0.0], spark=spark)
    assert w["last_result"]["workflow"] == "single_point" and len(w.results) == 1 and area.count() == 1
    w["k"] = 1
    assert set(w) == {"array", "segments", "last_result", "k"} and len(w) == 4
    del w["k"]


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r), 0.25, 0.5, 1.0) for i, r in enumerate(rows)], readers.CLOUD_SCHEMA)


def test_full_sphere_volume(spark):
    points = cloud(spark, [(3 * r.dx, 3 * r.dy, 3 * r.dz) for r in space3d.directions(spark, 200).collect()])
    stats = space3d.volume_spherical(points, (0, 0, 0), n=200, farthest=10).first()
    assert stats.vol == pytest.approx(4 / 3 * math.pi * 27, rel=1e-4) and stats.min_dist == pytest.approx(3, rel=1e-5)


def test_banded_directions_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    points = cloud(spark, rng.normal(size=(300, 3)) * 3)
    dirs = space3d.directions(spark, 500)
    seen = space3d.points_in_range(points, (0, 0, 0), 0, 100)
    for view, fov in ((None, None), ((0.2, -1.0, 0.4), (1.2, 0.7)), ((0.0, 0.0, 1.0), (0.5, 2.0))):
        kept = dirs if view is None else space3d.in_frustum(dirs, view, fov)
        fast = space3d.nearest_direction(seen, 500, view, fov).select("point_id", "dir_id")
        assert sorted(fast.collect()) == sorted(space3d.nearest_direction_plain(seen, kept).select("point_id", "dir_id").collect())


def test_hull_and_spline():
    cube = np.array([[x, y, z] for x in (0, 2) for y in (0, 2) for z in (0, 2)], float)
    assert space3d.convex_volume(np.vstack([cube, [[1, 1, 1]]])) == pytest.approx(8)
    assert space3d.convex_volume(cube[:3]) == 0
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    assert 3.6 < space3d.convex_volume(p) < 4 / 3 * math.pi
    x = np.arange(6.0)
    assert space3d.spline(x, x**3 - x, np.array([0.5, 4.25])) == pytest.approx([0.5**3 - 0.5, 4.25**3 - 4.25])


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(size=(80, 3)), rng.normal(size=(5, 3)) + 40])
    got = {(r.src, r.rank): r.dst for r in graphs.neighbours(cloud(spark, p), 4).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2) + np.diag([np.inf] * len(p))
    for i in range(len(p)):
        assert [got[i, k + 1] for k in range(4)] == np.argsort(d[i], kind="stable")[:4].tolist()
    edges = {(r.src, r.dst) for r in graphs.knn_graph(cloud(spark, p), 3).collect()}
    assert all((b, a) in edges and a != b for a, b in edges)
    assert graphs.knn_graph(cloud(spark, p[:1]), 3).count() == 0
    assert graphs.safe_knn(cloud(spark, p[:3]), 3).count() == 3


def test_z_buffer_keeps_the_nearest_and_smallest_id(spark):
    points = cloud(spark, [(0, 0, 4), (0, 0, 2), (0, 0, 2), (0, 0, -1)])
    pose = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "cam_id int, qx double, qy double, qz double, qw double, tx double, ty double, tz double")
    seen = camera.visible_points(points, pose, {"W": 8, "H": 8, "fx": 4.0, "fy": 4.0, "cx": 4.0, "cy": 4.0}).collect()
    assert [(r.point_id, r.depth) for r in seen] == [(1, 2.0)]


def test_rotation_between_parallel_and_opposite(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (-2.0, 0.0, 0.0), (0.3, -0.4, 0.5)], "x double, y double, z double")
    m = g.rotation_between(("x", "y", "z"), (1.0, 0.0, 0.0))
    for r in rows.select("x", "y", "z", *(e.alias(f"m{k}") for k, e in enumerate(m))).collect():
        a, rot = np.array(r[:3]), np.array(r[3:]).reshape(3, 3)
        assert rot @ a / np.linalg.norm(a) == pytest.approx([1, 0, 0], abs=1e-9)
        assert rot @ rot.T == pytest.approx(np.eye(3), abs=1e-9)


def test_walks_stay_inside_and_replay(spark):
    rects = spark.createDataFrame([(0, -2.0, -2.0, 2.0, 2.0)], "rect_id int, xmin double, ymin double, xmax double, ymax double")
    a = walk.seeded_walks(spark, rects, 2, 30, samples=20).orderBy("walk_id", "step").collect()
    assert a == walk.seeded_walks(spark, rects, 2, 30, samples=20).orderBy("walk_id", "step").collect()
    assert all(abs(r.x) <= 2 and abs(r.y) <= 2 and math.isclose(r.vx**2 + r.vy**2 + r.vz**2, 1) for r in a)
    with pytest.raises(ValueError):
        walk.heading_walk((5, 5), [(-2, -2, 2, 2)], np.random.default_rng(0))
    with pytest.raises(ValueError):
        walk.sample_in_union(spark, rects.withColumn("xmax", F.col("xmin")), 5, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"start": [0, 1, 2], "end": [3, 4, 5]}, {"start": [1, 1], "end": [2, 2]}]')
    assert [tuple(r) for r in readers.segments_json(spark, str(tmp_path / "s.json")).collect()] == [(0, 0, 1, 3, 4), (1, 1, 1, 2, 2)]
    rows = {"x": [1.5, 2.0], "y": [0.0, 1.0], "z": [0.0, -1.0], "r": [0.0, 1.0], "g": [0.2, 0.4], "b": [1.0, 0.0]}

    class Table(dict):
        def __len__(self):
            return 2

    (tmp_path / "c.ply").write_bytes(writers.ply_bytes(Table(rows)))
    (tmp_path / "c.xyz").write_text("1.5 0 0 0 51 255\n2 1 -1 255 102 0\n")
    for name in ("c.ply", "c.xyz"):
        got = readers.point_cloud(spark, str(tmp_path / name)).orderBy("point_id").collect()
        assert [tuple(r)[1:] for r in got] == [pytest.approx((1.5, 0, 0, 0, 0.2, 1)), pytest.approx((2, 1, -1, 1, 0.4, 0))]
    assert readers.point_cloud(spark, str(tmp_path / "c.xyz"), downsample=2).count() == 1


def test_cad_model(spark):
    at = lambda *p: NS(X=p[0], Y=p[1], Z=p[2])

    class Line(list):
        Count = property(len)

    poly = NS(TryGetPolyline=lambda: (True, Line([at(0, 0, 0), at(1, 0, 0), at(1, 1, 5)])))
    arc = NS(PointAtStart=at(0, 0, 0), PointAtEnd=at(2, 2, 2))
    item = lambda geometry, layer: NS(Geometry=geometry, Attributes=NS(LayerIndex=layer))
    model = NS(Layers=[NS(Name="walls", FullPath="a::walls"), NS(Name="x", FullPath="walls")], Objects=[item(poly, 0), item(arc, 1), item(NS(), 0)])
    assert readers.from_rhino(spark, model).count() == 3
    assert [tuple(r) for r in readers.from_rhino(spark, model, "walls").collect()] == [(0, 0, 0, 1, 0), (1, 1, 0, 1, 1)]
    with pytest.raises(ValueError):
        readers.from_rhino(spark, model, "none")


def test_sinks(spark, tmp_path):
    writers.save_metrics(spark.createDataFrame([], ", ".join(f"{c} double" for c in writers.METRICS)), str(tmp_path / "m"))
    graph = spark.createDataFrame([(1, 2, 7)], "src long, dst long, graph_id int")
    writers.save_graph(graph, graph, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1
    writers.save_walk_bundle({"loc": graph}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/loc")).count() == 1


def test_streamed_origins(spark, tmp_path):
    from prospecta.streaming.live import stream_areas

    spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "origin_id long, ox double, oy double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("origin_id long, ox double, oy double").parquet(str(tmp_path / "in"))
    stream_areas(stream, workflow.as_segments(spark, SQUARE), 30.0, 90, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sinks_hold_the_whole_tables(spark):
    from prospecta import registry
    from prospecta.fixtures import fixture

    sf = "/root/testdata/sf0.001"
    rows = fixture(spark, sf, "fx_points3d").orderBy("point_id").collect()
    at = np.array([(r.x, r.y, r.z) for r in rows])
    n, pairs = len(rows), set()
    for i in range(n):
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        pairs |= {(i, int(j)) for j in np.lexsort((np.arange(n), d))[:3]}
    want = pairs | {(b, a) for a, b in pairs} | {(n, i) for i in range(n)} | {(i, n) for i in range(n)}
    got = [(r.src, r.dst) for r in registry.queries()["sink_graph"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    cameras = {f"DSC_0{r.cam_id}" for r in fixture(spark, sf, "fx_cameras").collect()}
    assert {r.img for r in registry.queries()["sink_metrics_csv"](spark, sf).collect()} == cameras


def test_directional_raycast_colours_the_ends(spark):
    points = cloud(spark, [(2 + 0.01 * i, 0.3 * (i % 7) - 1, 0.2 * (i % 5) - 0.4) for i in range(60)])
    rays, stats = space3d.directional_raycast(points, (0, 0, 0), (1.0, 0.0, 0.0), (1.2, 0.9), n=400, farthest=10)
    rows = rays.collect()
    at = {p.point_id: (p.x, p.y, p.z) for p in points.collect()}
    assert rows and stats.first().max_dist > 2
    for r in rows:
        near = min(at, key=lambda k: (math.dist(at[k], (r.ex, r.ey, r.ez)), k))
        assert r.point_id == near and (r.r, r.g, r.b) == pytest.approx((0.25, 0.5, 1.0))
    nothing, zeros = space3d.directional_raycast(points, (500, 0, 0), (1.0, 0.0, 0.0), (1.2, 0.9), n=400, farthest=10)
    assert nothing.count() == 0 and zeros.first().vol == 0


def test_rounds_of_neighbours_leave_small_plans(spark):
    p = [(0.001 * i, 0.0007 * (i * i % 31), 0.0005 * (i * 7 % 13)) for i in range(40)] + [(5.0 * i, 3.0 * (i % 3), 1.0 * i) for i in range(1, 12)] + [(900.0, 1.0, 2.0)]
    near = graphs.neighbours(cloud(spark, p), 3)
    got = {(r.src, r.rank): r.dst for r in near.collect()}
    for i, a in enumerate(p):
        want = sorted((math.dist(a, b), j) for j, b in enumerate(p) if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in want]
    # A plan that held its rounds would double with each of them.
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_in_range_are_dealt_out(spark):
    """One scan task of walls must not hold all that its pairs grow into."""
    origins = spark.createDataFrame([(1, 0.5, 0.5)], "origin_id long, ox double, oy double").coalesce(1)
    walls = spark.range(64).coalesce(1).select(F.col("id").alias("seg_id"), *((F.col("id") % 5 + k).cast("double").alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))
    near = visibility2d.segments_in_range(origins, walls, 30.0)
    for grown in (visibility2d.wall_points(near, 360), visibility2d.ray_hits(near, 30.0, 360)):
        assert grown.select(F.spark_partition_id()).distinct().count() > 2
    assert near.count() == 64


def test_ascii_clouds_are_read_in_splits_without_python(spark, tmp_path):
    n = 3000
    at = [(i / 8, -i / 4, 0.5 * (i % 7), i % 256, i * 3 % 256, i * 5 % 256) for i in range(n)]
    head = ["ply", "format ascii 1.0", "comment made here", f"element vertex {n}", *(f"property double {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "element face 1", "property int k", "end_header"]
    (tmp_path / "a.ply").write_text("\n".join([*head, *(" ".join(map(str, r)) for r in at), "7", ""]))
    (tmp_path / "b.xyz").write_text("# a comment\n" + "\n\n".join(", ".join(map(str, r)) for r in at))
    rows = {c: [r[k] if k < 3 else r[k] / 255 for r in at] for k, c in enumerate("xyzrgb")}

    class Table(dict):
        def __len__(self):
            return n

    (tmp_path / "c.ply").write_bytes(writers.ply_bytes(Table(rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for name in ("a.ply", "b.xyz", "c.ply"):
            cloud = readers.point_cloud(spark, str(tmp_path / name))
            got = {r.point_id: tuple(r)[1:] for r in cloud.collect()}
            assert len(got) == cloud.count() == n and all(got[i] == (*at[i][:3], *(c / 255 for c in at[i][3:])) for i in range(n))
            assert ("MapInArrow" in cloud._jdf.queryExecution().toString()) == (name == "c.ply")
        assert readers.point_cloud(spark, str(tmp_path)).groupBy("point_id").count().where("count <> 3").count() == 0
        (tmp_path / "short.ply").write_text("\n".join([*head, "1 2 3 4 5 6"]))
        with pytest.raises(ValueError):
            readers.point_cloud(spark, str(tmp_path / "short.ply"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
