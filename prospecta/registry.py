"""Queries of the visibility engine by operator ID, with the parameters that their SQL uses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.fixtures import fixture
from prospecta.functions import geometry as g
from prospecta.operators import camera, graphs, space3d, visibility2d, walk
from prospecta.plans import jobs, oracles, workflow
from prospecta.sources import readers, writers

RAYS, CORNER_RAYS, RADIUS, DIRS, RANGE = 360, 120, 30.0, 300, 6.0
EYE, VIEW, FOV = (0.5, 0.25, 0.125), (1.0, 0.0, 0.0), (1.2, 0.9)
CAMERA = {"W": 64, "H": 48, "fx": 40.0, "fy": 40.0, "cx": 32.0, "cy": 24.0}
_FOUND: dict = {}


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The named columns as rounded doubles; all doubles and floats without names."""
    names = names or tuple(n for n, t in df.dtypes if t in ("double", "float"))
    # Adding zero makes a negative zero a plain one.
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


class Scene:
    """The fixtures and the steps that several queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf, f"fx_{name}")

    def near(self):
        return visibility2d.segments_in_range(self.origins2d, self.segments2d, RADIUS)

    def hits(self):
        return visibility2d.ray_hits(self.near(), RADIUS, RAYS)

    def radii(self):
        return visibility2d.nearest_hits(self.origins2d, self.hits(), RADIUS, RAYS)

    def wall_bins(self):
        p = visibility2d.wall_points(self.near(), RAYS).withColumn("t", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).where(F.col("t") <= RADIUS)
        return p.withColumn("ray_id", visibility2d.nearest_ray("x", "y", RAYS))

    def pieces(self):
        return visibility2d.subdivided(self.near())

    def intervals(self):
        return visibility2d.polar_intervals(self.pieces())

    def envelope(self):
        return visibility2d.envelope(self.intervals(), RADIUS, CORNER_RAYS)

    def edge(self):
        return self.segments2d.where("seg_id < 20")

    def dirs(self):
        return space3d.directions(self.spark, DIRS)

    def frustum(self):
        return space3d.in_frustum(self.dirs(), VIEW, FOV)

    def seen3d(self):
        return space3d.points_in_range(self.points3d, EYE, 0, RANGE)

    def bins(self):
        return space3d.bin_minimum(self.dirs(), space3d.nearest_direction(self.seen3d(), DIRS))

    def known(self):
        return space3d.spherical_bins(self.points3d, EYE, farthest=RANGE, n=DIRS)

    def framed(self):
        return camera.in_frame(camera.project_pinhole(self.points3d, self.cameras, CAMERA), CAMERA["W"], CAMERA["H"])

    def visible(self):
        return camera.nearest_per_pixel(self.framed(), "cam_id")

    def in_view(self):
        return camera.frustum_points(self.points3d, EYE, VIEW, FOV, 0, 40)

    def rendered(self):
        return camera.render(self.points3d, EYE, VIEW, FOV, 0, 40, 64, 48)

    def nn(self):
        return graphs.neighbours(self.knn, 3)

    def knn_edges(self):
        return graphs.knn_graph(self.knn, 3)

    def images(self):
        return self.cameras.select(F.concat(F.lit("set/DSC_0"), F.col("cam_id"), F.lit(".JPG")).alias("image_name"), *"qx qy qz qw tx ty tz".split())

    def numbers(self):
        return self.points3d


def scene(f):
    """Register f(scene) under its name."""
    _FOUND[f.__name__] = lambda spark, sf_dir: f(Scene(spark, sf_dir))
    return f


def _json_round_trip(s: Scene) -> DataFrame:
    path = writers.scratch(s.spark, "segments")
    writers.save_segments_json(s.segments2d.withColumns({"z1": F.lit(0.0), "z2": F.lit(0.0)}), path)
    return readers.segments_json(s.spark, path)


@scene
def src_json_segments(s):
    return _json_round_trip(s)


@scene
def sink_json_segments(s):
    return _json_round_trip(s)


def _ply(s: Scene) -> str:
    """A PLY file of the fixture cloud, written through Spark's text sink as ASCII."""
    path = writers.scratch(s.spark, "cloud") + ".ply"
    names = ("x", "y", "z", "red", "green", "blue")
    made = s.points3d.select("point_id", F.concat_ws(" ", "x", "y", "z", *(F.rint(F.col(c) * 255).cast("int") for c in "rgb")).alias("value"))
    rows = made.orderBy("point_id").select("value")
    n = s.points3d.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property {'double' if k < 3 else 'uchar'} {c}" for k, c in enumerate(names)), "end_header"]
    lines = s.spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).unionAll(rows.coalesce(1)).coalesce(1)
    lines.write.text(path)
    return path + "/*.txt"


def _clouds(s: Scene, **how) -> DataFrame:
    path = _ply(s)
    return readers.point_cloud(s.spark, path, **how)


@scene
def src_ply(s):
    return rounded(_clouds(s), "r", "g", "b")


@scene
def src_pcd(s):
    return _clouds(s, downsample=5).select("point_id", "x", "y", "z")


def _camera_csv(s: Scene) -> DataFrame:
    path = writers.scratch(s.spark, "cameras")
    s.images().write.csv(path, header=True)
    return readers.cameras_csv(s.spark, path)


@scene
def src_camera_csv(s):
    return _camera_csv(s)


@scene
def image_select(s):
    return readers.images_named(_camera_csv(s), "DSC_03")


@scene
def src_rhino_layer(s):
    layers = s.polyline.select(F.col("curve_id").alias("layer_index"), F.concat(F.lit("L"), F.col("curve_id") % 7).alias("name"), F.concat(F.lit("site::L"), F.col("curve_id") % 7).alias("full_path")).distinct()
    return s.spark.createDataFrame([(readers.matching_layer(layers, "L3"),)], "layer_index long")


@scene
def src_rhino_extract(s):
    kinds = s.polyline.select("curve_id", (F.col("curve_id") % 2 == 0).alias("is_polyline")).distinct()
    return readers.curve_segments(s.polyline, kinds)


@scene
def src_rhino_point(s):
    return s.polyline.select("curve_id", "vertex_idx", *(F.col(c).cast("double") for c in "xyz"))


@scene
def polyline_to_segments(s):
    return readers.polyline_segments(s.polyline)


@scene
def curve_chord(s):
    return readers.curve_chords(s.polyline)


@scene
def drop_z(s):
    return readers.plan_view(readers.polyline_segments(s.polyline))


@scene
def src_array(s):
    rows = s.segments2d.where("seg_id < 50").orderBy("seg_id").collect()
    space = workflow.Workspace()
    space.import_array([[[r.x1, r.y1], [r.x2, r.y2]] for r in rows])
    first = rows[0].seg_id if rows else 0
    return space.table(s.spark).withColumn("seg_id", F.col("seg_id") + first)


@scene
def seg_radius_filter(s):
    return s.near().select("origin_id", "seg_id")


@scene
def seg_translate(s):
    return rounded(s.near().select("origin_id", "seg_id", "x1", "y1", "x2", "y2", "d1", "d2"), "d1", "d2")


@scene
def pt_range_filter(s):
    return s.seen3d().select("point_id")


@scene
def pt_dist_filter_2d(s):
    return rounded(s.wall_bins().groupBy("origin_id").agg(F.count("*").alias("n"), F.sum("t").alias("total")))


@scene
def frustum_dirs(s):
    return s.frustum().select("dir_id")


@scene
def frustum_points(s):
    return rounded(s.in_view().select("point_id", "cx", "cy", "depth"))


@scene
def in_front(s):
    return camera.project_pinhole(s.points3d, s.cameras, CAMERA).select("cam_id", "point_id")


@scene
def in_frame(s):
    return s.framed().select("cam_id", "point_id", "px", "py", "pix")


@scene
def in_union_rects(s):
    return walk.in_union(s.origins2d, s.rects).select("origin_id")


@scene
def rect_area(s):
    return s.rects.select("rect_id", walk.rect_area().alias("area"))


@scene
def valid_rays(s):
    return rounded(s.bins().select("dir_id", space3d.valid_ray(F.col("dist"), RANGE).alias("dist")).where("dist > 0"))


@scene
def gen_rays_ccw(s):
    a = F.col("ray_id") * (2 * math.pi / RAYS)
    return rounded(s.spark.range(RAYS).select(F.col("id").cast("int").alias("ray_id")).select("ray_id", F.cos(a).alias("dx"), F.sin(a).alias("dy")))


@scene
def gen_rays_cw(s):
    a = F.col("ray_id") * (2 * math.pi / (RAYS - 1))
    return rounded(s.spark.range(RAYS).select(F.col("id").cast("int").alias("ray_id")).select("ray_id", F.sin(a).cast("float").alias("dx"), F.cos(a).cast("float").alias("dy")))


@scene
def gen_fibonacci_sphere(s):
    return rounded(s.dirs())


@scene
def gen_theta_grid(s):
    return rounded(s.envelope().select("origin_id", "k", "theta"))


@scene
def subdivide_long_segments(s):
    return rounded(s.pieces())


@scene
def segment_to_points(s):
    return rounded(visibility2d.wall_points(s.near(), RAYS))


@scene
def sample_boundary(s):
    return rounded(visibility2d.boundary_samples(s.edge(), step=2.5))


@scene
def sample_boundary_ends(s):
    return rounded(visibility2d.boundary_samples(s.edge(), samples_per_segment=3, include_endpoints=True))


@scene
def wrap_split(s):
    return rounded(s.intervals())


@scene
def background_interval(s):
    ends = s.intervals().groupBy("origin_id").agg(F.min(F.least("a0", "a1")).alias("a0"), F.max(F.greatest("a0", "a1")).alias("a1"))
    return rounded(ends.withColumns({"d0": F.lit(RADIUS), "d1": F.lit(RADIUS)}))


@scene
def uniform_down_sample(s):
    return readers.down_sampled(s.points3d, 7).select("point_id")


@scene
def gen_pixel_grid(s):
    return camera.pixel_grid(s.spark, 64, 48)


@scene
def ray_segment_join(s):
    return rounded(s.hits())


@scene
def grid_interval_join(s):
    return rounded(s.envelope().select("origin_id", "k", "r"))


@scene
def nearest_ray_2d(s):
    return s.wall_bins().groupBy("origin_id", "ray_id").agg(F.count("*").alias("n"))


@scene
def nearest_dir_3d(s):
    return space3d.nearest_direction(s.seen3d(), DIRS).select("point_id", "dir_id")


@scene
def nearest_dir_frustum(s):
    return space3d.nearest_direction(s.seen3d(), DIRS, VIEW, FOV).select("point_id", "dir_id")


@scene
def nearest_color(s):
    return space3d.nearest_color(space3d.visible_ends(s.known(), RANGE), s.seen3d()).select("dir_id", "point_id", "r", "g", "b")


@scene
def knn_graph(s):
    return s.knn_edges()


@scene
def safe_knn(s):
    return rounded(graphs.safe_knn(s.knn, 3))


@scene
def edge_endpoint_join(s):
    return graphs.with_ends(s.knn_edges(), s.knn).select("src", "dst", *((F.col(f"{a}2") - F.col(f"{a}1")).alias(f"d{a}") for a in "xyz"))


def _coloured(s: Scene) -> DataFrame:
    return s.knn.withColumns({c: F.lit(0.5) for c in "rgb"})


@scene
def origin_star_edges(s):
    return graphs.graph_origin_last(_coloured(s), s.knn_edges())[1].where("kind = 'origin'").select("src", "dst")


@scene
def gather_visible(s):
    return s.visible().join(s.points3d, "point_id").select("cam_id", "point_id", "x", "y", "z", "r", "g", "b")


@scene
def batch_origins(s):
    return rounded(visibility2d.segments_angle(s.origins2d, s.segments2d, RADIUS, RAYS)[0])


@scene
def min_hit(s):
    return rounded(s.radii())


@scene
def min_envelope(s):
    return rounded(s.envelope())


@scene
def bin_min_2d(s):
    return rounded(visibility2d.discretized(s.origins2d, s.segments2d, RADIUS, RAYS)[1].select("origin_id", "ray_id", "r"))


@scene
def bin_min_3d(s):
    return rounded(s.bins().select("dir_id", "dist"))


@scene
def unknown_policy(s):
    b = s.bins()
    zero, far = space3d.unknown(b, RANGE, False), space3d.unknown(b, RANGE, True)
    return rounded(zero.select("dir_id", F.col("dist").alias("zero")).join(far.select("dir_id", F.col("dist").alias("far")), "dir_id"))


@scene
def polygon_area(s):
    points = visibility2d.hit_points(s.radii(), s.origins2d, F.col("ray_id") * (2 * math.pi / RAYS))
    return rounded(visibility2d.polygon_areas(points))


@scene
def mean_square_area(s):
    return rounded(visibility2d.corner(s.origins2d, s.segments2d, RADIUS, CORNER_RAYS)[0])


@scene
def distance_stats(s):
    return rounded(visibility2d.distance_stats(visibility2d.segments_angle(s.origins2d, s.segments2d, RADIUS, RAYS)[1]))


@scene
def sphere_volume(s):
    return rounded(space3d.volume_stats(s.known(), 4 * math.pi, RANGE).select("vol"))


@scene
def ray_stats_3d(s):
    return rounded(space3d.volume_stats(s.known(), 4 * math.pi, RANGE).drop("vol"))


@scene
def hull_volume(s):
    return rounded(space3d.hull_volume(space3d.visible_ends(s.known(), RANGE)))


@scene
def zbuffer_image(s):
    return s.visible().select("cam_id", "pix", "point_id")


@scene
def zbuffer_render(s):
    return rounded(s.rendered().select("pix", "point_id", "depth"))


@scene
def raster_scatter(s):
    dense = camera.dense_raster(s.rendered(), 64, 48)
    return rounded(dense.select("pix", "r8", "g8", "b8", F.when(F.col("depth") == float("inf"), -1.0).otherwise(F.col("depth")).alias("depth")))


@scene
def area_normalise(s):
    return rounded(walk.area_shares(s.rects).select("rect_id", "share"))


@scene
def sample_area_mixture(s):
    return walk.sample_in_union(s.spark, s.rects, 1000, 7)


@scene
def distinct_points(s):
    return visibility2d.boundary_samples(s.edge(), step=2.5).agg(F.count("*").alias("n"))


@scene
def distinct_edges(s):
    return s.knn_edges().select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


@scene
def outlier_removal(s):
    return graphs.without_outliers(s.knn, 3, 1.0).select("point_id")


@scene
def win_first_per_group(s):
    w = Window.partitionBy("cam_id", "pix").orderBy("depth", "point_id")
    return s.framed().withColumn("k", F.row_number().over(w)).where("k = 1").select("cam_id", "pix", "point_id")


@scene
def win_lead_pairs(s):
    w = Window.partitionBy("curve_id").orderBy("vertex_idx")
    return s.polyline.select("curve_id", "vertex_idx", F.lead("x").over(w).alias("next_x")).where("next_x is not null")


@scene
def win_ring_lead(s):
    w = Window.partitionBy("origin_id").orderBy("ray_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(s.radii().select("origin_id", "ray_id", F.coalesce(F.lead("r").over(w), F.first("r").over(whole)).alias("next_r")))


@scene
def win_interp_linear(s):
    return rounded(space3d.interpolated_linear(s.known()))


@scene
def win_interp_knn(s):
    return rounded(space3d.interpolated_knn(s.known(), 3))


@scene
def win_interp_cubic(s):
    return rounded(space3d.interpolated_cubic(s.known()))


@scene
def win_rank_knn(s):
    return rounded(s.nn().select("src", "dst", "rank", "dist"))


@scene
def sort_by_angle(s):
    p = s.pieces().select("origin_id", "seg_id", "piece", F.atan2("py1", "px1").alias("b0"), F.atan2("py2", "px2").alias("b1"))
    p = p.withColumn("a0", F.when(g.swapped("b0", "b1"), F.col("b1")).otherwise(F.col("b0")))
    w = Window.partitionBy("origin_id").orderBy(F.round(g.floored_angle("a0"), 6), "seg_id", "piece")
    return p.select("origin_id", "seg_id", "piece", F.row_number().over(w).alias("pos"))


@scene
def lexsort_pixel_depth(s):
    w = Window.partitionBy("cam_id").orderBy("pix", "depth", "point_id")
    return s.framed().select("cam_id", "point_id", F.row_number().over(w).alias("pos"))


@scene
def argsort_visible(s):
    order = visibility2d.numbered(s.rendered().select("point_id"), ["point_id"], "pos")
    return order.select("point_id", (F.col("pos") + 1).cast("int").alias("pos"))


@scene
def topk_nn(s):
    return graphs.neighbours(s.knn, 1).select("src", "dst")


@scene
def sort_unique_rows(s):
    return rounded(visibility2d.boundary_samples(s.edge(), step=2.5))


@scene
def union_short_long(s):
    return s.pieces().groupBy("origin_id").agg(F.count("*").alias("n"))


@scene
def union_wrap(s):
    return s.intervals().groupBy("origin_id", "part").agg(F.count("*").alias("n"))


@scene
def union_edges(s):
    return s.knn_edges()


@scene
def union_graph(s):
    return graphs.graph_origin_last(_coloured(s), s.knn_edges())[1].select("src", "dst", "kind")


def _value(name: str, make, digits: int = 6) -> None:
    _FOUND[name] = lambda spark, sf_dir: rounded(Scene(spark, sf_dir).numbers().select("point_id", make().alias("v")), digits=digits)


_value("fn_hypot", lambda: F.hypot("x", "y"))
_value("fn_norm", lambda: g.norm3("x", "y", "z"))
_value("fn_atan2", lambda: F.atan2("y", "x"))
_value("fn_mod_angle", lambda: g.floored_angle("x"))
_value("fn_polar_lerp", lambda: g.polar_lerp("z", "x", "r", "y", "g"), 4)
_value("fn_clip_nonneg", lambda: F.greatest(F.col("x"), F.lit(0.0)))
_value("fn_color_u8", lambda: g.color_byte("r"))
_FOUND["fn_round12"] = lambda spark, sf_dir: rounded(Scene(spark, sf_dir).numbers().select("point_id", F.bround(F.col("x") / 3, 12).alias("v")), digits=11)


@scene
def fn_ccw_orient(s):
    p = s.pieces().select("origin_id", "seg_id", "piece", F.atan2("py1", "px1").alias("b0"), F.atan2("py2", "px2").alias("b1"), F.hypot("px1", "py1").alias("e0"), F.hypot("px2", "py2").alias("e1"))
    way = lambda a, b: F.when(g.swapped("b0", "b1"), F.col(b)).otherwise(F.col(a))
    return rounded(p.select("origin_id", "seg_id", "piece", way("b0", "b1").alias("a0"), way("b1", "b0").alias("a1"), way("e0", "e1").alias("d0"), way("e1", "e0").alias("d1")))


@scene
def fn_wrap_test(s):
    return s.intervals().groupBy("origin_id", "seg_id", "piece").agg((F.count("*") == 2).alias("wraps"))


@scene
def fn_polar_to_xy(s):
    x, y = g.polar_to_xy("x", "y", "r", "z")
    return rounded(s.numbers().select("point_id", x.alias("px"), y.alias("py")))


@scene
def fn_linspace(s):
    i = s.spark.range(11).select(F.col("id").cast("int").alias("i"))
    a, b = F.lit(-1.25), F.lit(2.5)
    return rounded(i.select("i", g.linspace("i", a, b, 11).alias("closed"), g.linspace("i", a, b, 11, closed=False).alias("half_open")))


@scene
def fn_cartesian_to_spherical(s):
    r, a, e = g.spherical("x", "y", "z")
    return rounded(s.numbers().select("point_id", *(c.cast("float").alias(n) for c, n in ((r, "radius"), (a, "azimuth"), (e, "elevation")))))


@scene
def fn_quat_to_matrix(s):
    return rounded(camera.poses(s.cameras).select("cam_id", *(f"m{k}" for k in range(9))))


@scene
def fn_camera_center(s):
    return rounded(camera.poses(s.cameras).select("cam_id", "cx", "cy", "cz"))


@scene
def fn_view_dir_world(s):
    return rounded(camera.poses(s.cameras).select("cam_id", "vx", "vy", "vz"))


@scene
def fn_fov(s):
    return rounded(s.spark.range(1).select(F.lit(g.field_of_view(6208, 3408.59)).alias("fov_x"), F.lit(g.field_of_view(4135, 3408.87)).alias("fov_y")))


@scene
def fn_project_pinhole(s):
    return camera.project_pinhole(s.points3d, s.cameras, CAMERA).select("cam_id", "point_id", "px", "py")


@scene
def fn_project_raster(s):
    return camera.rasterised(s.in_view(), FOV, 64, 48).select("point_id", "ui", "vi", "pix")


@scene
def fn_camera_basis(s):
    right, _, _ = g.basis_columns(("vx", "vy", "vz"))
    return rounded(camera.poses(s.cameras).select("cam_id", *(c.alias(n) for c, n in zip(right, ("rx", "ry", "rz"), strict=True))))


@scene
def fn_rotation_a_to_b(s):
    turned = g.apply(g.rotation_between(("vx", "vy", "vz"), (1.0, 0.0, 0.0)), ("vx", "vy", "vz"))
    out = camera.poses(s.cameras).select("cam_id", *(c.alias(n) for c, n in zip(turned, ("along", "off_y", "off_z"), strict=True)))
    return rounded(out).withColumns({c: F.abs(c) for c in ("off_y", "off_z")})


@scene
def fn_align(s):
    met = s.points3d.crossJoin(camera.poses(s.cameras))
    near = camera.aligned(met, ("cx", "cy", "cz"), ("vx", "vy", "vz"))
    return rounded(near.select("cam_id", "point_id", (g.norm3("ax", "ay", "az") / 7).alias("dist"), (F.col("ax") / 7 + 1.3e-7).alias("ahead")))


@scene
def fn_fibonacci(s):
    return rounded(s.dirs().select("dir_id", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).alias("unit")), digits=5)


@scene
def fn_height_clip(s):
    return rounded(s.bins().select("dir_id", g.height_clip("dist", "dz", -2 - EYE[2], 2 - EYE[2]).alias("dist")), digits=4)


@scene
def isovist_segments_angle(s):
    return rounded(visibility2d.segments_angle(s.origins2d, s.segments2d, RADIUS, RAYS)[0])


@scene
def isovist_corner(s):
    return rounded(visibility2d.corner(s.origins2d, s.segments2d, RADIUS, CORNER_RAYS)[0])


@scene
def isovist_discretized(s):
    return rounded(visibility2d.discretized(s.origins2d, s.segments2d, RADIUS, RAYS)[0])


def _third(s: Scene):
    r = s.origins2d.where("origin_id = 3").first()
    return (r.ox, r.oy)


@scene
def single_point(s):
    return rounded(workflow.single_point(RADIUS, RAYS, _third(s), s.segments2d, return_stats=True, spark=s.spark))


@scene
def visibility_polygon(s):
    return rounded(workflow.visibility_polygon(RADIUS, RAYS, _third(s), s.segments2d, spark=s.spark)[1].select("origin_id", "ray_id", "hx", "hy"))


@scene
def area_array(s):
    return rounded(workflow.area_array(RADIUS, RAYS, s.origins2d, s.segments2d, return_stats=True, two_step=True, spark=s.spark).select("origin_id", "area", "mean_distance"))


@scene
def boundary_isovist(s):
    return rounded(workflow.boundary(RADIUS, RAYS, s.edge(), step=2.5, spark=s.spark)[1], digits=5)


@scene
def data2d_calculate_2d(s):
    return rounded(workflow.Workspace().calculate_2d(RADIUS, RAYS, _third(s), s.segments2d, spark=s.spark))


@scene
def data2d_calculate_array(s):
    return rounded(workflow.Workspace().calculate_array(RADIUS, CORNER_RAYS, s.origins2d, s.segments2d, method="corner", spark=s.spark))


@scene
def volume_spherical(s):
    return rounded(space3d.volume_spherical(s.points3d, EYE, farthest=RANGE, n=DIRS))


@scene
def volume_frustum(s):
    return rounded(space3d.volume_spherical(s.points3d, EYE, farthest=RANGE, n=DIRS, view_dir=VIEW, fov=FOV).select("vol", "mean_dist"))


@scene
def directional_raycast(s):
    return rounded(space3d.directional_raycast(s.points3d, EYE, VIEW, FOV, farthest=RANGE, n=DIRS)[0], "ex", "ey", "ez")


@scene
def volume_single_point(s):
    return rounded(workflow.volume_point(0, RANGE, DIRS, EYE, s.points3d, FOV, VIEW))


@scene
def volume_cvxhull(s):
    return rounded(workflow.volume_point(0, RANGE, DIRS, EYE, s.points3d, FOV, VIEW, method="cvxhull"))


@scene
def visible_points_in_image(s):
    return camera.visible_points(s.points3d, s.cameras, CAMERA).select("cam_id", "point_id", "x", "y", "z")


@scene
def raycast_img_with_points(s):
    return rounded(s.rendered().select("pix", "ui", "vi", "r8", "g8", "b8", "depth", "point_id"), "depth")


@scene
def graph_origin_last(s):
    return rounded(graphs.graph_origin_last(_coloured(s), s.knn_edges())[1].select("src", "dst", "kind", "radius"), digits=5)


@scene
def graph_origin_first(s):
    return graphs.graph_origin_first(_coloured(s), graphs.safe_knn(s.knn, 3))[1].select("src", "dst", "kind")


@scene
def heading_walk(s):
    return rounded(walk.walk_from_noise(s.noise, s.rects, (0.5, 0.5), 0.25))


@scene
def walk_driver(s):
    return rounded(walk.seeded_walks(s.spark, s.rects, 4))


@scene
def slice_job(s):
    metrics, _ = jobs.slice_job(s.points3d, s.cameras, CAMERA, dirs=DIRS, farthest=RANGE, heightlims=(-2.0, 2.0))
    return rounded(metrics)


@scene
def walk_job(s):
    fov = g.field_of_view(6208, 3408.59), g.field_of_view(4135, 3408.87)
    path = walk.seeded_walks(s.spark, s.rects, 2, 4)
    return rounded(jobs.walk_views(s.points3d, path, fov=fov, width=64, height=48).select("walk_id", "step", "pix", "point_id", "depth"))


@scene
def sink_metrics_csv(s):
    metrics, _ = jobs.slice_job(s.points3d, s.cameras, CAMERA, dirs=DIRS, farthest=RANGE)
    path = writers.scratch(s.spark, "metrics")
    writers.save_metrics(metrics.withColumn("img", F.concat(F.lit("DSC_0"), "cam_id")), path)
    return rounded(s.spark.read.csv(path, header=True, inferSchema=True))


@scene
def sink_graph(s):
    nodes, edges = graphs.graph_origin_last(s.points3d, graphs.knn_graph(s.points3d, 3))
    path = writers.scratch(s.spark, "graph")
    writers.save_graph(nodes.withColumn("graph_id", F.lit(1)), edges.withColumn("graph_id", F.lit(1)), path)
    return s.spark.read.parquet(f"{path}/edges")


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict:
    return {name: sql for name in _FOUND if (sql := oracles.oracle(name)) is not None}
