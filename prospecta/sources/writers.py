"""Sinks: segment JSON, metrics CSV, graphs and walk bundles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["dirs", "max_distance", "img", "vol_calc", "mean_dist", "dist_std", "min_dist", "max_dist", "posX", "posY"]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the cluster shares; on a local master a temporary one where spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="prospecta-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def save_segments_json(segments: DataFrame, path: str) -> None:
    """Write 3D segments as one JSON array of {start, end} in the order of seg_id: an interchange file, so a single one."""
    end = lambda k: F.array(*(F.col(f"{a}{k}") for a in "xyz"))
    item = F.struct(end(1).alias("start"), end(2).alias("end"))
    whole = segments.agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", item.alias("s")))), lambda x: x.s).alias("all"))
    whole.select(F.to_json("all", {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_metrics(rows: DataFrame, path: str) -> None:
    """Append metric rows as CSV with the fixed header; no rows still leave a header."""
    rows.select(*METRICS).write.mode("append").csv(path, header=True)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables, parted by graph_id."""
    nodes.write.mode("append").partitionBy("graph_id").parquet(f"{path}/nodes")
    edges.write.mode("append").partitionBy("graph_id").parquet(f"{path}/edges")


def save_walk_bundle(bundle: dict[str, DataFrame], path: str) -> None:
    """One table for each of image, nodes, edges, location and view direction, keyed by walk and step."""
    for name, rows in bundle.items():
        rows.write.mode("append").parquet(f"{path}/{name}")


def ply_bytes(points) -> bytes:
    """A little-endian PLY file of rows with x, y, z as doubles and byte colours."""
    import numpy as np

    kind = np.dtype([(c, "<f8") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
    table = np.zeros(len(points), kind)
    for c, p in (("x", "x"), ("y", "y"), ("z", "z"), ("red", "r"), ("green", "g"), ("blue", "b")):
        table[c] = points[p] if c in "xyz" else np.rint(np.asarray(points[p]) * 255)
    head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n" % len(points)
    head += "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    return (head + "end_header\n").encode() + table.tobytes()
