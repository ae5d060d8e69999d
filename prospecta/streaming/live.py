"""Isovists over a stream of origins: each micro-batch runs the batch plan and appends its areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prospecta.operators import visibility2d


def stream_areas(origins: DataFrame, segments: DataFrame, radius: float, n: int, target: str, checkpoint: str, method: str = "segments_angle", **trigger) -> StreamingQuery:
    """Append (origin_id, area) of streamed origins below ``target``; a batch that is replayed overwrites its own part."""

    def run(batch: DataFrame, batch_id: int) -> None:
        areas, _ = visibility2d.KERNELS[method](batch, segments, radius, n)
        areas.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return origins.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
