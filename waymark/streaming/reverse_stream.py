"""Reverse geocoding of a stream of points (an extension: the batch operators, micro-batch by micro-batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.reverse import reverse_geocode
from waymark.sources.schema import GeoDataset


def reverse_stream(points: DataFrame, data: GeoDataset, to: str, checkpoint: str) -> StreamingQuery:
    """points: a stream of point_id, lat, lon. Each micro-batch is answered and written as Parquet under to/batch=<n>; a
    batch that is repeated after a failure overwrites what it wrote before, so each counts once."""

    def answer(batch: DataFrame, number: int) -> None:
        reverse_geocode(batch.dropDuplicates(["point_id"]), data).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return points.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
