"""Incremental scoring: rasters that arrive later are labelled by a fixed model.

The streaming file source remembers which files were read, so a rerun skips
finished rasters and an interrupted run resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.material_map import Model, Options, score_tiles
from ..schema import TILE


def score_arrivals(spark: SparkSession, source: str, target: str, model: Model, opts: Options, checkpoint: str,
                   max_files: int = 1000) -> StreamingQuery:
    """Label tile files as they arrive under ``source``; one output folder per batch.

    A raster's tiles must arrive in one file, so borders see their neighbours. A
    batch that is run again overwrites its own folder, so no tile is written twice.
    """
    arrived = spark.readStream.schema(TILE).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        score_tiles(batch, model, opts).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
