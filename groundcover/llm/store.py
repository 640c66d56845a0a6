"""Tables written to the shared folder of the session and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes to a new folder below the checkpoint folder as Parquet and reads it back.

    Cuts the lineage like a checkpoint, in compressed columns of which later steps
    read only those they need.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
