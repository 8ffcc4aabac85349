"""The prediction log as a stream: files of predictions arrive, each (model, game) is logged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from priorframe import predlog


def append_stream(spark: SparkSession, source: str, schema: str, log_path: str, checkpoint: str, vintage: str) -> StreamingQuery:
    """Start appending what arrives in `source` (Parquet). A batch that is run again after a failure adds nothing twice."""
    arriving = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, _: int) -> None:
        predlog.append(batch.sparkSession, batch, log_path, vintage)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
