"""A scan whose records keep arriving: files of symbol records are merged into the store as they come.

Each batch is merged by name, as a scan's records are, so that a batch that is run again after a failure changes nothing but
the summed lines of code; the checkpoint folder says which files have been seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomgraph.sinks.store import Store


def follow(spark: SparkSession, folder: str, schema: StructType, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Merges the Parquet files of symbol records (with an ordinal) that are put into a folder; `once`: those that are
    there, and then it ends."""

    def merge(batch: DataFrame, _: int) -> None:
        store.save_symbols(batch)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
