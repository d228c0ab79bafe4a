"""An extension: ledger files that arrive over time, counted as they come.

Every trigger takes what is new and stops (``availableNow``); the checkpoint remembers what
was taken, so a run that was cut short goes on where it stopped and counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schema import LEDGER


def ledger_stream(spark: SparkSession, folder: str, schema: StructType = LEDGER) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def append_new(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Adds what is new to a Parquet folder and returns."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()
