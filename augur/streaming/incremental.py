"""Incremental steps as structured streams: new rows only, and rates over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_jsonl_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of line JSON files as they appear in a folder."""
    return spark.readStream.schema(schema).json(path)


def first_seen(rows: DataFrame, key: str, ts: str, within: str = "7 days") -> DataFrame:
    """Each key once; the state forgets keys that are older than ``within``."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_rates(events: DataFrame, ts: str = "ts", width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events a minute by sliding windows; events later than ``late`` are left out."""
    w = F.window(ts, width, slide)
    minutes = (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")) / 60.0
    counts = events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", (F.col("n") / minutes).alias("per_minute"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now, exactly once over restarts, and ends."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").trigger(availableNow=True).start()
