"""Incremental twins of batch operators (T1-T3) on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringdata.operators.filters import filter_junk
from ringdata.sources.tables import shared_dir


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder whose names match."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet table of the shared folder (append mode) and read it."""
    spark = df.sparkSession
    out, state = _paths(spark, name)
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_filter_junk(events: DataFrame, letter_columns: list[str], keywords: list[str]) -> DataFrame:
    """Stateless."""
    return filter_junk(events, letter_columns, keywords)


def stream_hourly_sessions(sessions: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Per subscriber and hour, sessions and MB; an hour is given out once, when the watermark passes it."""
    hour = F.window("ts", "1 hour")
    return sessions.withWatermark("ts", delay).groupBy(hour.alias("w"), "subscriber").agg(F.count(F.lit(1)).alias("sessions"), F.sum("mb").alias("mb")).select("subscriber", F.col("w.start").alias("hour"), "sessions", "mb")


def stream_subject_activity(events: DataFrame, subject: str, checkpoint: str | None = None) -> DataFrame:
    """Running count, first and last instant of every subject, over what is there now.

    The aggregate's state is the result, one row a subject: it is read from the query's
    checkpoint, so batches write no versions of it, and no row is late for it. A later
    call with the same checkpoint goes on from there.
    """
    spark = events.sparkSession
    state = checkpoint or _paths(spark, "activity")[1]
    agg = events.groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    agg.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").load(state)
    return held.select("key.*", "value.count", "value.min", "value.max").toDF("subject", "rows", "first_ts", "last_ts")  # the state names its key by the plan
