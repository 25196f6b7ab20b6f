"""Profiles that grow with a stream, and progress of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Stages of a discovery job and their weights in percent.
STAGES = [("LOADING", 10), ("PROFILING", 25), ("DETECTING", 30), ("LLM_VALIDATION", 20), ("BUSINESS_VALIDATION", 10), ("REPORTING", 5)]


def stages(spark: SparkSession) -> DataFrame:
    """(stage, weight, base): base is the percent when a stage begins."""
    df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(STAGES)], "seq int, stage string, weight long")
    return df.select("stage", "weight", (F.sum("weight").over(Window.orderBy("seq")) - F.col("weight")).alias("base"))


def progress(stage_rows: DataFrame, done: DataFrame) -> DataFrame:
    """(stage, items, total, percent) of (stage, items, total): what came before and the stage's part, 100 at most."""
    part = F.coalesce(F.try_divide(F.col("items") * F.col("weight") * 1.0, "total"), F.lit(0.0))
    return done.join(F.broadcast(stage_rows), "stage").select("stage", "items", "total", F.least(F.lit(100.0), F.round(F.col("base") + part, 4)).alias("percent"))


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams get a watermark, which needs timestamps with a zone; tables stay as they are."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_profile(events: DataFrame, ts: str, kind: str, value: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and statistics by window and kind; with a stream the watermark lets closed windows out and drops later rows."""
    out = _watermarked(events, ts, late).groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n"), F.count(value).alias("non_null"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n", "non_null", "min", "max", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key grouped where no gap is longer; with a stream the watermark lets closed sessions out and drops later rows."""
    return _watermarked(events, ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of the key within the watermark."""
    return _watermarked(events, ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
