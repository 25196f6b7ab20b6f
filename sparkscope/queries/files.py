"""Queries over spreadsheets and streams that Spark makes of the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sheets as X
from ..sources.shared import fresh_folder
from ..sources.state_table import StateTable
from ..streaming.stateful import kept_profiles, key_profiles
from .common import table

#: Longer than the events' whole time: no row is late, in whatever order the files come.
NEVER_LATE = 100 * 366 * 86_400_000


def sheets_read(spark, d):
    """A report of three sheets, written and read back by the source: sheets and rows, and the fullest one with dates, flags, gaps, whole and other numbers."""
    o = table(spark, d, "orders")
    months = o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), (F.count("*") % 2 == 0).alias("even"), F.when(F.count("*") % 3 == 0, F.concat(F.lit("no. "), F.count("*").cast("string"))).alias("note"),
    )
    path = f"{fresh_folder(spark, 'report')}/report.xlsx"
    X.write_sheets({"Nations": table(spark, d, "nation"), "Months": months, "Regions": table(spark, d, "region")}, path)
    raw = X.raw_rows(spark, [path])
    best = X.fullest_sheets(raw).first()
    rows = X.table_of(raw.where(F.col("sheet") == best["sheet"]))
    sizes = raw.groupBy("sheet").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("month"), "n", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("boolean").alias("even"), F.col("sheet").alias("note"))
    return rows.withColumn("month", F.date_format("month", "yyyy-MM-dd")).unionByName(sizes)


def stream_key_profiles(spark, d):
    """Events in four files, one a micro-batch: each user's profile is kept by the stream and merged into a table by key."""
    folder = fresh_folder(spark, "stream")
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("event_type"), "value")
    e.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = StateTable(spark, f"{folder}/profiles", ["key"], 8)
    kept_profiles(key_profiles(stream, "user_id", "ts", "event_type", "value", NEVER_LATE), kept, f"{folder}/checkpoint")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return kept.read().select("key", "rows", "late", "distinct_values", at("first_at"), "first_value", at("last_at"), F.round("total", 2).alias("total"))


QUERIES = {f.__name__: f for f in (sheets_read, stream_key_profiles)}

ORACLE_SQL = {
    "sheets_read": """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1)
SELECT strftime(month, '%Y-%m-%d') AS month, n, mean, n % 2 = 0 AS even, CASE WHEN n % 3 = 0 THEN 'no. ' || n END AS note FROM m UNION ALL SELECT NULL, (SELECT count(*) + 1 FROM m), NULL, NULL, 'Months' UNION ALL SELECT NULL, (SELECT count(*) + 1 FROM nation), NULL, NULL, 'Nations' UNION ALL SELECT NULL, (SELECT count(*) + 1 FROM region), NULL, NULL, 'Regions'""",
    "stream_key_profiles": """WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 6 <> 0 THEN event_type END AS t, value FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS rows, 0::BIGINT AS late, count(DISTINCT t) AS distinct_values, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, first(t ORDER BY ts, t NULLS LAST) AS first_value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, round(sum(value), 2) AS total FROM e GROUP BY user_id""",
}
