"""Streaming queries, run to their end over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import sync
from .registry import query


def _log(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("tick", "play", "tick", "video", "tick", "pause", "tick", "seek")]), (i % 8 + 1).cast("int"))
    return e.select(
        F.col("user_id").cast("long").alias("session"), i.cast("long").alias("n"), (i * 0.25).alias("now"), kind.alias("kind"), (i % 100 * 0.7).alias("video"),
        F.when(i % 3 == 0, "playing").otherwise("paused").alias("state"), (i % 90 * 0.7).alias("sec"), (i % 5 < 3).alias("playing"),
    )


@query("st05_video_sync_replay")
def st05(spark, sf):
    return sync.replay(_log(spark, sf))


@query("st05_video_sync_stream")
def st05_stream(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("tick", "play", "tick", "video", "tick", "pause", "tick", "seek")]), (i % 8 + 1).cast("int"))
    log = events.select(
        F.col("user_id").cast("long").alias("session"), i.cast("long").alias("n"), (i * 0.25).alias("now"), kind.alias("kind"), (i % 100 * 0.7).alias("video"),
        F.when(i % 3 == 0, "playing").otherwise("paused").alias("state"), (i % 90 * 0.7).alias("sec"), (i % 5 < 3).alias("playing"),
    )
    out, at = sync.follow(log), shared_folder(spark)
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/actions").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/actions")


@query("st07_transport_clamps", "SELECT event_id, greatest(0, least(CAST(event_id * 37 % 9000 AS BIGINT), 7680)) AS position, CASE WHEN event_id % 3 = 0 AND event_id * 37 % 9000 >= 3840 THEN CAST(1920 AS BIGINT) ELSE greatest(0, least(CAST(event_id * 37 % 9000 AS BIGINT), 7680)) END AS looped FROM events")
def st07(spark, sf):
    """Seeks clamped to the score, and back to the loop's start from its end on."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("event_id") * 37 % 9000).cast("long").alias("to"))
    at = F.greatest(F.lit(0), F.least(F.col("to"), F.lit(7680))).cast("long")
    return e.select("event_id", at.alias("position"), F.when((F.col("event_id") % 3 == 0) & (F.col("to") >= 3840), F.lit(1920).cast("long")).otherwise(at).alias("looped"))
