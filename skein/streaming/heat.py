"""Streaming forms over an events folder: tumbling heat with a watermark, and deduplicated telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_heat(events: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """start, event_type, n and heat of each window, final once the watermark has passed it in append mode."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("heat"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "heat")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, late: str = "2 hours", gap: str = "4 hours") -> DataFrame:
    """user_id, start and n of each session, closed by a gap."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def purchases_after_views(events: DataFrame, late: str = "2 hours", within: str = "1 day") -> DataFrame:
    """Pairs of a user's view and purchase within a day of it: a join of two streams, whose watermarks bound what is kept."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("v_user"), F.col("event_id").alias("view_id"), F.col("ts").alias("v_ts"))
    p = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return p.join(v, F.expr(f"user_id = v_user AND ts >= v_ts AND ts <= v_ts + INTERVAL {within}")).select("event_id", "view_id")


def cell_energy(events: DataFrame, cells: int = 16, rate: float = 0.99) -> DataFrame:
    """cell, n, hour and energy after each batch: value / 100 of every event, decayed by `rate` for each hour from its own to the cell's last. Rows may come in any order; state is three numbers a cell."""
    import pandas as pd

    def step(key, frames, state):
        n, hour, energy = state.get if state.exists else (0, 0, 0.0)
        for f in frames:
            for h, v in zip(f["hour"], f["value"], strict=True):
                n, last = n + 1, max(hour, h) if n else h
                energy = energy * rate ** (last - hour) * (n > 1) + v / 100 * rate ** (last - h)
                hour = last
        state.update((n, int(hour), float(energy)))
        yield pd.DataFrame({"cell": [key[0]], "n": [n], "hour": [int(hour)], "energy": [float(energy)]})

    e = events.select((F.col("user_id") % cells).alias("cell"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value").where("value is not null")
    return e.groupBy("cell").applyInPandasWithState(step, "cell long, n long, hour long, energy double", "n long, hour long, energy double", "update", "NoTimeout")
