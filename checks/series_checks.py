"""Anomalies in the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.operators import anomaly

from .base import query, table

col = F.col
MADE = "CASE WHEN event_id % 997 = 0 THEN value * 100 ELSE value END"


def series(spark, sf):
    value = F.when(col("event_id") % 997 == 0, col("value") * 100).otherwise(col("value"))
    return table(spark, sf, "events").select("event_id", "ts", value.alias("value"))


@query("an3_sigma_threshold", f"WITH e AS (SELECT event_id, {MADE} AS v FROM events) SELECT event_id, v AS value, round((SELECT avg(v) + 3 * stddev_pop(v) FROM e), 6) AS threshold FROM e WHERE v > (SELECT avg(v) + 3 * stddev_pop(v) FROM e)")
def _(spark, sf):
    return anomaly.flag_sigma(series(spark, sf), "value").filter("anomaly").select("event_id", "value", F.round("threshold", 6).alias("threshold"))


@query("an4_aligned_series", f"WITH e AS (SELECT event_id, ts, {MADE} AS v FROM events) SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS position, v AS value, round(v * 2, 6) AS score, CAST(v * 2 > (SELECT avg(v * 2) + 3 * stddev_pop(v * 2) FROM e) AS BIGINT) AS anomaly FROM e")
def _(spark, sf):
    scored = series(spark, sf).withColumn("score", col("value") * 2)
    out = anomaly.anomaly_table(scored, [col("ts"), col("event_id")], "value", "score")
    return out.select("position", "value", F.round("score", 6).alias("score"), col("anomaly").cast("bigint").alias("anomaly"))


@query("an1_forest_anomaly_score")
def _(spark, sf):
    out = anomaly.rcf_scores(series(spark, sf), "event_id", "value")
    return out.select("event_id", "value", F.round("score", 6).alias("score"))
