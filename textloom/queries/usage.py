"""Queries over events: name -> (function, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import usage as U
from textloom.queries.documents import r6, table

#: Which quota an event type draws on; types without one are unlimited.
KINDS = {"click": "text", "view": "photo", "purchase": "video"}
NOW = "TIMESTAMP '2024-01-07 12:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def kind():
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")), F.lit("other"))


def usage_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.last_n(events(spark, sf_dir), 5).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.gate(events(spark, sf_dir), kind()).groupBy("user_id", "kind", "verdict").agg(F.count("*").alias("n"))


USAGE_QUOTA = """WITH a AS (SELECT *, CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'photo' WHEN 'purchase' THEN 'video' ELSE 'other' END AS kind, min(ts) OVER (PARTITION BY user_id) + INTERVAL 7 DAYS AS e FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) - 1 AS used, CASE kind WHEN 'text' THEN 30 WHEN 'photo' THEN 15 WHEN 'video' THEN 1 END AS most FROM a)
SELECT user_id, kind, CASE WHEN e < ts THEN 'expired' WHEN used >= most THEN 'quota' ELSE 'allowed' END AS verdict, count(*) AS n FROM b GROUP BY 1, 2, 3"""


def usage_activation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = U.activation(events(spark, sf_dir))
    return a.select("user_id", "activated_at", "expires_at", r6(U.hours_left(F.col("expires_at"), F.expr(NOW))).alias("hours_left"))


def usage_lead_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.lead_stats(events(spark, sf_dir), F.expr(NOW))


USAGE_LEAD_STATS = f"""WITH a AS (SELECT user_id, count(*) AS n, min(ts) + INTERVAL 7 DAYS AS e FROM events GROUP BY user_id)
SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS uses, count(*) FILTER (WHERE e >= {NOW}) AS active, count(*) FILTER (WHERE e < {NOW}) AS expired, count(*) FILTER (WHERE n >= 20) AS hot, count(*) FILTER (WHERE n >= 10 AND n < 20) AS warm FROM a"""


def usage_expiry_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.expiry_warnings(events(spark, sf_dir), F.expr(NOW)).select("user_id", r6(F.col("hours_left")).alias("hours_left"))


LEFT = f"round((epoch_us(min(ts) + INTERVAL 7 DAYS) - epoch_us({NOW})) / 3.6e9::DOUBLE, 6)"


def usage_daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = U.daily_digest(events(spark, sf_dir))
    return d.select(F.col("day").cast("string").alias("day"), "user_id", "n", F.round("value", 4).alias("value"))


QUERIES = {
    "usage_last_n": (usage_last_n, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 5"),
    "usage_quota": (usage_quota, USAGE_QUOTA),
    "usage_activation_window": (usage_activation_window, f"SELECT user_id, min(ts) AS activated_at, min(ts) + INTERVAL 7 DAYS AS expires_at, {LEFT} AS hours_left FROM events GROUP BY user_id"),
    "usage_lead_stats": (usage_lead_stats, USAGE_LEAD_STATS),
    "usage_expiry_warnings": (usage_expiry_warnings, f"SELECT * FROM (SELECT user_id, {LEFT} AS hours_left FROM events GROUP BY user_id) WHERE hours_left > 0 AND hours_left <= 25"),
    "usage_daily_digest": (usage_daily_digest, "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"),
}
