"""Usage analytics over events (WIN-11..16, AGG-22, AGG-26, MSR-30, MSR-31, MSR-33, STR-03, STR-04, FLT-20, FLT-21, JON-15, JON-16). ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many uses of a kind an activation allows, and its days.
QUOTAS, DAYS = {"text": 30, "photo": 15, "video": 1}, 7


def last_n(events: DataFrame, n: int, user: str = "user_id") -> DataFrame:
    """WIN-12, WIN-13: each user's newest n events, with their place."""
    w = W.partitionBy(user).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def activation(events: DataFrame, days: int = DAYS) -> DataFrame:
    """WIN-16: (user_id, activated_at, expires_at)."""
    return events.groupBy("user_id").agg(F.min("ts").alias("activated_at")).withColumn("expires_at", F.col("activated_at") + F.expr(f"INTERVAL {days} DAYS"))


def access_role(users: DataFrame, admins: DataFrame) -> DataFrame:
    """FLT-21: users (user_id, role, ...) with role admin if they are among the admins, else their own, else demo."""
    listed = admins.select("user_id").distinct().withColumn("__admin", F.lit(True))
    return users.join(listed, "user_id", "left").withColumn("role", F.when(F.col("__admin"), "admin").otherwise(F.coalesce("role", F.lit("demo")))).drop("__admin")


def may_ingest(role: Column) -> Column:
    """FLT-21: who may bring new knowledge in."""
    return F.coalesce(role.isin("admin", "full_access"), F.lit(False))


def gate(events: DataFrame, kind: Column, quotas: dict[str, int] = QUOTAS, days: int = DAYS, role: Column | None = None) -> DataFrame:
    """WIN-15, FLT-21: every event with used (of its kind, before it) and verdict: allowed, expired or quota.

    A kind without a quota is unlimited, and so are admins; a user's window begins with the first event.
    """
    w = W.partitionBy("user_id", "kind").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    out = events.withColumn("kind", kind).join(activation(events, days), "user_id")
    out = out.withColumn("used", F.count("*").over(w)).withColumn("most", F.try_element_at(most, F.col("kind")))
    return out.withColumn("verdict", F.when(F.lit(False) if role is None else F.coalesce(role == "admin", F.lit(False)), "allowed").when(F.col("expires_at") < F.col("ts"), "expired").when(F.col("used") >= F.col("most"), "quota").otherwise("allowed"))


def hours_left(expires: Column, now: Column) -> Column:
    """MSR-30."""
    return (F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3.6e9


def temperature(n: Column) -> Column:
    """MSR-31."""
    return F.when(n >= 20, "hot").when(n >= 10, "warm").otherwise("cold")


def lead_stats(events: DataFrame, now: Column, days: int = DAYS, users: DataFrame | None = None) -> DataFrame:
    """AGG-22: one row of totals. With users (user_id), those without events count as not activated."""
    known = events.groupBy("user_id").agg(F.count("*").alias("n")).join(activation(events, days), "user_id")
    if users is not None:
        known = users.select("user_id").distinct().join(known, "user_id", "left")
    totals = {"users": F.count("*"), "uses": F.coalesce(F.sum("n"), F.lit(0)), "active": F.count_if(F.col("expires_at") >= now), "expired": F.count_if(F.col("expires_at") < now), "hot": F.count_if(temperature(F.col("n")) == "hot"), "warm": F.count_if(temperature(F.col("n")) == "warm")}
    if users is not None:
        totals["not_activated"] = F.count_if(F.col("expires_at").isNull())
    return known.agg(*[c.alias(k) for k, c in totals.items()])


def expiry_warnings(events: DataFrame, now: Column, days: int = DAYS, within: float = 25.0) -> DataFrame:
    """STR-03 as a batch: users with 0 < hours left <= within."""
    return activation(events, days).withColumn("hours_left", hours_left(F.col("expires_at"), now)).filter((F.col("hours_left") > 0) & (F.col("hours_left") <= within))


def warn_once(users: DataFrame, now: Column, within: float = 25.0) -> DataFrame:
    """STR-03: users (expires_at, expiry_warned, ...) with warn, whether a warning is due now, and expiry_warned as it is behind it; what a poll writes back."""
    left = hours_left(F.col("expires_at"), now)
    due = F.coalesce((left > 0) & (left <= within) & ~F.coalesce("expiry_warned", F.lit(False)), F.lit(False))
    return users.withColumn("warn", due).withColumn("expiry_warned", F.coalesce("expiry_warned", F.lit(False)) | F.col("warn"))


def daily_digest(events: DataFrame) -> DataFrame:
    """STR-04, AGG-26 as a batch."""
    return events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def days_used(activated: Column, now: Column) -> Column:
    """MSR-30: days since the activation, begun ones whole."""
    return F.ceil(-hours_left(activated, now) / 24)


def latest_sessions(sessions: DataFrame, *open_: str) -> DataFrame:
    """WIN-11: of each user the session that was created last, of those in an open status; ties by the larger session_id."""
    some = sessions.filter(F.col("status").isin(*(open_ or ("collecting", "awaiting_confirmation"))))
    last = F.max_by(F.struct(*[c for c in sessions.columns if c != "user_id"]), F.struct("created_at", "session_id"))
    return some.groupBy("user_id").agg(last.alias("x")).select("user_id", "x.*")


def recent_presets(uses: DataFrame, *preset: str, n: int = 3, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """WIN-14: each user's n distinct presets that were used last, newest first, with place. Uses are pre-aggregated to presets."""
    by = uses.groupBy("user_id", *preset).agg(F.max(F.struct(*order)).alias("last"))
    return by.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last"), *preset))).filter(F.col("place") <= n)


def find_users(users: DataFrame, wanted: str, *columns: str) -> DataFrame:
    """FLT-20: users that have the wanted text in one of the columns, in any case."""
    low = F.lit(wanted.lower())
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False))
    return users.filter(test)


def by_code(events: DataFrame, users: DataFrame, code: str) -> DataFrame:
    """JON-16: events with the user whose invite code they carry; others have none."""
    return events.join(users, code, "left")


def generation_cost(chars: Column, per_char: float) -> Column:
    """MSR-33."""
    return chars * per_char
