"""Heuristic event scores, and the rules of the task queue and the agenda."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(base: float, *parts: tuple[str, float]) -> Column:
    out = F.lit(base)
    for flag, weight in parts:
        out = out + F.when(F.col(flag), weight).otherwise(0.0)
    return out


def score_events(e: DataFrame) -> DataFrame:
    """e with ``score`` in 0..1, rounded to 3 places: what each source's flags add and take, with a floor for the user's own."""
    mail = _sum(0.3, ("replied", 0.4), ("flagged", 0.3), ("urgent", 0.15), ("automated", -0.15), ("listed", -0.2), ("junk", -0.3))
    by = F.when(F.col("source") == "mail", mail).when(F.col("source") == "imessage", _sum(0.3, ("filtered", -0.1), ("auto_reply", -0.15))).when(F.col("source") == "whatsapp", _sum(0.3, ("is_group", -0.15), ("has_url", 0.1)))
    by = by.when(F.col("source") == "calendar", _sum(0.3, ("attended", 0.1), ("holiday", -0.3))).otherwise(_sum(0.3, ("threaded", 0.1)))
    floor = F.when(F.col("is_from_me"), 0.3).otherwise(0.0)
    return e.withColumn("score", F.round(F.greatest(F.least(F.greatest(by, F.lit(0.0)), F.lit(1.0)), floor), 3))


def bucket(deadline: Column, today: Column, priority: Column) -> Column:
    days = F.date_diff(F.to_date(deadline), F.to_date(today))
    return F.when((days <= 0) | (priority == 1), "immediate").when((days <= 7) | (priority == 2), "review").otherwise("background")


def next_due(due: Column, rule: Column) -> Column:
    """Next date of a daily, weekly, monthly (day at most 28) or yearly task; a leap day has no yearly next, other rules none."""
    month = F.date_add(F.trunc(F.add_months(due, 1), "month"), F.least(F.dayofmonth(due), F.lit(28)) - 1)
    leap = (F.month(due) == 2) & (F.dayofmonth(due) == 29)
    return F.when(rule == "daily", F.date_add(due, 1)).when(rule == "weekly", F.date_add(due, 7)).when(rule == "monthly", month).when((rule == "yearly") & ~leap, F.add_months(due, 12))


def band(d: Column, today: Column) -> Column:
    week = lambda x: F.trunc(x, "week")
    return (
        F.when(d == today, "today").when(d == F.date_add(today, 1), "tomorrow").when(week(d) == week(today), "this_week")
        .when(week(d) == F.date_add(week(today), 7), "next_week").when(F.trunc(d, "month") == F.trunc(today, "month"), "rest_of_month").otherwise("later")
    )
