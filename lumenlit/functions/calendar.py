"""Dates of variable precision, windows and the conference calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V


def lenient_date(value: Column) -> Column:
    """The date in the first ten characters, split on hyphens; a missing month or day counts as the first. Null if unreadable."""
    parts = F.split(F.substring(F.regexp_replace(value, r"^[\s\x{a0}]+", ""), 1, 10), "-")
    part = lambda i: F.coalesce(F.nullif(F.try_element_at(parts, F.lit(i)), F.lit("")), F.lit("1" if i > 1 else ""))
    text = F.concat_ws("-", F.lpad(part(1), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    sound = part(1).rlike(r"^\d{1,4}$") & part(2).rlike(r"^\d{1,2}$") & part(3).rlike(r"^\d{1,2}$")
    return F.when((F.size(parts) <= 3) & sound, F.try_to_date(text, "yyyy-MM-dd"))


def strict_date(value: Column) -> Column:
    """A date that is exactly year-month-day, year-month or year; null for any other text."""
    found = F.when(value.rlike(r"^\d{4}(-\d{1,2}){0,2}$"), value)
    return lenient_date(found)


def in_publication_window(value: Column, end: str, days: int = 14) -> Column:
    """Whether a written date lies in the days up to ``end``; missing and unreadable dates pass."""
    last = F.lit(end).cast("date")
    return F.coalesce(lenient_date(value).between(F.date_sub(last, days), last), F.lit(True))


def seen_since(moment: Column, as_of: str, days: int) -> Column:
    return moment >= F.expr(f"timestamp'{as_of}' - interval {days} days")


def week_start(moment: Column) -> Column:
    """The Monday of the week."""
    return F.trunc(moment, "week")


def active_meetings(dates: DataFrame, reference: str, lookback: int = 35, meetings: list[tuple[str, int, int]] = V.MEETINGS) -> DataFrame:
    """The meetings whose supplement is due at each date of ``reference``, with the window to search (the latest year that has begun).

    Columns: the reference, meeting, window_start, window_end.
    """
    days = dates.select(reference).distinct().select(F.col(reference), F.explode(F.array(*(F.struct(F.lit(c).alias("meeting"), F.lit(m).alias("month"), F.lit(w).alias("leeway")) for c, m, w in meetings))).alias("m"))
    years = days.select(reference, "m.*", F.explode(F.array(F.year(reference), F.year(reference) - 1)).alias("year"))
    published = years.withColumn("published", F.make_date("year", "month", F.lit(1)))
    gap = F.datediff(F.col(reference), F.col("published"))
    due = published.where((gap >= 0) & (gap <= F.lit(lookback) + F.col("leeway")))
    latest = due.groupBy(reference, "meeting").agg(F.max(F.struct("published", "leeway")).alias("p"))
    return latest.select(reference, "meeting", F.date_sub("p.published", F.col("p.leeway")).alias("window_start"), F.least(F.date_add("p.published", lookback), F.col(reference)).alias("window_end"))
