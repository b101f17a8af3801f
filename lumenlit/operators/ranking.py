"""Ranks, protected caps and capped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.columns import unused


def capped(rows: DataFrame, tier: str, score: str, identifier: str, cap: int, within: str | None = None, protected: str = "A") -> DataFrame:
    """All rows of the protected tier, and the best others up to the cap; 0 means no cap.

    Others rank by tier, score (higher first) and identifier.  With ``within`` the
    cap holds for each of its values.  Partial ranks are limited before the
    shuffle, so a global cap moves at most ``cap`` rows per partition.
    """
    if cap <= 0:
        return rows
    is_safe = F.coalesce(F.col(tier) == protected, F.lit(False))
    safe, rest = rows.where(is_safe), rows.where(~is_safe)
    place, used = unused("place", rows.columns), unused("used", rows.columns)
    order = [F.col(tier).asc_nulls_last(), F.col(score).desc_nulls_last(), F.col(identifier)]
    if within is None:
        best = rest.orderBy(*order).limit(cap)
        count = safe.agg(F.count("*").alias(used))
        ranked = best.withColumn(place, F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(count))  # at most cap rows
    else:
        counts = safe.groupBy(within).agg(F.count("*").alias(used))
        ranked = rest.withColumn(place, F.row_number().over(Window.partitionBy(within).orderBy(*order))).where(F.col(place) <= cap).join(counts, within, "left").withColumn(used, F.coalesce(used, F.lit(0)))
    return safe.unionByName(ranked.where(F.col(place) <= cap - F.col(used)).select(*rows.columns))


def ranked(rows: DataFrame, order: list[Column], within: list[str] | None = None, place: str = "place") -> DataFrame:
    """Rows with their place in a total order, within groups if given."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def messages(rows: DataFrame, user: str, tier: str, order: list[Column], most: int = 3) -> DataFrame:
    """Per user the first ``most`` rows of tier A, or one summary row with the number of rows where there is none."""
    urgent = rows.where(F.col(tier) == "A")
    singles = urgent.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("place") <= most)
    totals = rows.groupBy(user).agg(F.count("*").alias("n"), F.max((F.col(tier) == "A").cast("int")).alias("any_a")).where("any_a = 0")
    summary = totals.select(user, F.lit(1).alias("place"), F.concat(F.col("n").cast("string"), F.lit(" updates")).alias("message"))
    return singles.select(user, "place", F.col("title").alias("message")).unionByName(summary)
