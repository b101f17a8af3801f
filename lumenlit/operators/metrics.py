"""Counts along the way: funnels, histograms, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def funnel(rows: DataFrame, by: str, stages: dict[str, str]) -> DataFrame:
    """Long form (by, stage, n): how many rows pass each stage and all before it; ``by`` null is the total over all groups."""
    upto, aggregates = "true", []
    for name, condition in stages.items():
        upto = f"{upto} and coalesce({condition}, false)"
        aggregates.append(F.count_if(F.expr(upto)).alias(name))
    wide = rows.groupBy(by).agg(*aggregates)
    total = wide.agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in stages]).select(F.lit(None).cast(rows.schema[by].dataType).alias(by), *stages)
    names = ", ".join(f"'{s}', `{s}`" for s in stages)
    return wide.where(F.col(by).isNotNull()).unionByName(total).select(by, F.expr(f"stack({len(stages)}, {names}) as (stage, n)"))


def histogram(rows: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """(column, n); with ``values`` also those that do not occur, at 0, and no others."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    if values is None:
        return counted
    listed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return listed.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top_values(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values; equal counts in alphabetical order."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(most)


def counts_for(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Row counts of the wanted keys that occur."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
