"""Queries of the timestamp problem over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.operators.timestamps import normalise_timestamps
from lumenlit.sources.tables import table


def written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Every written date of the three tables in the operator's shape."""
    feeds = table(spark, folder, "feeds", "source_key", "home_zone", "day_first")
    news = table(spark, folder, "news_records", "news_id", "source_key", "pub_date", "fetched_at").join(F.broadcast(feeds), "source_key", "left")
    news = news.select(
        F.concat(F.lit("news:"), F.coalesce("source_key", F.lit(""))).alias("source"), F.lit("news_records").alias("table_name"), F.col("news_id").alias("record_id"),
        F.col("fetched_at").alias("delivered"), F.col("pub_date").alias("raw"), "home_zone", F.when(F.col("day_first"), "D").when(~F.col("day_first"), "M").alias("day_month"),
    )
    fda = table(spark, folder, "fda_items", "fda_id", "source", "pub_date", "fetched_at").select(
        F.concat(F.lit("fda:"), F.coalesce("source", F.lit(""))).alias("source"), F.lit("fda_items").alias("table_name"), F.col("fda_id").alias("record_id"),
        F.col("fetched_at").alias("delivered"), F.col("pub_date").alias("raw"), F.lit("America/New_York").alias("home_zone"), F.lit("M").alias("day_month"),
    )
    candidates = table(spark, folder, "candidates", "candidate_id", "run_id", "publication_date", "ingested_at").select(
        F.concat(F.lit("run:"), F.coalesce("run_id", F.lit(""))).alias("source"), F.lit("candidates").alias("table_name"), F.col("candidate_id").alias("record_id"),
        F.col("ingested_at").alias("delivered"), F.col("publication_date").alias("raw"), F.lit("UTC").alias("home_zone"), F.lit(None).cast("string").alias("day_month"),
    )
    return news.unionByName(fda).unionByName(candidates)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_timestamps(written_dates(spark, folder))


def p2_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """The moments that the order of each source alone decides, every declared day/month order withheld."""
    return normalise_timestamps(written_dates(spark, folder).withColumn("day_month", F.lit(None).cast("string")))


def p2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per table: the records read both ways, and for how many the inferred moment is the one by the declared order."""
    both = p2_found(spark, folder).join(p2_inferred(spark, folder).withColumnRenamed("moment", "inferred"), ["table_name", "record_id"])
    counts = both.groupBy("table_name").agg(F.count("*").alias("records"), F.count_if(F.col("moment") == F.col("inferred")).alias("agreed"))
    return counts.withColumn("share", F.round(F.col("agreed") / F.col("records"), 6))


QUERIES = {"p2_found": p2_found, "p2_inferred": p2_inferred, "p2_agreement": p2_agreement}
SQL: dict[str, str] = {}
