"""Top N items within every group, in two salted stages.

Each group is hashed into subgroups by item; every subgroup keeps its N best,
and only these survivors are ranked against each other.  A group of any size is
thereby ranked by many tasks, and the last task of a group sees at most
N x subgroups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.columns import unused as _unused

SUBGROUPS = 64


def top_n(items: DataFrame, group: list[str], score: str, identifier: str, n: int, place: str = "place", subgroups: int = SUBGROUPS) -> DataFrame:
    """The ``n`` best rows of each group with their place, 1 first.

    Higher scores come first, null scores last, equal scores by the smaller
    identifier, nulls last; rows that are equal in both are ordered arbitrarily but
    keep distinct places.  Null group values form a group of their own.  Groups
    of fewer than ``n`` rows come out whole; an empty input gives no rows.  The
    columns of ``items`` pass through; ``place`` must not be one of them.
    """
    if n < 1 or subgroups < 1:
        raise ValueError("n and subgroups must be positive")
    if place in items.columns:
        raise ValueError(f"column {place} exists already")
    salt = _unused("salt", items.columns)
    order = [F.col(score).desc_nulls_last(), F.col(identifier).asc_nulls_last()]
    salted = items.withColumn(salt, F.pmod(F.xxhash64(F.col(identifier)), F.lit(subgroups)).cast("int"))
    first = salted.withColumn(place, F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order))).where(F.col(place) <= n).drop(place, salt)
    return first.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(place) <= n)


def code_key(code: Column) -> Column:
    """One spelling of a code: lower case, no outer blanks, words joined by an underscore; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(code, r"^[\s ]+|[\s ]+$", "")), r"[\s _\-]+", "_"), F.lit(""))


def latest_scores(scores: DataFrame) -> DataFrame:
    """candidate_id and the latest of its non-null scores; equal times give the higher score, a null time counts as oldest."""
    latest = F.max(F.struct(F.coalesce("scored_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "score")).alias("latest")
    return scores.where("score is not null and candidate_id is not null").groupBy("candidate_id").agg(latest).select("candidate_id", F.col("latest.score").alias("score"))


def top_candidates(candidates: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best-scored candidates of each site and run: site_code, run_id, place, candidate_id, score.

    Repeated deliveries of a candidate count once; candidates without a site,
    without an id or without a non-null score are left out; a null run is a run.
    """
    placed = candidates.select(code_key(F.col("cancer_site_code")).alias("site_code"), "run_id", "candidate_id").where("site_code is not null and candidate_id is not null")
    # both sides meet on candidate_id, which also satisfies the distinct
    scored = placed.join(latest_scores(scores), "candidate_id").dropDuplicates(["candidate_id", "site_code", "run_id"])
    return top_n(scored, ["site_code", "run_id"], "score", "candidate_id", n)
