"""A mixture of sources at target shares of its tokens.

Water-filling with caps: every source gets its share of the mixture's size; one
that would need more than its tokens times its permitted repetitions is clamped
there, and what it cannot give is spread over the others in proportion to their
shares, until nothing is over its cap.  An allotment is so many whole passes over
the source and a part of one more.  The part is a prefix of the source in a
seeded hash order, found in two steps: token sums of hash buckets place its
border in one bucket, and only this bucket is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.scratch import Scratch

BUCKETS = 1 << 16
MAX_SOURCES = 100_000  # the table of targets is held by the driver


def water_fill(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """The allotment of each source: in proportion to the shares, at most the caps, adding up to ``total`` if the caps allow."""
    given = {s: 0.0 for s in shares}
    active = {s for s, share in shares.items() if share > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while active and left > 0:
        weight = math.fsum(shares[s] for s in active)
        over = {s for s in active if left * shares[s] / weight >= caps[s]}
        if not over:
            for s in active:
                given[s] = left * shares[s] / weight
            break
        for s in over:
            given[s] = float(caps[s])
        left -= math.fsum(caps[s] for s in over)
        active -= over
    return given


def _plan(documents: DataFrame, targets: DataFrame, total: int | None) -> list[dict]:
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"))
    have = documents.groupBy("source").agg(F.sum("tokens").alias("have"))
    rows = wanted.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("have", F.lit(0)).alias("have")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    size = total if total is not None else documents.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = water_fill(size, {r["source"]: r["share"] for r in rows}, {r["source"]: r["have"] * r["repeats"] for r in rows})
    plan = []
    for r in rows:
        passes = min(int(given[r["source"]] // r["have"]), r["repeats"]) if r["have"] else 0
        plan.append({"source": r["source"], "share": r["share"], "repeats": int(r["repeats"]), "have": int(r["have"]), "passes": passes, "part": max(0.0, given[r["source"]] - passes * r["have"]) if passes < r["repeats"] else 0.0})
    return plan


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and the report of the shares reached.

    ``documents``: doc_id, source, tokens; ``total`` is the mixture's size, by
    default that of all documents.  Documents of a null source or of one without
    a target are not in the mixture; targets without documents give their share
    to the others; a source named twice has the sum of its shares.  Empty
    documents ride along at no cost.  No documents: an empty mixture and shares
    of 0.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    documents = documents.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    plan = _plan(documents, targets, total)
    schema = "source string, share double, repeats int, have long, passes int, part double"
    parts = spark.createDataFrame([tuple(p.values()) for p in plan], schema)
    hashed = documents.join(F.broadcast(parts), "source").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = hashed.groupBy("source", "bucket", "part").agg(F.sum("tokens").alias("in_bucket"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BUCKETS rows a source
    sums = sums.withColumn("upto", F.sum("in_bucket").over(upto))
    border = sums.where("upto > part").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before"))).alias("at")).select("source", F.col("at.bucket").alias("border"), F.col("at.before").alias("before"))
    placed = hashed.join(F.broadcast(border), "source", "left")  # one row a target source
    inside = placed.where("part > 0 and bucket = border")
    rank = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a document on the border belongs to the part if more than half of it does
    last = inside.withColumn("cum", F.col("before") + F.sum("tokens").over(rank)).select("doc_id", (F.col("cum") - F.col("tokens") / 2 <= F.col("part")).alias("more"))
    other = placed.where("not (part > 0 and bucket <=> border)").select("doc_id", "source", "tokens", "passes", (F.expr("part > 0") & (F.col("border").isNull() | (F.col("bucket") < F.col("border")))).alias("more"))
    taken = other.unionByName(inside.select("doc_id", "source", "tokens", "passes").join(last, "doc_id"))
    mixture = taken.select("doc_id", "source", "tokens", (F.col("passes") + F.col("more").cast("int")).alias("copies")).where("copies > 0")
    mixture = scratch.cut(mixture, "mixture")
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("whole"))
    report = parts.join(got, "source", "left").crossJoin(whole)
    report = report.select("source", F.col("share").alias("target_share"), F.round(F.coalesce(F.try_divide("taken", "whole"), F.lit(0.0)), 6).alias("reached_share"), F.col("have").alias("tokens_available"), F.coalesce("taken", F.lit(0)).alias("tokens_taken"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.col("repeats").alias("max_repeats"))
    return mixture, report
