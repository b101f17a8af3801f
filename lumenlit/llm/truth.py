"""The surviving value of every field of a duplicate group, by truth discovery.

A claim says that one record of an object gives a field a value, and names the
source level that stands behind the record.  Two steps alternate until neither
the reliabilities nor the chosen values move: (1) with the present
reliabilities, every claim votes and each (object, field) takes the value of
highest support; (2) a level's reliability becomes the share of its claims that
agree with the chosen values, smoothed.  Where levels carry a stated trust, the
estimates are fitted to its order (pool adjacent violators), so that evidence
refines a stated order but never inverts it.

Two ways of voting: ``sum`` adds the claims' log-odds (many weak sources can
outvote a strong one); ``strongest`` compares a value's best claim by
reliability, level, recency and record number, as curation rules do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.scratch import Scratch

MAX_LEVELS = 10_000  # rows of the reliability table; sources beyond this many levels must be binned
TOLERANCE, FREE_ROUNDS, MAX_ROUNDS, PRIOR_AGREE, PRIOR_CLAIMS = 1e-3, 10, 40, 0.8, 10.0

# Spellings of "no value given".
PLACEHOLDERS = ["", "-", "--", "–", "—", "?", ".", "n/a", "na", "n.a.", "n/d", "none", "null", "nil", "nan", "tbd", "tba", "unknown", "not reported", "not available", "not applicable", "not given", "unspecified", "missing"]


def present(value: Column) -> Column:
    """Whether a text is more than null, blank or a placeholder (case, outer blanks and word separators ignored)."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(value, r"[\s _]+", " "), r"^ | $", ""))
    return F.coalesce(~plain.isin(PLACEHOLDERS), F.lit(False))


def monotone(estimates: list[tuple[int, float, float]]) -> dict[int, float]:
    """Fit (level, estimate, weight) to a non-decreasing function of the level: weighted pool adjacent violators."""
    pools: list[list] = []
    for level, value, weight in sorted(estimates):
        pools.append([[level], value, weight])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            levels, v, w = pools.pop()
            below = pools[-1]
            below[1] = (below[1] * below[2] + v * w) / (below[2] + w)
            below[2] += w
            below[0] += levels
    return {level: value for levels, value, _ in pools for level in levels}


def discover_truth(claims: DataFrame, vote: str = "strongest", ordered: bool = True) -> tuple[DataFrame, dict[int, float], int]:
    """Chosen record per object and field, the levels' reliabilities and the rounds taken.

    ``claims``: object, field, record (long), value (present values only), level
    (int), recency (long, null as oldest).  Returns (object, field, record,
    value, support): the record is the strongest of those that claim the chosen
    value.  Ties end with the smaller record; objects without claims have no row.
    """
    if vote not in ("strongest", "sum"):
        raise ValueError(f"unknown vote: {vote}")
    spark = claims.sparkSession
    scratch = Scratch(spark, "truth")
    tidy = claims.select("object", "field", F.col("record").cast("long").alias("record"), F.xxhash64("value").alias("vote_key"), F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), F.coalesce(F.col("recency").cast("long"), F.lit(-(2**62))).alias("recency"))
    # one row per object, field, value and level: its best record and how many records stand behind it
    best = F.max(F.struct("recency", (-F.col("record")).alias("minus_record")))
    packed = scratch.cut(tidy.groupBy("object", "field", "vote_key", "level").agg(F.count("*").alias("n"), best.alias("best")), "claims")
    totals = {r.level: r.n for r in packed.groupBy("level").agg(F.sum("n").alias("n")).limit(MAX_LEVELS + 1).collect()}
    levels = sorted(totals)
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} source levels")
    reliability = {level: PRIOR_AGREE * (0.5 + 0.5 * (i + 1) / len(levels)) for i, level in enumerate(levels)}
    chosen = packed.select("object", "field", "vote_key", F.lit(0.0).alias("support"), F.lit(0).cast("long").alias("record")).where("false")
    rounds = 0
    for rounds in range(1, MAX_ROUNDS + 1):
        # at most MAX_LEVELS rows
        table = spark.createDataFrame([(level, float(reliability[level])) for level in levels], "level int, r double")
        voted = packed.join(F.broadcast(table), "level")
        strongest = F.max(F.struct(F.round("r", 9).alias("r"), "level", F.col("best.recency").alias("recency"), F.col("best.minus_record").alias("minus_record")))
        support = strongest if vote == "strongest" else F.round(F.sum(F.col("n") * F.log(F.col("r") / (1 - F.col("r")))), 6)
        values = voted.groupBy("object", "field", "vote_key").agg(support.alias("support"), strongest.alias("top"))
        winners = values.groupBy("object", "field").agg(F.max(F.struct("support", "top", "vote_key")).alias("win"))
        winners = scratch.cut(winners.select("object", "field", "win.vote_key", "win.support", "win.top"), f"round-{rounds}")
        # agreement is an equi-join on the full claim key, so no object is ever gathered whole
        agreed = packed.join(winners.select("object", "field", "vote_key"), ["object", "field", "vote_key"]).groupBy("level").agg(F.sum("n").alias("k"))
        agreeing = {row.level: row.k for row in agreed.collect()}  # at most MAX_LEVELS rows
        fresh = {level: (agreeing.get(level, 0) + PRIOR_AGREE * PRIOR_CLAIMS) / (totals[level] + PRIOR_CLAIMS) for level in levels}
        if ordered and fresh:
            fresh = monotone([(level, fresh[level], totals[level] + PRIOR_CLAIMS) for level in levels])
        fresh = {level: min(max(fresh[level], 0.01), 0.99) for level in levels}
        if rounds > FREE_ROUNDS:  # estimates that swing take ever smaller steps, so that the rounds end
            step = 0.5 ** (rounds - FREE_ROUNDS)
            fresh = {level: reliability[level] + step * (fresh[level] - reliability[level]) for level in levels}
        moved = max((abs(fresh[level] - reliability[level]) for level in levels), default=0.0)
        reliability = fresh
        if rounds > 1:
            scratch.drop(f"round-{rounds - 1}")
        value = F.col("top.r") if vote == "strongest" else F.col("support")
        chosen = winners.select("object", "field", "vote_key", value.alias("support"), (-F.col("top.minus_record")).alias("record"))
        if moved < TOLERANCE or not math.isfinite(moved):
            break
    else:
        raise RuntimeError(f"reliabilities still move after {MAX_ROUNDS} rounds")
    return chosen, reliability, rounds


FIELDS = ("signal_title", "intervention")


def record_trust(evidence: DataFrame, trust: DataFrame) -> DataFrame:
    """record_no and the highest trust among its evidence; case and outer blanks of the source type are ignored."""
    key = lambda c: F.upper(F.regexp_replace(F.col(c), r"^[\s ]+|[\s ]+$", ""))
    types = trust.select(key("source_type").alias("type"), "trust").groupBy("type").agg(F.max("trust").alias("trust"))
    backed = evidence.where("record_no is not null").groupBy(F.col("record_no").cast("long").alias("record_no"), key("source_type").alias("type")).agg(F.lit(1).alias("one"))
    return backed.join(types, "type").groupBy("record_no").agg(F.max("trust").cast("int").alias("level"))


def signal_claims(signals: DataFrame, evidence: DataFrame, trust: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The duplicated signal_ids, and the claims that their rows make."""
    rows = signals.where("signal_id is not null").select("record_no", "signal_id", F.unix_micros("updated_at").alias("recency"), *FIELDS)
    groups = rows.groupBy("signal_id").agg(F.count("*").alias("rows")).where("rows > 1").select("signal_id")
    ranked = rows.join(record_trust(evidence, trust), "record_no", "left")
    told = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(present(F.col(f)), F.trim(F.col(f))).alias("value")) for f in FIELDS)))
    claims = ranked.select(F.col("signal_id").alias("object"), F.col("record_no").alias("record"), F.coalesce("level", F.lit(0)).alias("level"), "recency", told.alias("told"))
    claims = claims.select("object", "told.field", "record", "told.value", "level", "recency").where("value is not null")
    return groups, claims.join(groups.withColumnRenamed("signal_id", "object"), "object", "left_semi")


def surviving_records(signals: DataFrame, evidence: DataFrame, trust: DataFrame) -> DataFrame:
    """signal_id, title_record and intervention_record of every signal with two or more rows; 0 where no row has the field.

    The claim of highest trust, recency and least number wins.  Reliabilities
    fitted to the order of trust could not change that, so none are estimated.
    """
    groups, claims = signal_claims(signals, evidence, trust)
    strength = F.struct("level", F.coalesce(F.col("recency").cast("long"), F.lit(-(2**62))).alias("recency"), (-F.col("record").cast("long")).alias("minus_record"))
    chosen = claims.groupBy("object", "field").agg(F.max(strength).alias("top")).select("object", "field", (-F.col("top.minus_record")).alias("record"))
    wide = chosen.groupBy(F.col("object").alias("signal_id")).agg(*(F.max(F.when(F.col("field") == f, F.col("record"))).alias(f) for f in FIELDS))
    return groups.join(wide, "signal_id", "left").select("signal_id", F.coalesce("signal_title", F.lit(0)).alias("title_record"), F.coalesce("intervention", F.lit(0)).alias("intervention_record"))


def typed_claims(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims of duplicated signals, one for each type of source behind the record; the level is the type's number.

    Types are told apart by a hash of their name, without case and outer blanks;
    records without evidence are level 0.
    """
    name = F.upper(F.regexp_replace(F.col("source_type"), r"^[\s ]+|[\s ]+$", ""))
    backed = evidence.where("record_no is not null and source_type is not null").select(F.col("record_no").cast("long").alias("record"), F.hash(name).alias("type")).distinct()
    none = signals.sparkSession.createDataFrame([], "source_type string, trust int")
    _, claims = signal_claims(signals, evidence.select("record_no", "source_type"), none)
    return claims.drop("level").join(backed, "record", "left").select("object", "field", "record", "value", F.coalesce("type", F.lit(0)).alias("level"), "recency")


def summed_records(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """object, field, record, value of the best supported value of each field by summed votes, where every type of source has a reliability of its own and no trust is stated."""
    claims = typed_claims(signals, evidence)
    chosen, _, _ = discover_truth(claims, vote="sum", ordered=False)
    values = claims.groupBy("object", "field", "record").agg(F.min("value").alias("value"))
    return chosen.select("object", "field", "record").join(values, ["object", "field", "record"])
