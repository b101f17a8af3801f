"""Evidence gathered into signals, and signals into cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions.text import stripped


def source_priority(source_type: Column) -> Column:
    mapping = F.create_map(*(F.lit(x) for kv in V.SOURCE_PRIORITY.items() for x in kv))
    return F.coalesce(F.try_element_at(mapping, F.upper(F.trim(source_type))), F.lit(9))


def cluster_key(trial: Column, site: Column, setting: Column, intervention: Column, population: Column) -> Column:
    """A named trial's name, else a digest of site, setting, four words of the intervention and three of the population."""
    name = F.upper(F.trim(F.coalesce(trial, F.lit(""))))
    words = lambda c, n: F.array_join(F.slice(F.split(stripped(c), " "), 1, n), " ")
    digest = F.substring(F.md5(F.concat_ws("|", stripped(site), stripped(F.coalesce(F.nullif(setting, F.lit("")), F.lit("other"))), words(intervention, 4), words(population, 3))), 1, 16)
    return F.when(~name.isin("", "NULL", "NONE", "NOT_REPORTED", "NOT REPORTED", "N/A"), F.concat(F.lit("trial:"), name)).otherwise(F.concat(F.lit("signal:"), digest))


def signals(evidence: DataFrame, key: str, identifier: str, source_type: str = "source_type") -> DataFrame:
    """One row per cluster: its number of sources, the best source and the labels of the first three kinds.

    Best is the highest precedence, then the smallest identifier.  Kinds are
    pre-aggregated per cluster, so that a cluster of any size stays small.
    """
    ranked = evidence.withColumn("priority", source_priority(F.col(source_type)))
    kinds = ranked.groupBy(key, F.upper(F.trim(F.col(source_type))).alias("kind"), "priority").agg(F.count("*").alias("n"), F.min(identifier).alias("first_id"))
    best = F.min(F.struct("priority", "first_id", "kind"))
    listed = F.array_sort(F.collect_list(F.struct("priority", F.coalesce("kind", F.lit("")).alias("kind"))))
    return kinds.groupBy(key).agg(F.sum("n").alias("sources"), best.alias("best"), listed.alias("kinds")).select(key, "sources", F.col("best.first_id").alias("primary_id"), F.col("best.kind").alias("primary_type"), F.array_join(F.slice(F.array_distinct(F.transform("kinds", lambda k: k["kind"])), 1, 3), " + ").alias("label"))


def signal_type(given: Column, gate: Column) -> Column:
    """The extracted type, else the one that the gate suggests."""
    mapping = F.create_map(*(F.lit(x) for kv in V.SIGNAL_TYPE_OF_GATE.items() for x in kv))
    return F.when(F.coalesce(given, F.lit("OTHER")).isin("", "OTHER"), F.coalesce(F.try_element_at(mapping, gate), F.lit("OTHER"))).otherwise(given)


def signal_order(impact: Column, kind: Column, identifier: Column) -> list[Column]:
    mapping = F.create_map(*(F.lit(x) for kv in V.SIGNAL_TYPE_PRIORITY.items() for x in kv))
    return [impact.asc_nulls_last(), F.coalesce(F.try_element_at(mapping, kind), F.lit(40)).desc(), identifier]


def confidence_source(source: Column, types: Column, is_abstract: Column) -> Column:
    """Where trust in a candidate comes from; the first rule that holds decides."""
    tag = F.upper(F.coalesce(source, F.lit("")))
    kinds = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.upper)
    return (
        F.when((tag == "FDA") | F.array_contains(kinds, "FDA DRUG APPROVAL"), "fda")
        .when(F.array_contains(kinds, "GUIDELINE") | (tag == "GUIDELINE"), "guideline")
        .when(F.coalesce(is_abstract, F.lit(False)), "late_breaking_abstract")
        .when(tag == "WEB_SEARCH", "llm_discovery")
        .when(tag == "TRADE_PRESS", "trade_press")
        .when(tag.isin("PRESS_RELEASE", "COMPANY_RELEASE"), "company_press_release")
        .otherwise("peer_reviewed")
    )


def source_type_of(tag: Column) -> Column:
    """The evidence type that a lane's tag stands for."""
    up = F.upper(F.coalesce(tag, F.lit("")))
    return F.when(up == "", "PUBMED").when(up == "FDA", "FDA").when(up.isin(V.SOCIETIES), "CONFERENCE_ABSTRACT").when(up == "WEB_SEARCH", "WEB_SEARCH").otherwise("JOURNAL")


def setting_name(setting: Column) -> Column:
    mapping = F.create_map(*(F.lit(x) for kv in V.SETTING_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(mapping, setting), F.lit("localized"))
