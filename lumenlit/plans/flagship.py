"""The whole batch as one lazy plan: gate, resolve duplicates, rank, cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.operators import dedupe, ranking
from lumenlit.plans import rule_queries
from lumenlit.sources.tables import table


def weekly_selection(spark: SparkSession, folder: str, cap: int = 40) -> DataFrame:
    """The best candidates of every site: gated, one per work, all with the strongest signals and others up to the cap."""
    sites = table(spark, folder, "sites", F.col("code").alias("cancer_site_code"), "watched_trials")
    watched = sites.select(F.explode("watched_trials").alias("trial"))
    rows = table(spark, folder, "candidates", "candidate_id", "pmid", "doi", "title", "abstract", "journal", "conference_source", "publication_types", "cancer_site_code", "ingested_at")
    gated = rule_queries.gates.gate(rows.join(F.broadcast(sites.select("cancer_site_code")), "cancer_site_code", "left_semi"), watched).where("qualifying_signal <> 'NONE'")
    scored = gated.withColumns({"quality": dedupe.quality(F.col("abstract"), F.lit(None).cast("string"), F.col("journal")), "ord": F.struct("ingested_at", "candidate_id"), "tier": F.when(F.col("signal_score") >= 85, "A").when(F.col("signal_score") >= 60, "B").otherwise("C")})
    unique = dedupe.hard_dedupe(scored, "quality", "ord")
    return ranking.capped(unique, "tier", "signal_score", "candidate_id", cap, within="cancer_site_code").select("candidate_id", "cancer_site_code", "qualifying_signal", "signal_score", "tier")


QUERIES = {"weekly_selection": weekly_selection}

SQL = {
    "weekly_selection": rule_queries._GATE.replace("SELECT candidate_id, lower(coalesce(title, '')) AS title_", "SELECT candidate_id, pmid, doi, abstract, journal, ingested_at, cancer_site_code, lower(coalesce(title, '')) AS title_").replace("FROM candidates)", "FROM candidates WHERE cancer_site_code IN (SELECT code FROM sites))", 1)
    + f""", s AS (SELECT *, CASE WHEN qualifying_signal = 'NONE' THEN 0 ELSE greatest(0, {rule_queries._BASE} + added_) END AS signal_score FROM gated WHERE qualifying_signal <> 'NONE'),
q AS (SELECT *, CASE WHEN coalesce(abstract, '') <> '' THEN 50 ELSE 0 END AS quality, nullif(pmid, '') AS k, nullif(lower(trim(doi)), '') AS d, CASE WHEN signal_score >= 85 THEN 'A' WHEN signal_score >= 60 THEN 'B' ELSE 'C' END AS tier FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ingested_at, candidate_id) AS n FROM q),
b AS (SELECT * FROM a WHERE k IS NULL OR n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY quality DESC, ingested_at, candidate_id) AS m FROM b),
u AS (SELECT * FROM c WHERE d IS NULL OR m = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY cancer_site_code ORDER BY tier, signal_score DESC, candidate_id) AS place FROM u WHERE tier <> 'A'),
z AS (SELECT cancer_site_code, count(*) AS used FROM u WHERE tier = 'A' GROUP BY 1)
SELECT candidate_id, cancer_site_code, qualifying_signal, CAST(signal_score AS INTEGER) AS signal_score, tier FROM u WHERE tier = 'A'
UNION ALL SELECT candidate_id, cancer_site_code, qualifying_signal, CAST(signal_score AS INTEGER), tier FROM t LEFT JOIN z USING (cancer_site_code) WHERE place <= 40 - coalesce(used, 0)""",
}
