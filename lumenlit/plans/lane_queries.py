"""Search lanes, tiers and watchlists over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.conf import tiers as T
from lumenlit.functions import rules
from lumenlit.functions.rules import quoted
from lumenlit.operators import dedupe, metrics, search
from lumenlit.sources.tables import table

TUMOR = ["cancer", "carcinoma", "melanoma", "lymphoma"]
STUDY = ["randomised", "randomized", "phase 3", "phase 2", "subgroup"]


def _text():
    return F.concat_ws("\n", "title", "abstract")


def lane_core(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "mesh_terms")
    return search.lane(rows, search.core(_text(), F.col("mesh_terms"), ["breast", "lung cancer"], TUMOR, ["Breast Neoplasms"]), []).select("candidate_id")


def lane_main_query(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "mesh_terms", "publication_date", "ingested_at")
    published = F.try_to_date("publication_date", "yyyy-MM-dd")
    where = search.core(_text(), F.col("mesh_terms"), ["breast", "lung cancer"], TUMOR, ["Breast Neoplasms"]) & search.any_term(_text(), STUDY) & search.in_window(published, F.to_date("ingested_at"), "2023-01-01", "2023-03-31")
    return search.lane(rows, where, []).select("candidate_id")


def lane_journals(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "journal", "ingested_at").distinct()
    where = search.in_journals(F.col("journal"), ["Annals of Tumour Medicine", "Review of Tumour Medicine"])
    return search.lane(rows, where, [F.col("ingested_at").desc(), F.col("candidate_id")], 37).select("candidate_id", "ingested_at")


def lane_conferences(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "conference_source", "publication_types")
    return search.lane(rows, F.col("conference_source").isin("ASCO", "ESMO", "ASTRO") & F.array_contains("publication_types", "Congress"), []).select("candidate_id", "conference_source")


def synthetic_ids(spark, folder):
    return table(spark, folder, "news_records", "news_id", "title").select("news_id", search.synthetic_identifier(F.col("title")).alias("identifier"))


def conference_tag(spark, folder):
    tags = [("oncologic surgery", "SURG"), ("tumour medicine", "MED"), ("journal", "JOUR")]
    return table(spark, folder, "candidates", "candidate_id", "journal").select("candidate_id", search.first_tag(F.col("journal"), tags).alias("tag"))


def watchlists(spark, folder):
    rows = table(spark, folder, "sites", "code", "watched_trials", "free_text_core")
    return rows.select("code", F.array_join(search.watchlist(F.col("watched_trials"), F.array(F.lit("EXTRA-1"), F.col("watched_trials")[0]), F.col("free_text_core")), "|").alias("watchlist"))


def short_text_enrichment(spark, folder):
    news = table(spark, folder, "news_records", "news_id", "title", "abstract")
    pages = table(spark, folder, "news_records", "title", "abstract").where("length(abstract) >= 200").groupBy("title").agg(F.max("abstract").alias("page"))
    return search.enriched(news, pages, "title", "abstract", "page").select("news_id", F.coalesce(F.length("abstract"), F.lit(0)).alias("characters"))


def seen_preload(spark, folder):
    rows = table(spark, folder, "evidence_sources", "pmid", "title", "retrieved_at").where("retrieved_at >= timestamp'2025-01-01' - interval 365 days")
    return rows.select(dedupe.seen_key(F.col("pmid"), F.col("title")).alias("seen_key")).distinct()


def _extractions(spark, folder):
    n = "(l_orderkey * 7 + l_linenumber * 13)"
    pick = lambda names, by: f"element_at(array({', '.join(map(quoted, names))}), cast(({by}) % {len(names)} as int) + 1)"
    return table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").selectExpr(
        "l_orderkey", "l_linenumber", f"{pick(T.PHASES, n)} study_phase", f"{pick(T.DIRECTIONS, 'l_partkey')} direction", f"{pick(T.SIGNAL_TYPES, 'l_orderkey * 3 + l_partkey * 5 + l_suppkey')} signal_type", f"{pick(T.GATES, 'l_suppkey * 3 + l_linenumber')} gate",
        "CASE WHEN l_partkey % 2 = 0 THEN 'overall_survival' ELSE 'other' END endpoint_type", "l_orderkey % 3 <> 0 endpoint_met", "l_partkey % 5 <> 0 p_significant", "l_suppkey % 2 = 0 hard_to_treat", "l_linenumber % 2 = 0 single_arm", "l_orderkey % 29 = 0 rejected", "l_partkey % 4 = 0 elevates",
        "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.82 WHEN 2 THEN 0.83 WHEN 3 THEN 0.85 WHEN 4 THEN 0.86 ELSE 0.7 END hazard",
    )


def tier_decision(spark, folder):
    return _extractions(spark, folder).select("l_orderkey", "l_linenumber", rules.first_match(T.TIERS, T.DEFAULT_TIER).alias("tier"))


def notify_flag(spark, folder):
    rows = _extractions(spark, folder).select(rules.first_match(T.TIERS, T.DEFAULT_TIER).alias("tier"), "study_phase")
    return rows.groupBy("study_phase").agg(F.count_if(F.col("tier").isin("A", "B")).alias("notified"), F.count("*").alias("n"))


def guideline_gate(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "key_finding", "limitations", "confidence")
    concrete = F.exists(F.array("key_finding", "limitations"), lambda c: ~F.coalesce(c, F.lit("")).isin(T.BLANK_CHANGES))
    return rows.select("record_no", F.when(concrete & (F.col("confidence") == 1), "A").otherwise("NOISE").alias("tier"))


def recovered_by_tier(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "tier_code", "should_alert").where("should_alert")
    return rows.groupBy("tier_code").agg(F.count("*").alias("n"), F.min("record_no").alias("first_record"))


def cost_sums(spark, folder):
    return table(spark, folder, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("string").alias("total"))


def latest_run(spark, folder):
    rows = table(spark, folder, "candidates", "run_id", "ingested_at").groupBy("run_id").agg(F.max("ingested_at").alias("last"), F.count("*").alias("fetched"))
    return rows.orderBy(F.desc("last"), "run_id").limit(1).select("run_id", "fetched")


def fetched_kept(spark, folder):
    rows = table(spark, folder, "candidates", "journal", "pubtype_keep", "deterministic_relevance_score")
    return metrics.funnel(rows, "journal", {"fetched": "true", "kept": "pubtype_keep and deterministic_relevance_score >= 45"}).where("journal is not null")


QUERIES = {f.__name__: f for f in (lane_core, lane_main_query, lane_journals, lane_conferences, synthetic_ids, conference_tag, watchlists, short_text_enrichment, seen_preload, tier_decision, notify_flag, guideline_gate, recovered_by_tier, cost_sums, latest_run, fetched_kept)}

_w = lambda c, terms: f"regexp_matches({c}, {quoted(rules.any_word(terms))})"
_t = "concat_ws(chr(10), title, abstract)"
_core = f"(({_w(_t, ['breast', 'lung cancer'])} AND {_w(_t, TUMOR)}) OR coalesce(list_contains(mesh_terms, 'Breast Neoplasms'), false))"
_p = lambda names, by: f"[{', '.join(map(quoted, names))}][({by}) % {len(names)} + 1]"
_EXTRACT = f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {_p(T.PHASES, 'l_orderkey * 7 + l_linenumber * 13')} AS study_phase, {_p(T.DIRECTIONS, 'l_partkey')} AS direction, {_p(T.SIGNAL_TYPES, 'l_orderkey * 3 + l_partkey * 5 + l_suppkey')} AS signal_type, {_p(T.GATES, 'l_suppkey * 3 + l_linenumber')} AS gate,
  CASE WHEN l_partkey % 2 = 0 THEN 'overall_survival' ELSE 'other' END AS endpoint_type, l_orderkey % 3 <> 0 AS endpoint_met, l_partkey % 5 <> 0 AS p_significant, l_suppkey % 2 = 0 AS hard_to_treat, l_linenumber % 2 = 0 AS single_arm, l_orderkey % 29 = 0 AS rejected, l_partkey % 4 = 0 AS elevates,
  CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.82 WHEN 2 THEN 0.83 WHEN 3 THEN 0.85 WHEN 4 THEN 0.86 ELSE 0.7 END AS hazard FROM lineitem),
y AS (SELECT *, {rules.case_sql(T.TIERS, T.DEFAULT_TIER)} AS tier FROM x)"""  # fmt: skip

SQL = {
    "lane_core": f"SELECT candidate_id FROM candidates WHERE {_core}",
    "lane_main_query": f"""SELECT candidate_id FROM candidates WHERE {_core} AND {_w(_t, STUDY)} AND (coalesce(TRY_CAST(CASE WHEN regexp_matches(publication_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN publication_date END AS DATE) BETWEEN DATE '2023-01-01' AND DATE '2023-03-31', false) OR CAST(ingested_at AS DATE) BETWEEN DATE '2023-01-01' AND DATE '2023-03-31')""",
    "lane_journals": "SELECT candidate_id, ingested_at FROM (SELECT DISTINCT candidate_id, journal, ingested_at FROM candidates) WHERE lower(journal) IN ('annals of tumour medicine', 'review of tumour medicine') ORDER BY ingested_at DESC, candidate_id LIMIT 37",
    "lane_conferences": "SELECT candidate_id, conference_source FROM candidates WHERE conference_source IN ('ASCO', 'ESMO', 'ASTRO') AND list_contains(publication_types, 'Congress')",
    "synthetic_ids": "SELECT news_id, 'WS_' || substr(sha256(lower(title)), 1, 12) AS identifier FROM news_records",
    "conference_tag": "SELECT candidate_id, CASE WHEN contains(lower(journal), 'oncologic surgery') THEN 'SURG' WHEN contains(lower(journal), 'tumour medicine') THEN 'MED' WHEN contains(lower(journal), 'journal') THEN 'JOUR' END AS tag FROM candidates",
    "watchlists": "SELECT code, array_to_string(list_concat(watched_trials, ['EXTRA-1'], list_filter(free_text_core, lambda x: NOT list_contains(watched_trials, x) AND x <> 'EXTRA-1')), '|') AS watchlist FROM sites",
    "short_text_enrichment": "SELECT news_id, CAST(coalesce(length(CASE WHEN length(coalesce(abstract, '')) < 200 AND page IS NOT NULL THEN page ELSE abstract END), 0) AS INTEGER) AS characters FROM news_records LEFT JOIN (SELECT title, max(abstract) AS page FROM news_records WHERE length(abstract) >= 200 GROUP BY 1) p USING (title)",
    "seen_preload": "SELECT DISTINCT coalesce(nullif(trim(pmid), ''), 'title:' || substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 200)) AS seen_key FROM evidence_sources WHERE retrieved_at >= TIMESTAMP '2025-01-01' - INTERVAL 365 DAYS",
    "tier_decision": _EXTRACT + " SELECT l_orderkey, l_linenumber, tier FROM y",
    "notify_flag": _EXTRACT + " SELECT study_phase, count(*) FILTER (tier IN ('A', 'B')) AS notified, count(*) AS n FROM y GROUP BY 1",
    "guideline_gate": f"SELECT record_no, CASE WHEN confidence = 1 AND (coalesce(key_finding, '') NOT IN ({', '.join(map(quoted, T.BLANK_CHANGES))}) OR coalesce(limitations, '') NOT IN ({', '.join(map(quoted, T.BLANK_CHANGES))})) THEN 'A' ELSE 'NOISE' END AS tier FROM oncology_signals",
    "recovered_by_tier": "SELECT tier_code, count(*) AS n, min(record_no) AS first_record FROM oncology_signals WHERE should_alert GROUP BY 1",
    "cost_sums": "SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS VARCHAR) AS total FROM orders GROUP BY 1",
    "latest_run": "SELECT run_id, count(*) AS fetched FROM candidates GROUP BY 1 ORDER BY max(ingested_at) DESC, run_id LIMIT 1",
    "fetched_kept": "WITH g AS (SELECT journal, count(*) AS fetched, count(*) FILTER (pubtype_keep AND deterministic_relevance_score >= 45) AS kept FROM candidates WHERE journal IS NOT NULL GROUP BY 1) SELECT journal, stage, n FROM g UNPIVOT (n FOR stage IN (fetched, kept))",
}
