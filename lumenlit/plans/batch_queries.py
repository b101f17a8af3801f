"""Bypasses, records of other lanes, strict routing, calendar tags, sign-ups and audits over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import calendar, rules
from lumenlit.functions.rules import quoted
from lumenlit.operators import batch, changes, cluster, filters
from lumenlit.plans import rule_queries, serving_queries
from lumenlit.sources.tables import table


def relevance_bypass(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "mesh_terms", "journal", "conference_source", "force_keep_reason").distinct()
    scored = filters.relevance(F.col("title"), F.col("abstract"), F.col("mesh_terms"), rules.any_word(rule_queries.SITE_TERMS), rule_queries.MESH_TERMS, rules.any_word(rule_queries.MODALITY_TERMS), keep=45, low=25)
    excused = rules.names_match(F.lower(F.coalesce("journal", F.lit(""))), rule_queries.WHITELIST) | (F.coalesce("conference_source", F.lit("")) != "") | F.col("force_keep_reason").isNotNull()
    return rows.withColumn("r", batch.bypassed(scored, excused)).select("candidate_id", "r.score", "r.keep", "r.low_confidence")


def items(spark, folder):
    return batch.item_records(table(spark, folder, "fda_items", "fda_id", "title", "summary", "url", "pub_date").distinct(), "FDA", "FDA Hematology-Oncology", ["FDA Drug Approval"])


def item_records(spark, folder):
    return items(spark, folder).select("fda_id", "title", "abstract", "journal", "publication_date", F.element_at("publication_types", 1).alias("publication_type"), "text_hash", "conference_source")


def routed_items(spark, folder):
    sites = table(spark, folder, "sites", F.col("code").alias("site"), F.col("free_text_core").alias("terms"))
    return batch.strictly_routed(items(spark, folder), F.concat_ws(" ", "title", "abstract"), sites)


def strict_routing(spark, folder):
    return routed_items(spark, folder).select("fda_id", "text_hash", "site")


def canonical_items(spark, folder):
    """Items of a lane as candidates of each site they are routed to, with the modalities that their text names."""
    sites = table(spark, folder, "sites", F.col("code").alias("site"), F.col("name").alias("site_name"), "modality_terms")
    rows = routed_items(spark, folder).join(F.broadcast(sites), "site")
    named = filters.terms_present(F.concat_ws("\n", F.coalesce("title", F.lit("")), "abstract"), F.col("modality_terms"))
    kind = filters.classify_types(F.col("publication_types"))
    relevance = batch.bypassed(F.lit(None).cast("struct<score:int,keep:boolean,low_confidence:boolean,labels:array<string>>"), F.lit(True))
    return rows.withColumns({"kind": kind, "r": relevance}).select("fda_id", "text_hash", F.col("site").alias("cancer_site_code"), F.col("site_name").alias("cancer_site_name"), F.array_join(named, "|").alias("modality_keywords"), F.col("r.score").alias("relevance"), F.col("kind.keep").alias("pubtype_keep"), F.col("kind.low_priority").alias("pubtype_low_priority"), (F.coalesce("conference_source", F.lit("")) != "").alias("is_conference_abstract"))


def conference_calendar(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", F.to_date("ingested_at").alias("day"), F.try_to_date("publication_date", "yyyy-MM-dd").alias("published"), F.length("publication_date").alias("n")).where("n = 10").distinct()
    return batch.calendar_tags(rows, "published", "day").select("candidate_id", F.col("day").cast("string").alias("day"), "meeting")


def best_per_registration(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "nct_ids", "conference_source", "publication_types", "is_conference_abstract", "publication_date")
    rows = rows.withColumn("source", cluster.confidence_source(F.col("conference_source"), F.col("publication_types"), F.col("is_conference_abstract"))).withColumn("nct_id", F.explode("nct_ids"))
    return batch.most_trusted(rows.where("nct_id is not null"), "nct_id", "source", "publication_date", "candidate_id")


def identifier_union(spark, folder):
    lanes = table(spark, folder, "candidates", F.trim("pmid").alias("pmid")).unionByName(table(spark, folder, "evidence_sources", F.trim("pmid").alias("pmid")))
    return lanes.where("pmid <> ''").distinct()


def recovered_details(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "tier_code", "should_alert", "signal_title").where("should_alert")
    counts = rows.groupBy(F.col("tier_code").alias("tier")).agg(F.count("*").alias("of"))  # a row per tier
    return rows.join(F.broadcast(counts), F.col("tier_code").eqNullSafe(F.col("tier"))).select("tier_code", "of", "record_no", "signal_title")


def trial_name_list(spark, folder):
    names = table(spark, folder, "evidence_sources", F.upper(F.trim("trial_name")).alias("name")).where("name rlike '^[A-Z]+-[0-9]+$'")
    return names.distinct().orderBy("name")


def short_line_names(spark, folder):
    rows = table(spark, folder, "news_records", "abstract", "title").select(F.explode(F.array_union(batch.short_lines(F.col("abstract")), batch.short_lines(F.col("title")))).alias("name"))
    return rows.distinct()


def audit_actor(spark, folder):
    """The change log with its actor: who approved, else who rejected, else the session's own."""
    log = changes.change_log(*serving_queries.versions(spark, folder), "o_orderkey", ["o_orderpriority", "o_orderstatus"])
    people = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr("o_orderkey", "o_orderdate", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END approved_by", "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 END rejected_by", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 2 END session")
    return changes.with_actor(log.where("operation = 'update'").join(people, "o_orderkey"), "approved_by", "rejected_by", "session")


def audit_actors(spark, folder):
    return audit_actor(spark, folder).select("o_orderkey", "operation", "actor")


def audit_recent(spark, folder):
    """The newest hundred entries of the change log, with the record changed and the address of who did it."""
    subjects = table(spark, folder, "orders", "o_orderkey", "o_totalprice")
    found = audit_actor(spark, folder).join(subjects, "o_orderkey").join(serving_queries.users(spark, folder).select(F.col("user_id").alias("actor"), "email"), "actor", "left")
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice", "operation", "email")


def corrections_audit(spark, folder):
    rows = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").where("o_orderkey % 13 = 0")
    return changes.correction_entries(rows, "o_orderkey", "o_custkey", "o_orderpriority", ["o_orderstatus"])


def sign_up_links(spark, folder):
    return changes.linked(serving_queries.users(spark, folder), "user_id", "email", serving_queries.accounts(spark, folder), "account_id", "email").select("user_id", "account_id")


def sign_up_profiles(spark, folder):
    accounts = serving_queries.accounts(spark, folder).select("account_id")
    known = accounts.where("account_id % 2 = 0").withColumn("origin", F.lit("kept"))
    return changes.inserted_if_absent(known, accounts.withColumn("origin", F.lit("created")), ["account_id"])


def push_tokens(spark, folder):
    rows = table(spark, folder, "customer", "c_custkey").select(F.col("c_custkey").alias("user_id"), F.element_at(F.array(F.lit("email"), F.lit("push"), F.lit("both")), (F.col("c_custkey") % 3).cast("int") + 1).alias("delivery"), F.lit("old").alias("push_token"), F.lit(True).alias("verified"))
    action = F.element_at(F.array(F.lit("store"), F.lit("clear"), F.lit("unsubscribe"), F.lit(None).cast("string")), (F.col("user_id") % 4).cast("int") + 1)
    return changes.subscriber_action(rows, action, F.concat(F.lit("t"), "user_id"))


def touched_rows(spark, folder):
    old, new = serving_queries.versions(spark, folder)
    return changes.touched(old.withColumn("updated", F.lit("2024-01-01")), new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], "updated", F.lit("2025-01-01")).select("o_orderkey", "updated")


QUERIES = {f.__name__: f for f in (relevance_bypass, item_records, strict_routing, canonical_items, conference_calendar, best_per_registration, identifier_union, recovered_details, trial_name_list, short_line_names, audit_actors, audit_recent, corrections_audit, sign_up_links, sign_up_profiles, push_tokens, touched_rows)}

_rank = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in V.CONFIDENCE_RANK.items())
_meetings = ", ".join(f"({i}, {quoted(c)}, {m}, {w})" for i, (c, m, w) in enumerate(V.MEETINGS))
_ITEMS = """
WITH item AS (SELECT fda_id, title, coalesce(summary, '') AS abstract, pub_date AS publication_date, sha256('FDA|' || coalesce(url, '') || '|' || coalesce(title, '')) AS text_hash FROM (SELECT DISTINCT fda_id, title, summary, url, pub_date FROM fda_items)),
routed AS (SELECT item.*, s.code AS site, s.name AS site_name, s.modality_terms FROM item, sites s WHERE len(s.free_text_core) = 0 OR len(list_filter(s.free_text_core, lambda t: contains(lower(concat_ws(' ', title, abstract)), lower(t)))) > 0)"""
_ACTORS = serving_queries._VERSIONS + """,
log AS (SELECT o_orderkey, 'update' AS operation FROM pair WHERE NOT added AND NOT gone AND (op IS DISTINCT FROM np OR os IS DISTINCT FROM ns)),
acted AS (SELECT log.*, o_orderdate, o_totalprice, CASE WHEN o.o_orderkey % 3 = 0 THEN o_custkey WHEN o.o_orderkey % 7 = 0 THEN o_custkey + 1 WHEN o.o_orderkey % 2 = 0 THEN o_custkey + 2 END AS actor FROM log JOIN orders o USING (o_orderkey))"""

SQL = {
    "relevance_bypass": rule_queries.SQL["relevance_score"].replace("SELECT candidate_id, coalesce(title, '') AS title,", f"SELECT candidate_id, {rule_queries._names(chr(34) + 'low' + chr(34), rule_queries.WHITELIST)} OR coalesce(conference_source, '') <> '' OR force_keep_reason IS NOT NULL AS excused, coalesce(title, '') AS title,").replace("mesh_terms FROM candidates)", "mesh_terms FROM (SELECT DISTINCT candidate_id, title, abstract, mesh_terms, journal, conference_source, force_keep_reason, lower(coalesce(journal, '')) AS low FROM candidates))").replace("s AS (SELECT candidate_id,", "s AS (SELECT candidate_id, excused,").replace("SELECT candidate_id, CAST(score AS INTEGER) AS score, score >= 25 AS keep, score >= 25 AND score < 45 AS low_confidence FROM s", "SELECT candidate_id, CAST(CASE WHEN excused THEN 70 ELSE score END AS INTEGER) AS score, excused OR score >= 25 AS keep, NOT excused AND score >= 25 AND score < 45 AS low_confidence FROM s"),
    "item_records": _ITEMS + " SELECT fda_id, title, abstract, 'FDA Hematology-Oncology' AS journal, publication_date, 'FDA Drug Approval' AS publication_type, text_hash, 'FDA' AS conference_source FROM item",
    "strict_routing": _ITEMS + " SELECT fda_id, text_hash, site FROM routed",
    "canonical_items": _ITEMS + f""" SELECT fda_id, text_hash, site AS cancer_site_code, site_name AS cancer_site_name, array_to_string(list_slice(list_filter(modality_terms, lambda t: contains(lower(coalesce(title, '') || chr(10) || abstract), lower(t))), 1, 12), '|') AS modality_keywords,
  70 AS relevance, {'fda drug approval' in V.KEEP_TYPES or 'fda drug approval' not in V.DROP_TYPES} AS pubtype_keep, {'fda drug approval' not in V.KEEP_TYPES} AS pubtype_low_priority, true AS is_conference_abstract FROM routed""",
    "conference_calendar": f"""
WITH m(place, meeting, mon, leeway) AS (VALUES {_meetings}), r AS (SELECT DISTINCT candidate_id, CAST(ingested_at AS DATE) AS day, TRY_CAST(publication_date AS DATE) AS published FROM candidates WHERE regexp_matches(publication_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')),
p AS (SELECT day, place, meeting, leeway, max(make_date(y, mon, 1)) AS pub FROM (SELECT DISTINCT day FROM r) d, m, (SELECT unnest([0, 1]) AS back), LATERAL (SELECT year(day) - back AS y) WHERE day - make_date(y, mon, 1) BETWEEN 0 AND 35 + leeway GROUP BY ALL),
w AS (SELECT day, place, meeting, CAST(pub - CAST(leeway AS INTEGER) AS DATE) AS first, least(CAST(pub + 35 AS DATE), day) AS last FROM p)
SELECT candidate_id, CAST(r.day AS VARCHAR) AS day, arg_min(meeting, place) AS meeting FROM r JOIN w ON w.day = r.day AND published BETWEEN first AND last GROUP BY candidate_id, r.day, published""",
    "best_per_registration": f"""
WITH c AS ({rule_queries.SQL["confidence_source"].replace("SELECT candidate_id,", "SELECT candidate_id, publication_date, unnest(nct_ids) AS nct_id,", 1)})
SELECT nct_id, arg_min(candidate_id, (-(CASE confidence_source {_rank} ELSE 0 END), coalesce(nullif(publication_date, ''), '9999-99-99'), candidate_id)) AS candidate_id FROM c WHERE nct_id IS NOT NULL GROUP BY 1""",
    "identifier_union": "SELECT trim(pmid) AS pmid FROM candidates WHERE trim(pmid) <> '' UNION SELECT trim(pmid) FROM evidence_sources WHERE trim(pmid) <> ''",
    "recovered_details": "SELECT tier_code, count(*) OVER (PARTITION BY tier_code) AS of, record_no, signal_title FROM oncology_signals WHERE should_alert",
    "trial_name_list": "SELECT DISTINCT upper(trim(trial_name)) AS name FROM evidence_sources WHERE regexp_matches(upper(trim(trial_name)), '^[A-Z]+-[0-9]+$') ORDER BY 1",
    "short_line_names": "SELECT DISTINCT line AS name FROM (SELECT regexp_replace(part, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g') AS line FROM (SELECT unnest(string_split_regex(coalesce(abstract, ''), '[\\n.;]')) AS part FROM news_records UNION ALL SELECT unnest(string_split_regex(coalesce(title, ''), '[\\n.;]')) FROM news_records)) WHERE regexp_matches(line, '[A-Z]{3}') AND len(string_split_regex(line, '\\s+')) <= 4",
    "audit_actors": _ACTORS + " SELECT o_orderkey, operation, actor FROM acted",
    "audit_recent": _ACTORS + " SELECT o_orderkey, o_totalprice, operation, 'User' || c_custkey || '@Mail.example' AS email FROM acted LEFT JOIN customer ON c_custkey = actor ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "corrections_audit": "SELECT o_orderkey, o_custkey AS actor, 'corrected' AS action, CAST(json_object('note', o_orderpriority, 'patched_fields', json_object('o_orderstatus', o_orderstatus)) AS VARCHAR) AS diff FROM orders WHERE o_orderkey % 13 = 0",
    "sign_up_links": serving_queries._FEED + " SELECT user_id, min(account_id) AS account_id FROM users LEFT JOIN accounts ON address = lower(email) GROUP BY 1",
    "sign_up_profiles": serving_queries._FEED + " SELECT account_id, CASE WHEN account_id % 2 = 0 THEN 'kept' ELSE 'created' END AS origin FROM accounts",
    "push_tokens": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'both' ELSE ['email', 'push', 'both'][c_custkey % 3 + 1] END AS delivery, CASE c_custkey % 4 WHEN 0 THEN 't' || c_custkey WHEN 1 THEN NULL ELSE 'old' END AS push_token, c_custkey % 4 <> 2 AS verified FROM customer",
    "touched_rows": serving_queries._VERSIONS + " SELECT o_orderkey, CASE WHEN added OR (NOT gone AND (op IS DISTINCT FROM np OR os IS DISTINCT FROM ns)) THEN '2025-01-01' ELSE '2024-01-01' END AS updated FROM pair",
}
