"""Entity resolution, ranking and clustering over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules
from lumenlit.functions.rules import quoted
from lumenlit.functions.text import content_tokens
from lumenlit.operators import cluster, dedupe, metrics, ranking
from lumenlit.sources.tables import table


def hard_dedupe(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "pmid", "doi", "abstract", "journal", "ingested_at")
    rows = rows.withColumn("quality", dedupe.quality(F.col("abstract"), F.lit(None).cast("string"), F.col("journal"))).withColumn("ord", F.struct("ingested_at", "candidate_id"))
    return dedupe.hard_dedupe(rows, "quality", "ord").select("candidate_id", "pmid", "doi")


def best_per_trial(spark, folder):
    rows = table(spark, folder, "evidence_sources", "evidence_id", "trial_name", "source_type", "pmid")
    key = F.nullif(F.lower(F.trim("trial_name")), F.lit(""))
    order = [cluster.source_priority(F.col("source_type")), F.expr("try_cast(trim(pmid) as bigint)").asc_nulls_last(), F.col("evidence_id")]
    return dedupe.best_per_key(rows, [key], order).select("evidence_id")


def latest_per_signal(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "signal_id", "updated_at")
    return dedupe.best_per_key(rows, [F.col("signal_id")], [F.col("updated_at").desc_nulls_last(), F.col("record_no")]).select("signal_id", "record_no")


def first_source_wins(spark, folder):
    news = table(spark, folder, "news_records", "url", "title", "fetched_at").withColumn("lane", F.lit(1))
    fda = table(spark, folder, "fda_items", "url", "title", "fetched_at").withColumn("lane", F.lit(0))
    rows = fda.unionByName(news)
    return dedupe.best_per_key(rows, [F.nullif(F.trim("url"), F.lit(""))], [F.col("lane"), F.col("fetched_at"), F.col("title")]).select("url", "lane", "fetched_at")


def first_site_claim(spark, folder):
    sites = table(spark, folder, "sites", F.col("code").alias("cancer_site_code"), "site_ord")
    rows = table(spark, folder, "candidates", "candidate_id", "pmid", "cancer_site_code").join(F.broadcast(sites), "cancer_site_code").where("coalesce(pmid, '') <> ''").distinct()
    return dedupe.first_claim(rows, "pmid", "site_ord", "candidate_id").select("pmid", "candidate_id", "cancer_site_code")


def unseen_records(spark, folder):
    keyed = lambda df: df.withColumn("seen_key", dedupe.seen_key(F.col("pmid"), F.col("title")))
    seen = keyed(table(spark, folder, "evidence_sources", "pmid", "title"))
    return dedupe.unseen(keyed(table(spark, folder, "candidates", "candidate_id", "pmid", "title")), seen, "seen_key").select("candidate_id")


def cross_event_suppress(spark, folder):
    evidence = table(spark, folder, "evidence_sources", "evidence_id", "trial_name", "source_type")
    prior = evidence.where("upper(trim(source_type)) = 'FDA'")
    return dedupe.suppress(evidence, prior, "trial_name", F.upper(F.trim("source_type")) == "FDA").select("evidence_id")


def token_jaccard_gap(spark, folder):
    tokens = content_tokens(F.col("title"))
    wanted = table(spark, folder, "fda_items", F.col("fda_id").alias("id"), "title", "fetched_at").select("id", tokens.alias("tokens")).dropDuplicates(["id"])
    present = table(spark, folder, "oncology_signals", F.col("record_no").alias("id"), F.col("signal_title").alias("title")).select("id", tokens.alias("tokens"))
    return dedupe.title_gaps(wanted, present, "id", "tokens").select(F.col("id").alias("fda_id"))


def fuzzy_title_dedupe(spark, folder):
    rows = table(spark, folder, "news_records", "news_id", "title", "abstract", "pub_date").dropDuplicates(["news_id"])
    return dedupe.fuzzy_dedupe(rows.withColumn("text", F.col("abstract")), "news_id", title="text").select("news_id")


def null_name_dedupe(spark, folder):
    rows = table(spark, folder, "evidence_sources", "evidence_id", "trial_name", "title")
    return dedupe.trial_dedupe(rows, "trial_name", "title", "evidence_id").select("evidence_id")


def cap_global(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "tier_code", "novelty_score").where("tier_code <> 'NOISE'")
    return ranking.capped(rows, "tier_code", "novelty_score", "record_no", 400).select("record_no", "tier_code")


def cap_per_site(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "disease_site", "tier_code", "novelty_score").where("tier_code <> 'NOISE'")
    return ranking.capped(rows, "tier_code", "novelty_score", "record_no", 20, within="disease_site").select("record_no", "disease_site", "tier_code")


def ranked_no_signal(spark, folder):
    scores = table(spark, folder, "signal_scores", "candidate_id", "qualifying_signal", "rejection_reason", "score", "scored_at").where("qualifying_signal = 'NONE'").dropDuplicates()
    order = [F.col("score").desc_nulls_last(), F.col("candidate_id"), F.col("scored_at")]
    return ranking.ranked(scores, order, ["rejection_reason"]).select("candidate_id", "scored_at", "place")


def feed_page(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "tier_code", "updated_at")
    return ranking.page(rows, [F.col("updated_at").desc_nulls_last(), F.col("record_no")], 50, 100)


def signal_cluster(spark, folder):
    evidence = table(spark, folder, "evidence_sources", "evidence_id", "trial_name", "source_type", "journal", "title")
    keyed = evidence.withColumn("cluster_key", cluster.cluster_key(F.col("trial_name"), F.col("journal"), F.lit(""), F.col("title"), F.lit("")))
    return cluster.signals(keyed, "cluster_key", "evidence_id")


def signal_order(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "practice_impact_level", "signal_type", "disease_site")
    order = cluster.signal_order(F.col("practice_impact_level"), F.col("signal_type"), F.col("record_no"))
    return ranking.ranked(rows, order, ["disease_site"]).select("record_no", "place")


def signal_type_fallback(spark, folder):
    scores = table(spark, folder, "signal_scores", "candidate_id", "qualifying_signal", "scored_at")
    return scores.select("candidate_id", "scored_at", cluster.signal_type(F.lit("OTHER"), F.col("qualifying_signal")).alias("signal_type"))


def setting_names(spark, folder):
    return table(spark, folder, "oncology_signals", "record_no", "setting").select("record_no", cluster.setting_name(F.col("setting")).alias("setting_name"))


def tier_histogram(spark, folder):
    return metrics.histogram(table(spark, folder, "oncology_signals", "tier_code"), "tier_code", ["A", "B", "C", "NOISE", "HELD"])


def trial_names(spark, folder):
    names = table(spark, folder, "evidence_sources", F.trim("trial_name").alias("name"), "source_type").where("name rlike '^[A-Z]+-[0-9]+$'")
    return names.groupBy(F.upper(F.trim("source_type")).alias("source_type")).agg(F.count_distinct("name").alias("names"), F.min("name").alias("first_name"))


def comment_counts(spark, folder):
    comments = table(spark, folder, "comments", "comment_id", "alert_id").distinct()
    wanted = comments.select("alert_id")  # every alert that has comments
    return metrics.counts_for(comments, "alert_id", wanted)


def source_counts(spark, folder):
    news = table(spark, folder, "news_records", F.col("source_key").alias("lane"))
    return metrics.histogram(news.unionByName(table(spark, folder, "fda_items", F.col("source").alias("lane"))), "lane")


QUERIES = {f.__name__: f for f in (hard_dedupe, best_per_trial, latest_per_signal, first_source_wins, first_site_claim, unseen_records, cross_event_suppress, token_jaccard_gap, fuzzy_title_dedupe, null_name_dedupe, cap_global, cap_per_site, ranked_no_signal, feed_page, signal_cluster, signal_order, signal_type_fallback, setting_names, tier_histogram, trial_names, comment_counts, source_counts)}

_rank = "CASE WHEN coalesce(journal, '') = '' THEN 127 " + " ".join(f"WHEN lower(journal) = {quoted(n)} THEN {i}" for i, n in enumerate(V.JOURNAL_RANK)) + " " + " ".join(f"WHEN contains(lower(journal), {quoted(n)}) OR contains({quoted(n)}, lower(journal)) THEN {i}" for i, n in enumerate(V.JOURNAL_RANK)) + " ELSE 127 END"
_priority = "CASE upper(trim(source_type)) " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in V.SOURCE_PRIORITY.items()) + " ELSE 9 END"
_seen = "coalesce(nullif(trim(pmid), ''), 'title:' || substr(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), 1, 200))"
_tokens = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' '), lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(quoted, V.TITLE_STOPWORDS))})))"
_plain = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"

SQL = {
    "hard_dedupe": f"""
WITH q AS (SELECT *, CASE WHEN coalesce(abstract, '') <> '' THEN 50 ELSE 0 END + greatest(0, 50 - ({_rank})) AS quality, nullif(pmid, '') AS k, nullif(lower(trim(doi)), '') AS d FROM candidates),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ingested_at, candidate_id) AS n FROM q),
b AS (SELECT * FROM a WHERE k IS NULL OR n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY quality DESC, ingested_at, candidate_id) AS m FROM b)
SELECT candidate_id, pmid, doi FROM c WHERE d IS NULL OR m = 1""",
    "best_per_trial": f"""
SELECT evidence_id FROM (SELECT evidence_id, nullif(lower(trim(trial_name)), '') AS k, row_number() OVER (PARTITION BY nullif(lower(trim(trial_name)), '') ORDER BY {_priority}, TRY_CAST(trim(pmid) AS BIGINT) NULLS LAST, evidence_id) AS n FROM evidence_sources) WHERE k IS NULL OR n = 1""",
    "latest_per_signal": "SELECT signal_id, record_no FROM (SELECT signal_id, record_no, row_number() OVER (PARTITION BY signal_id ORDER BY updated_at DESC NULLS LAST, record_no) AS n FROM oncology_signals) WHERE signal_id IS NULL OR n = 1",
    "first_source_wins": """
WITH u AS (SELECT url, title, fetched_at, 0 AS lane FROM fda_items UNION ALL SELECT url, title, fetched_at, 1 FROM news_records)
SELECT url, CAST(lane AS INTEGER) AS lane, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY nullif(trim(url), '') ORDER BY lane, fetched_at, title) AS n FROM u) WHERE nullif(trim(url), '') IS NULL OR n = 1""",
    "first_site_claim": """
SELECT pmid, candidate_id, cancer_site_code FROM (
  SELECT DISTINCT pmid, candidate_id, cancer_site_code, row_number() OVER (PARTITION BY pmid ORDER BY site_ord, candidate_id) AS n
  FROM (SELECT DISTINCT pmid, candidate_id, cancer_site_code, site_ord FROM candidates JOIN sites ON code = cancer_site_code WHERE coalesce(pmid, '') <> '')) WHERE n = 1""",
    "unseen_records": f"SELECT candidate_id FROM (SELECT candidate_id, {_seen} AS k FROM candidates) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_seen} AS k FROM evidence_sources) e WHERE e.k = c.k)",
    "cross_event_suppress": """
SELECT evidence_id FROM evidence_sources WHERE coalesce(upper(trim(source_type)) = 'FDA', false) OR coalesce(lower(trim(trial_name)), '') = ''
  OR lower(trim(trial_name)) NOT IN (SELECT lower(trim(trial_name)) FROM evidence_sources WHERE upper(trim(source_type)) = 'FDA' AND trial_name IS NOT NULL)""",
    "token_jaccard_gap": f"""
WITH w AS (SELECT fda_id, any_value({_tokens('title')}) AS t FROM fda_items GROUP BY 1), p AS (SELECT DISTINCT {_tokens('signal_title')} AS t FROM oncology_signals)
SELECT fda_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE len(list_intersect(w.t, p.t)) >= 0.35 * (len(w.t) + len(p.t) - len(list_intersect(w.t, p.t))) AND len(w.t) > 0 AND len(p.t) > 0)""",
    "cap_global": """
WITH s AS (SELECT * FROM oncology_signals WHERE tier_code <> 'NOISE'),
r AS (SELECT *, row_number() OVER (ORDER BY tier_code, novelty_score DESC NULLS LAST, record_no) AS n FROM s WHERE tier_code <> 'A')
SELECT record_no, tier_code FROM s WHERE tier_code = 'A' UNION ALL SELECT record_no, tier_code FROM r WHERE n <= 400 - (SELECT count(*) FROM s WHERE tier_code = 'A')""",
    "cap_per_site": """
WITH s AS (SELECT * FROM oncology_signals WHERE tier_code <> 'NOISE'),
r AS (SELECT *, row_number() OVER (PARTITION BY disease_site ORDER BY tier_code, novelty_score DESC NULLS LAST, record_no) AS n FROM s WHERE tier_code <> 'A'),
a AS (SELECT disease_site, count(*) AS k FROM s WHERE tier_code = 'A' GROUP BY 1)
SELECT record_no, disease_site, tier_code FROM s WHERE tier_code = 'A' UNION ALL SELECT r.record_no, r.disease_site, r.tier_code FROM r LEFT JOIN a USING (disease_site) WHERE n <= 20 - coalesce(k, 0)""",
    "ranked_no_signal": "SELECT candidate_id, scored_at, CAST(row_number() OVER (PARTITION BY rejection_reason ORDER BY score DESC NULLS LAST, candidate_id, scored_at) AS INTEGER) AS place FROM (SELECT DISTINCT candidate_id, scored_at, score, rejection_reason FROM signal_scores WHERE qualifying_signal = 'NONE')",
    "feed_page": "SELECT record_no, tier_code, updated_at FROM oncology_signals ORDER BY updated_at DESC NULLS LAST, record_no LIMIT 50 OFFSET 100",
    "signal_cluster": f"""
WITH n AS (SELECT evidence_id, upper(trim(coalesce(trial_name, ''))) AS name, {_plain('journal')} AS site, {_plain('title')} AS words, {_priority} AS priority, upper(trim(source_type)) AS kind FROM evidence_sources),
k AS (SELECT *, CASE WHEN name NOT IN ('', 'NULL', 'NONE', 'NOT_REPORTED', 'NOT REPORTED', 'N/A') THEN 'trial:' || name
  ELSE 'signal:' || substr(md5(site || '|other|' || array_to_string(list_slice(string_split(words, ' '), 1, 4), ' ') || '|'), 1, 16) END AS cluster_key FROM n),
g AS (SELECT cluster_key, kind, priority, count(*) AS c, min(evidence_id) AS first_id FROM k GROUP BY ALL)
SELECT cluster_key, CAST(sum(c) AS BIGINT) AS sources, (list(first_id ORDER BY priority, first_id))[1] AS primary_id, (list(kind ORDER BY priority, first_id))[1] AS primary_type,
  array_to_string(list_slice(list(coalesce(kind, '') ORDER BY priority, coalesce(kind, '')), 1, 3), ' + ') AS label FROM g GROUP BY 1""",
    "signal_order": "SELECT record_no, CAST(row_number() OVER (PARTITION BY disease_site ORDER BY practice_impact_level NULLS LAST, CASE signal_type " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in V.SIGNAL_TYPE_PRIORITY.items()) + " ELSE 40 END DESC, record_no) AS INTEGER) AS place FROM oncology_signals",
    "signal_type_fallback": "SELECT candidate_id, scored_at, CASE qualifying_signal " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.SIGNAL_TYPE_OF_GATE.items()) + " ELSE 'OTHER' END AS signal_type FROM signal_scores",
    "setting_names": "SELECT record_no, CASE setting " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.SETTING_NAMES.items()) + " ELSE 'localized' END AS setting_name FROM oncology_signals",
    "tier_histogram": "SELECT v.tier_code, count(s.record_no) AS n FROM (SELECT unnest(['A', 'B', 'C', 'NOISE', 'HELD']) AS tier_code) v LEFT JOIN oncology_signals s ON s.tier_code = v.tier_code GROUP BY 1",
    "trial_names": "SELECT upper(trim(source_type)) AS source_type, count(DISTINCT trim(trial_name)) AS names, min(trim(trial_name)) AS first_name FROM evidence_sources WHERE regexp_matches(trim(trial_name), '^[A-Z]+-[0-9]+$') GROUP BY 1",
    "comment_counts": "SELECT alert_id, count(DISTINCT comment_id) AS n FROM comments WHERE alert_id IS NOT NULL GROUP BY 1",
    "source_counts": "SELECT lane, count(*) AS n FROM (SELECT source_key AS lane FROM news_records UNION ALL SELECT source FROM fda_items) GROUP BY 1",
}
