"""Filters, rules and gates over the candidates and their sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules
from lumenlit.functions.rules import quoted
from lumenlit.operators import cluster, filters, gates, metrics
from lumenlit.sources.tables import table

GATE_COLUMNS = ("candidate_id", "title", "abstract", "journal", "conference_source", "publication_types")
WHITELIST = ["annals of tumour medicine", "archives of tumour medicine", "northmere journal"]


def gated(spark: SparkSession, folder: str) -> DataFrame:
    watched = table(spark, folder, "sites", "watched_trials").select(F.explode("watched_trials").alias("trial"))
    return gates.gate(table(spark, folder, "candidates", *GATE_COLUMNS), watched)


def hard_exclude(spark, folder):
    return gated(spark, folder).select("candidate_id", "hard_excluded", "exclusion_reason")


def gate_signal(spark, folder):
    return gated(spark, folder).select("candidate_id", "qualifying_signal", "rejection_reason")


def gate_score(spark, folder):
    return gated(spark, folder).select("candidate_id", "signal_score", F.array_join("signal_labels", "; ").alias("labels"))


def reason_histogram(spark, folder):
    return metrics.histogram(gated(spark, folder).where("rejection_reason is not null"), "rejection_reason")


def signal_histogram(spark, folder):
    return metrics.histogram(gated(spark, folder), "qualifying_signal", [*V.SIGNAL_BASE, "NONE"])


def pubtype_decision(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "publication_types").withColumn("d", filters.classify_types(F.col("publication_types")))
    return rows.select("candidate_id", "d.keep", "d.low_priority", "d.rationale")


def pubtype_filter(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "publication_types", "conference_source", "journal")
    return filters.filter_types(rows, WHITELIST).select("candidate_id", "pubtype.low_priority", "pubtype.rationale")


def journal_rank(spark, folder):
    ranks = ["annals of tumour medicine", "archives of tumour medicine", "review of tumour medicine", "tumour medicine", "radiation practice"]
    return table(spark, folder, "candidates", "candidate_id", "journal").select("candidate_id", rules.name_rank(F.lower("journal"), ranks, 105).alias("journal_rank"))


def whitelist_bidirectional(spark, folder):
    return table(spark, folder, "candidates", "candidate_id", "journal").select("candidate_id", rules.names_match(F.lower(F.coalesce("journal", F.lit(""))), WHITELIST).alias("listed"))


SITE_TERMS = ["breast", "lung", "colorectal"]
MODALITY_TERMS = ["chemotherapy", "radiotherapy", "immunotherapy", "proton therapy"]
MESH_TERMS = ["Breast Neoplasms", "Lung Neoplasms"]


def relevance_score(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "mesh_terms")
    r = filters.relevance(F.col("title"), F.col("abstract"), F.col("mesh_terms"), rules.any_word(SITE_TERMS), MESH_TERMS, rules.any_word(MODALITY_TERMS), keep=45, low=25)
    return rows.withColumn("r", r).select("candidate_id", "r.score", "r.keep", "r.low_confidence")


def force_keep(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "conference_source", "journal")
    listed = rules.names_match(F.lower(F.coalesce("journal", F.lit(""))), WHITELIST)
    return rows.select("candidate_id", F.when(F.col("conference_source") == "FDA", "fda_approval").when(listed, "tier1_journal").alias("force_keep_reason"))


def language_filter(spark, folder):
    return table(spark, folder, "documents", "doc_id", "lang").where(filters.in_language(F.col("lang"))).select("doc_id")


def abstract_required(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "abstract", "conference_source")
    return rows.where(filters.has_text(F.col("abstract"), F.col("conference_source") == "FDA")).select("candidate_id")


def threshold_route(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "deterministic_relevance_score", "pubtype_keep")
    rows = rows.selectExpr("candidate_id", "deterministic_relevance_score AS relevance", "coalesce(pubtype_keep, false) AS keep", "deterministic_relevance_score - 10 AS review_score", "deterministic_relevance_score % 3 = 0 AS force_keep", "true AS site_correct")
    rows = rows.withColumn("hint", F.expr(gates.priority_hint("relevance"))).withColumn("score", F.col("review_score"))
    return rows.select("candidate_id", F.expr(gates.route_without_signal()).alias("route"), "hint", F.expr(gates.keep_decision()).alias("decision"))


def site_routing(spark, folder):
    terms = table(spark, folder, "sites", "code", "free_text_core").select(F.col("code").alias("site"), F.explode("free_text_core").alias("term"))
    rows = table(spark, folder, "candidates", "candidate_id", "title", "cancer_site_code")
    return filters.routed(rows, "title", terms, "candidate_id", "cancer_site_code").select("candidate_id", "cancer_site_code")


def site_lists(spark: SparkSession, folder: str, column: str) -> list[tuple[str, list[str]]]:
    """The sites' terms in site order: a dimension of eleven rows."""
    return [(r.code, list(r[column])) for r in table(spark, folder, "sites", "code", "site_ord", column).orderBy("site_ord").collect()]


def site_infer_argmax(spark, folder):
    rows = table(spark, folder, "fda_items", "fda_id", "title", "summary")
    text = F.concat_ws(" ", "title", "summary")
    return rows.select("fda_id", filters.inferred_site(text, site_lists(spark, folder, "tumor_terms"), "hematologic").alias("site"))


def site_first_match(spark, folder):
    rows = table(spark, folder, "news_records", "news_id", "abstract")
    return rows.select("news_id", filters.first_site(F.col("abstract"), site_lists(spark, folder, "tumor_terms")).alias("site"))


def modality_keywords(spark, folder):
    sites = table(spark, folder, "sites", F.col("code").alias("cancer_site_code"), "modality_terms")
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "cancer_site_code").join(F.broadcast(sites), "cancer_site_code")
    text = F.concat_ws("\n", "title", "abstract")
    return rows.select("candidate_id", F.array_join(filters.terms_present(text, F.col("modality_terms")), "|").alias("keywords"))


CONFERENCE_HIGH = r"(?i)\b(late.breaking|plenary|presidential|phase\s+(iii|3)|overall\s+survival|randomi[sz]ed)\b"
CLINICAL = r"(?i)\b(trial|randomi[sz]ed|phase\s+(i|ii|iii|iv|1|2|3|4)|overall\s+survival|hazard\s+ratio|guideline|approval|chemotherapy|radiotherapy|adjuvant|metastatic)\b"


def conference_strata(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "is_conference_abstract").where("is_conference_abstract")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return rows.select("candidate_id", F.when(text.rlike(CONFERENCE_HIGH), "MAJOR_CONFERENCE_HIGH").otherwise("MAJOR_CONFERENCE_LOW").alias("stratum"))


def journal_guardrail(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "deterministic_relevance_score")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    reason = F.when(F.col("deterministic_relevance_score") >= 35, "relevance").when(text.rlike(CLINICAL), "clinical_language").otherwise("failed")
    return rows.select("candidate_id", reason.alias("reason"))


def confidence_source(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "conference_source", "publication_types", "is_conference_abstract")
    return rows.select("candidate_id", cluster.confidence_source(F.col("conference_source"), F.col("publication_types"), F.col("is_conference_abstract")).alias("confidence_source"))


def source_type(spark, folder):
    return table(spark, folder, "candidates", "candidate_id", "conference_source").select("candidate_id", cluster.source_type_of(F.col("conference_source")).alias("source_type"))


def funnel_counts(spark, folder):
    rows = table(spark, folder, "candidates", "cancer_site_code", "abstract", "pubtype_keep", "deterministic_relevance_score", "force_keep_reason")
    stages = {"fetched": "true", "with_abstract": "coalesce(trim(abstract), '') <> ''", "type_kept": "pubtype_keep", "relevant": "deterministic_relevance_score >= 45", "forced": "force_keep_reason is not null"}
    return metrics.funnel(rows, "cancer_site_code", stages)


def journal_top30(spark, folder):
    return metrics.top_values(table(spark, folder, "candidates", "journal"), "journal", 30)


QUERIES = {f.__name__: f for f in (hard_exclude, gate_signal, gate_score, reason_histogram, signal_histogram, pubtype_decision, pubtype_filter, journal_rank, whitelist_bidirectional, relevance_score, force_keep, language_filter, abstract_required, threshold_route, site_routing, site_infer_argmax, site_first_match, modality_keywords, conference_strata, journal_guardrail, confidence_source, source_type, funnel_counts, journal_top30)}

_GATE = f"""
WITH watch AS (SELECT DISTINCT lower(trim(unnest(watched_trials))) AS t FROM sites),
prepared AS (
  SELECT candidate_id, lower(coalesce(title, '')) AS title_, lower(coalesce(title, '') || chr(10) || coalesce(abstract, '')) AS text_, lower(trim(coalesce(journal, ''))) AS journal_,
    upper(coalesce(conference_source, '')) AS source_, lower(coalesce(array_to_string(publication_types, '|'), '')) AS types_ FROM candidates),
watched AS (SELECT *, len(list_intersect(regexp_extract_all(text_, '([a-z0-9]+(?:-[a-z0-9]+)*)', 1), (SELECT list(t) FROM watch))) > 0 AS watched_ FROM prepared),
excluded AS (SELECT *, trim(coalesce(nullif(regexp_extract(text_, {quoted(V.HARD_EXCLUDE)}, 0), ''), nullif(regexp_extract(title_, {quoted(V.HARD_EXCLUDE_TITLE)}, 0), ''))) AS exclusion_reason FROM watched),
first_ AS (SELECT *, CASE WHEN exclusion_reason IS NOT NULL THEN 'NONE' ELSE {rules.case_sql(gates.signal_rules('duckdb'), 'NONE')} END AS signal_ FROM excluded),
second_ AS (SELECT *, signal_ IN ('META_ANALYSIS', 'PHASE_II_RANDOMIZED') AND NOT {gates.journal_test('journal_', V.SOUND_JOURNALS, 10, 'duckdb')} AS weak_ FROM first_),
gated AS (
  SELECT *, CASE WHEN weak_ THEN 'NONE' ELSE signal_ END AS qualifying_signal,
    CASE WHEN exclusion_reason IS NOT NULL OR (signal_ <> 'NONE' AND NOT weak_) THEN NULL WHEN weak_ THEN 'non_whitelist_journal' ELSE {rules.case_sql(gates.rejection_rules('duckdb'), 'no_qualifying_signal')} END AS rejection_reason,
    {rules.points_sql(gates.score_rules())} AS added_
  FROM second_)"""  # fmt: skip
_LABELS = ", ".join(f"CASE WHEN {c} THEN {quoted(f'{label} {points:+d}')} END" for c, points, label in gates.score_rules())
_BASE = "CASE qualifying_signal " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in V.SIGNAL_BASE.items()) + " ELSE 0 END"
_names = lambda c, names: "(" + " OR ".join(f"contains({c}, {quoted(n)}) OR contains({quoted(n)}, {c})" for n in names) + ")"
_list = lambda names: "[" + ", ".join(map(quoted, names)) + "]"
_first = lambda names: f"list_min(list_intersect(list_transform(publication_types, lambda x: lower(x)), {_list(names)}))"
_types = f"""SELECT candidate_id, conference_source, journal, {_first(V.KEEP_TYPES)} AS k, {_first(V.LOW_PRIORITY_TYPES)} AS l, {_first(V.DROP_TYPES)} AS d FROM candidates"""
_decided = """SELECT *, NOT (k IS NULL AND d IS NOT NULL AND l IS NULL) AS keep, k IS NULL AND NOT (d IS NOT NULL AND l IS NULL) AS low_priority,
  CASE WHEN k IS NOT NULL THEN 'matched keep type: ' || k WHEN d IS NOT NULL AND l IS NULL THEN 'matched drop type: ' || d ELSE 'low-priority type: ' || coalesce(l, 'unspecified') END AS rationale"""
_word = lambda c, terms: f"regexp_matches({c}, {quoted(rules.any_word(terms))})"
_ranks = ["annals of tumour medicine", "archives of tumour medicine", "review of tumour medicine", "tumour medicine", "radiation practice"]

SQL = {
    "hard_exclude": _GATE + " SELECT candidate_id, exclusion_reason IS NOT NULL AS hard_excluded, exclusion_reason FROM gated",
    "gate_signal": _GATE + " SELECT candidate_id, qualifying_signal, rejection_reason FROM gated",
    "gate_score": _GATE + f" SELECT candidate_id, CAST(CASE WHEN qualifying_signal = 'NONE' THEN 0 ELSE greatest(0, {_BASE} + added_) END AS INTEGER) AS signal_score, CASE WHEN qualifying_signal <> 'NONE' THEN array_to_string(list_filter([{_LABELS}], lambda x: x IS NOT NULL), '; ') END AS labels FROM gated",
    "reason_histogram": _GATE + " SELECT rejection_reason, count(*) AS n FROM gated WHERE rejection_reason IS NOT NULL GROUP BY 1",
    "signal_histogram": _GATE + f" SELECT v.qualifying_signal, count(g.candidate_id) AS n FROM (SELECT unnest({_list([*V.SIGNAL_BASE, 'NONE'])}) AS qualifying_signal) v LEFT JOIN gated g ON g.qualifying_signal = v.qualifying_signal GROUP BY 1",
    "pubtype_decision": f"SELECT candidate_id, keep, low_priority, rationale FROM ({_decided} FROM ({_types}))",
    "pubtype_filter": f"""SELECT candidate_id, CASE WHEN coalesce(conference_source, '') <> '' THEN false WHEN NOT keep THEN true ELSE low_priority END AS low_priority,
  CASE WHEN coalesce(conference_source, '') <> '' THEN 'force-kept by lane source: ' || conference_source WHEN NOT keep THEN 'force-kept by journal whitelist (would-have-dropped: ' || rationale || ')' ELSE rationale END AS rationale
FROM ({_decided} FROM ({_types})) WHERE coalesce(conference_source, '') <> '' OR keep OR {_names("lower(coalesce(journal, ''))", WHITELIST)}""",
    "journal_rank": "SELECT candidate_id, CAST(CASE WHEN coalesce(journal, '') = '' THEN 105 " + " ".join(f"WHEN lower(journal) = {quoted(n)} THEN {i}" for i, n in enumerate(_ranks)) + " " + " ".join(f"WHEN contains(lower(journal), {quoted(n)}) OR contains({quoted(n)}, lower(journal)) THEN {i}" for i, n in enumerate(_ranks)) + " ELSE 105 END AS INTEGER) AS journal_rank FROM candidates",
    "whitelist_bidirectional": f"""SELECT candidate_id, {_names("lower(coalesce(journal, ''))", WHITELIST)} AS listed FROM candidates""",
    "relevance_score": f"""
WITH t AS (SELECT candidate_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, coalesce(title, '') || chr(10) || coalesce(abstract, '') AS text, mesh_terms FROM candidates),
s AS (SELECT candidate_id, least(100, greatest(0, CASE WHEN {_word('title', SITE_TERMS)} THEN 30 WHEN {_word('abstract', SITE_TERMS)} THEN 15 ELSE 0 END
  + CASE WHEN coalesce(list_has_any(list_transform(mesh_terms, lambda x: lower(x)), {_list([m.lower() for m in MESH_TERMS])}), false) THEN 15 ELSE 0 END
  + CASE WHEN {_word('text', V.TRIAL_TERMS)} THEN 20 ELSE 0 END + CASE WHEN {_word('text', MODALITY_TERMS)} THEN 15 ELSE 0 END + CASE WHEN {_word('text', V.ENDPOINT_TERMS)} THEN 15 ELSE 0 END
  - CASE WHEN {_word('text', V.PRECLINICAL_TERMS)} AND NOT {_word('text', V.CLINICAL_TERMS)} THEN 30 ELSE 0 END
  - CASE WHEN {_word('text', V.PEDIATRIC_TERMS)} AND NOT {_word('text', V.PEDIATRIC_CANCER_TERMS)} THEN 15 ELSE 0 END)) AS score FROM t)
SELECT candidate_id, CAST(score AS INTEGER) AS score, score >= 25 AS keep, score >= 25 AND score < 45 AS low_confidence FROM s""",
    "force_keep": f"""SELECT candidate_id, CASE WHEN conference_source = 'FDA' THEN 'fda_approval' WHEN {_names("lower(coalesce(journal, ''))", WHITELIST)} THEN 'tier1_journal' END AS force_keep_reason FROM candidates""",
    "language_filter": "SELECT doc_id FROM documents WHERE lower(trim(coalesce(lang, ''))) IN ('eng', 'english', 'en', '')",
    "abstract_required": "SELECT candidate_id FROM candidates WHERE trim(coalesce(abstract, '')) <> '' OR coalesce(conference_source = 'FDA', false)",
    "threshold_route": f"""SELECT candidate_id, {gates.route_without_signal()} AS route, hint, {gates.keep_decision()} AS decision FROM (
  SELECT *, {gates.priority_hint('relevance')} AS hint FROM (SELECT candidate_id, deterministic_relevance_score AS relevance, coalesce(pubtype_keep, false) AS keep, deterministic_relevance_score - 10 AS review_score, deterministic_relevance_score - 10 AS score, deterministic_relevance_score % 3 = 0 AS force_keep, true AS site_correct FROM candidates))""",
    "site_routing": """
WITH term AS (SELECT code, lower(unnest(free_text_core)) AS t FROM sites)
SELECT candidate_id, cancer_site_code FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM term WHERE contains(lower(c.title), t)) OR EXISTS (SELECT 1 FROM term WHERE contains(lower(c.title), t) AND code = c.cancer_site_code)""",
    "site_infer_argmax": """
WITH counted AS (SELECT fda_id, title, fetched_at, code, site_ord, (SELECT count(*) FROM (SELECT unnest(tumor_terms) AS t) WHERE contains(lower(concat_ws(' ', title, summary)), lower(t))) AS n FROM fda_items, sites),
best AS (SELECT fda_id, title, fetched_at, arg_max(code, n * 100 - site_ord) AS code, max(n) AS n FROM counted GROUP BY ALL)
SELECT f.fda_id, CASE WHEN n > 0 THEN code ELSE 'hematologic' END AS site FROM fda_items f JOIN best b ON f.fda_id = b.fda_id AND f.fetched_at = b.fetched_at""",
    "site_first_match": """
SELECT news_id, (SELECT code FROM sites WHERE len(list_filter(tumor_terms, lambda t: contains(lower(coalesce(n.abstract, '')), lower(t)))) > 0 ORDER BY site_ord LIMIT 1) AS site FROM news_records n""",
    "modality_keywords": """
SELECT candidate_id, array_to_string(list_slice(list_filter(modality_terms, lambda t: contains(lower(concat_ws(chr(10), title, abstract)), lower(t))), 1, 12), '|') AS keywords
FROM candidates JOIN sites ON code = cancer_site_code""",
    "conference_strata": f"SELECT candidate_id, CASE WHEN regexp_matches(coalesce(title, '') || ' ' || coalesce(abstract, ''), {quoted(CONFERENCE_HIGH)}) THEN 'MAJOR_CONFERENCE_HIGH' ELSE 'MAJOR_CONFERENCE_LOW' END AS stratum FROM candidates WHERE is_conference_abstract",
    "journal_guardrail": f"SELECT candidate_id, CASE WHEN deterministic_relevance_score >= 35 THEN 'relevance' WHEN regexp_matches(coalesce(title, '') || ' ' || coalesce(abstract, ''), {quoted(CLINICAL)}) THEN 'clinical_language' ELSE 'failed' END AS reason FROM candidates",
    "confidence_source": """SELECT candidate_id, CASE WHEN upper(coalesce(conference_source, '')) = 'FDA' OR list_contains(list_transform(publication_types, lambda x: upper(x)), 'FDA DRUG APPROVAL') THEN 'fda'
  WHEN list_contains(list_transform(publication_types, lambda x: upper(x)), 'GUIDELINE') OR upper(coalesce(conference_source, '')) = 'GUIDELINE' THEN 'guideline' WHEN coalesce(is_conference_abstract, false) THEN 'late_breaking_abstract'
  WHEN upper(conference_source) = 'WEB_SEARCH' THEN 'llm_discovery' WHEN upper(conference_source) = 'TRADE_PRESS' THEN 'trade_press' WHEN upper(conference_source) IN ('PRESS_RELEASE', 'COMPANY_RELEASE') THEN 'company_press_release' ELSE 'peer_reviewed' END AS confidence_source FROM candidates""",
    "source_type": f"SELECT candidate_id, CASE WHEN coalesce(conference_source, '') = '' THEN 'PUBMED' WHEN upper(conference_source) = 'FDA' THEN 'FDA' WHEN upper(conference_source) IN ({', '.join(map(quoted, V.SOCIETIES))}) THEN 'CONFERENCE_ABSTRACT' WHEN upper(conference_source) = 'WEB_SEARCH' THEN 'WEB_SEARCH' ELSE 'JOURNAL' END AS source_type FROM candidates",
    "funnel_counts": """
WITH f AS (SELECT cancer_site_code, coalesce(trim(abstract), '') <> '' AS a, coalesce(pubtype_keep, false) AS b, coalesce(deterministic_relevance_score >= 45, false) AS c, force_keep_reason IS NOT NULL AS d FROM candidates),
g AS (SELECT cancer_site_code, count(*) AS fetched, count(*) FILTER (a) AS with_abstract, count(*) FILTER (a AND b) AS type_kept, count(*) FILTER (a AND b AND c) AS relevant, count(*) FILTER (a AND b AND c AND d) AS forced FROM f GROUP BY 1),
w AS (SELECT * FROM g WHERE cancer_site_code IS NOT NULL UNION ALL SELECT NULL, sum(fetched), sum(with_abstract), sum(type_kept), sum(relevant), sum(forced) FROM g)
SELECT cancer_site_code, stage, CAST(n AS BIGINT) AS n FROM w UNPIVOT (n FOR stage IN (fetched, with_abstract, type_kept, relevant, forced))""",
    "journal_top30": "SELECT journal, count(*) AS n FROM candidates GROUP BY 1 ORDER BY n DESC, journal NULLS FIRST LIMIT 30",
}
