"""Queries of the training-data problems over the project's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlit.llm import components, linkage, mixing, packing, pii, tokens, topn, truncation, truth, visual
from lumenlit.scratch import Scratch
from lumenlit.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_kinds(table(spark, folder, "comments", "comment_id", "content", "display_name"))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "comments", "comment_id", "display_name", "content"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    signals = table(spark, folder, "oncology_signals", "record_no", "signal_id", "signal_title", "intervention", "updated_at")
    evidence = table(spark, folder, "evidence_sources", "record_no", "source_type")
    return truth.surviving_records(signals, evidence, table(spark, folder, "source_trust"))


def p3_truth(spark: SparkSession, folder: str) -> DataFrame:
    signals = table(spark, folder, "oncology_signals", "record_no", "signal_id", "signal_title", "intervention", "updated_at")
    return truth.summed_records(signals, table(spark, folder, "evidence_sources", "record_no", "source_type"))


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every abstract and summary in the shape that the truncation operator takes."""
    news = table(spark, folder, "news_records", "news_id", "source_key", "abstract").selectExpr("'news_records' table_name", "news_id record_id", "source_key source", "abstract text")
    return news.unionByName(table(spark, folder, "fda_items", "fda_id", "source", "summary").selectExpr("'fda_items' table_name", "fda_id record_id", "source", "summary text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_scores(source_texts(spark, folder)).where("cut").select("table_name", "record_id")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(truncation.truncation_scores(source_texts(spark, folder)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "match_pairs", "left_id", "right_id", "status", "decided_at")
    return components.evidence_groups(table(spark, folder, "evidence_sources", "evidence_id"), pairs)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    candidates = table(spark, folder, "candidates", "candidate_id", "run_id", "cancer_site_code")
    scores = table(spark, folder, "signal_scores", "candidate_id", "score", "scored_at")
    return topn.top_candidates(candidates, scores).select("site_code", "run_id", "place", "candidate_id")


def _listings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    evidence = table(spark, folder, "evidence_sources", "evidence_id", "title", "doi", "trial_name", "nct_id", "journal", "publication_date")
    catalog = table(spark, folder, "source_catalog", "catalog_id", "title", "doi", "trial_label", "nct_number", "venue", "pub_year")
    return evidence, catalog


def matched_works(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.works_of_evidence(*_listings(spark, folder))


def p7_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.calibration(linkage.compared_works(*_listings(spark, folder)))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return matched_works(spark, folder).select("evidence_id", "catalog_id")


def p7_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return matched_works(spark, folder)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(tokens.sized(table(spark, folder, "documents", "doc_id", "text")))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder))


def mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = Scratch(spark, "sizes").cut(tokens.sized(table(spark, folder, "documents", "doc_id", "source", "text"), "source"), "sized")
    return mixing.mix(documents, table(spark, folder, "mix_targets"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_alikes(table(spark, folder, "documents", "doc_id", "text"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    return visual.consistent_texts(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "form", "mixed_tokens")


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_classes(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_truth": p3_truth, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_confidence": p7_confidence, "p7_calibration": p7_calibration, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_forms": p10_forms, "p10_classes": p10_classes}

SQL = {
    "p3_found": """
WITH trust AS (SELECT upper(trim(source_type)) AS kind, max(trust) AS trust FROM source_trust GROUP BY 1),
backed AS (SELECT record_no, max(trust) AS trust FROM evidence_sources JOIN trust ON upper(trim(evidence_sources.source_type)) = kind WHERE record_no IS NOT NULL GROUP BY 1),
rows_ AS (
  SELECT signal_id, s.record_no, coalesce(trust, 0) AS trust, updated_at,
    lower(replace(trim(signal_title), '_', ' ')) NOT IN ('', '-', '—', 'n/a', 'not reported') AND signal_title IS NOT NULL AS has_title,
    lower(replace(trim(intervention), '_', ' ')) NOT IN ('', '-', '—', 'n/a', 'not reported') AND intervention IS NOT NULL AS has_intervention,
    count(*) OVER (PARTITION BY signal_id) AS n
  FROM oncology_signals s LEFT JOIN backed b ON s.record_no = b.record_no WHERE signal_id IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY has_title DESC, trust DESC, updated_at DESC NULLS LAST, record_no) AS t,
    row_number() OVER (PARTITION BY signal_id ORDER BY has_intervention DESC, trust DESC, updated_at DESC NULLS LAST, record_no) AS i
  FROM rows_ WHERE n > 1)
SELECT signal_id, CAST(max(CASE WHEN t = 1 AND has_title THEN record_no ELSE 0 END) AS BIGINT) AS title_record,
  CAST(max(CASE WHEN i = 1 AND has_intervention THEN record_no ELSE 0 END) AS BIGINT) AS intervention_record
FROM ranked GROUP BY signal_id""",
    "p5_found": """
WITH RECURSIVE latest AS (
  SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, arg_max(status, decided_at) AS status
  FROM match_pairs WHERE left_id <> right_id GROUP BY 1, 2),
link AS (SELECT a, b FROM latest WHERE status = 'match' AND a IN (SELECT evidence_id FROM evidence_sources) AND b IN (SELECT evidence_id FROM evidence_sources)),
edge AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach AS (SELECT u AS root, u AS node FROM edge UNION SELECT reach.root, edge.v FROM reach JOIN edge ON reach.node = edge.u WHERE edge.v > reach.root)
SELECT node AS evidence_id, min(root) AS group_id FROM (
  SELECT root, node FROM reach UNION ALL SELECT node, node FROM reach) GROUP BY node""",
    "p6_found": """
WITH score AS (SELECT candidate_id, arg_max(score, scored_at) AS score FROM signal_scores WHERE score IS NOT NULL GROUP BY 1),
placed AS (SELECT DISTINCT regexp_replace(lower(trim(cancer_site_code)), '[ _-]+', '_', 'g') AS site_code, run_id, candidate_id FROM candidates WHERE cancer_site_code IS NOT NULL)
SELECT site_code, run_id, place, candidate_id FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY site_code, run_id ORDER BY score DESC, candidate_id) AS INTEGER) AS place FROM placed JOIN score USING (candidate_id))
WHERE place <= 10""",
}
