"""Text, calendar and JSON operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import calendar, text
from lumenlit.functions.rules import quoted
from lumenlit.sources.tables import table


def pub_window(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "publication_date")
    return rows.where(calendar.in_publication_window(F.col("publication_date"), "2023-06-30", 365)).select("candidate_id")


def lenient_dates(spark, folder):
    rows = table(spark, folder, "candidates", "candidate_id", "publication_date")
    return rows.select("candidate_id", calendar.strict_date(F.col("publication_date")).cast("string").alias("day"))


def rolling_lookback(spark, folder):
    return table(spark, folder, "events", "event_id", "ts").where(calendar.seen_since(F.col("ts"), "2024-01-30", 10)).select("event_id")


def meeting_active(spark, folder):
    days = table(spark, folder, "orders", F.to_date("o_orderdate").alias("day"))
    return calendar.active_meetings(days, "day").select("meeting", *(F.col(c).cast("string").alias(c) for c in ("day", "window_start", "window_end")))


def week_label(spark, folder):
    return table(spark, folder, "events", "ts").groupBy(calendar.week_start(F.to_date("ts")).cast("string").alias("week")).agg(F.count("*").alias("n"))


def json_flatten(spark, folder):
    return table(spark, folder, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_build(spark, folder):
    rows = table(spark, folder, "events", "event_id", "event_type", "props")
    built = F.to_json(F.struct("event_type", F.from_json("props", "k bigint").alias("props")))
    return rows.select("event_id", built.alias("document")).select("event_id", F.get_json_object("document", "$.event_type").alias("event_type"), F.get_json_object("document", "$.props.k").cast("long").alias("k"))


def key_findings(spark, folder):
    rows = table(spark, folder, "oncology_signals", "record_no", "key_finding", "so_what", "limitations")
    given = lambda c: F.when(~F.lower(F.trim(c)).isin("not_reported", "not reported", "n/a", "-", "—", ""), F.trim(c))
    return rows.select("record_no", F.concat_ws(" · ", given("key_finding"), given("so_what"), given("limitations")).alias("findings"))


def html_strip(spark, folder):
    return table(spark, folder, "news_records", "news_id", "abstract").select("news_id", text.without_tags(F.col("abstract")).alias("plain"))


def html_escape(spark, folder):
    return table(spark, folder, "fda_items", "fda_id", "summary").select("fda_id", text.escaped(F.col("summary")).alias("safe"))


def page_excerpt(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", text.excerpt(F.col("text"), "median follow-up", 300, 40).alias("excerpt"))


def shortened_titles(spark, folder):
    return table(spark, folder, "candidates", "candidate_id", "title").select("candidate_id", text.shortened(F.col("title"), 60).alias("short"))


def quote_grounding(spark, folder):
    evidence = table(spark, folder, "candidates", "candidate_id", "title", "abstract", "ingested_at")
    quotes = F.array(F.substring(F.upper("abstract"), 5, 30), F.col("title"))
    return evidence.select("candidate_id", text.grounded(quotes, F.col("abstract")).alias("grounded"), F.size(text.ungrounded(quotes, F.col("abstract"))).alias("unverified"))


def trial_acronyms(spark, folder):
    return table(spark, folder, "news_records", "news_id", "title").select("news_id", text.trial_acronym(F.col("title")).alias("acronym"))


def phase_inference(spark, folder):
    return table(spark, folder, "evidence_sources", "evidence_id", "title").select("evidence_id", text.infer_phase(F.col("title")).alias("phase"))


def normalised_titles(spark, folder):
    return table(spark, folder, "candidates", "title").groupBy(text.stripped(F.col("title")).alias("title")).agg(F.count("*").alias("n"))


def block_parse(spark, folder):
    made = F.concat(F.lit("TITLE: "), F.col("title"), F.lit("\nDATE: "), F.coalesce(F.trim("pub_date"), F.lit("none")), F.lit("\nURL: "), F.col("url"))
    rows = table(spark, folder, "fda_items", "fda_id", "title", "pub_date", "url", "fetched_at").where("title not rlike '[\\r\\n]' and trim(coalesce(pub_date, 'none')) <> ''").select("fda_id", F.concat(made, F.lit("\n\n"), made).alias("page"))
    parsed = rows.select("fda_id", F.explode(text.blocks(F.col("page"), "TITLE", "DATE", "URL")).alias("b"))
    return parsed.select("fda_id", F.col("b.title").alias("title"), F.col("b.url").alias("url"))


QUERIES = {f.__name__: f for f in (pub_window, lenient_dates, rolling_lookback, meeting_active, week_label, json_flatten, json_build, key_findings, html_strip, html_escape, page_excerpt, shortened_titles, quote_grounding, trial_acronyms, phase_inference, normalised_titles, block_parse)}

_date = "TRY_CAST(CASE WHEN regexp_matches({c}, '^\\d{{4}}$') THEN {c} || '-01-01' WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}$') THEN {c} || '-01' WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {c} END AS DATE)"
_meetings = ", ".join(f"({quoted(c)}, {m}, {w})" for c, m, w in V.MEETINGS)
_given = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('not_reported', 'not reported', 'n/a', '-', '—', '') THEN trim({c}) END"
_flat = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_strip = "regexp_replace(abstract, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _strip = f"replace({_strip}, '{_e}', '{_c}')"
_escape = "summary"
for _c, _e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _escape = f"replace({_escape}, '{_c}', '{_e}')"

SQL = {
    "pub_window": f"SELECT candidate_id FROM (SELECT candidate_id, trim(substr(regexp_replace(publication_date, '^[\\s\\x{{a0}}]+', ''), 1, 10)) AS p FROM candidates) WHERE coalesce({_date.format(c='p')} BETWEEN DATE '2023-06-30' - 365 AND DATE '2023-06-30', true)",
    "lenient_dates": f"SELECT candidate_id, CAST({_date.format(c='publication_date')} AS VARCHAR) AS day FROM candidates",
    "rolling_lookback": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAYS",
    "meeting_active": f"""
WITH m(meeting, mon, leeway) AS (VALUES {_meetings}), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
p AS (SELECT day, meeting, leeway, make_date(y, mon, 1) AS pub FROM d, m, (SELECT unnest([0, 1]) AS back), LATERAL (SELECT year(day) - back AS y))
SELECT CAST(day AS VARCHAR) AS day, meeting, CAST(CAST(max(pub) AS DATE) - CAST(any_value(leeway) AS INTEGER) AS VARCHAR) AS window_start, CAST(least(CAST(max(pub) AS DATE) + 35, day) AS VARCHAR) AS window_end FROM p WHERE day - pub BETWEEN 0 AND 35 + leeway GROUP BY p.day, meeting""",
    "week_label": "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM events GROUP BY 1",
    "json_flatten": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_build": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "key_findings": f"SELECT record_no, concat_ws(' · ', {_given('key_finding')}, {_given('so_what')}, {_given('limitations')}) AS findings FROM oncology_signals",
    "html_strip": f"SELECT news_id, trim(regexp_replace({_strip}, '\\s+', ' ', 'g')) AS plain FROM news_records",
    "html_escape": f"SELECT fda_id, {_escape} AS safe FROM fda_items",
    "page_excerpt": "SELECT doc_id, substr(text, greatest(instr(text, 'median follow-up') - 40, 1), 300) AS excerpt FROM documents",
    "shortened_titles": "SELECT candidate_id, CASE WHEN length(title) <= 60 THEN title ELSE rtrim(substr(title, 1, 59)) || '…' END AS short FROM candidates",
    "quote_grounding": f"""
WITH q AS (SELECT candidate_id, {_flat("coalesce(abstract, '')")} AS body, unnest([substr(upper(abstract), 5, 30), title]) AS quote, ingested_at FROM candidates),
u AS (SELECT candidate_id, ingested_at, body, count(*) FILTER (body = '' OR coalesce({_flat('quote')} = '' OR NOT contains(body, {_flat('quote')}), false)) AS n FROM q GROUP BY ALL)
SELECT candidate_id, body <> '' AND n = 0 AS grounded, CAST(n AS INTEGER) AS unverified FROM u""",
    "trial_acronyms": f"""
SELECT news_id, coalesce(nullif(regexp_extract(title, '\\b(NCT\\d{{8}})\\b', 1), ''), list_filter(list_transform(regexp_extract_all(title, '(?i)\\b([A-Z]{{3,10}}\\d{{0,3}})\\b', 1), lambda x: upper(x)), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(map(quoted, V.NOT_ACRONYMS))}))[1]) AS acronym FROM news_records""",
    "phase_inference": "SELECT evidence_id, CASE WHEN regexp_matches(lower(title), 'phase iii|phase 3') THEN '3' WHEN regexp_matches(lower(title), 'phase ii|phase 2') THEN '2' WHEN regexp_matches(lower(title), 'phase i|phase 1') THEN '1' WHEN contains(lower(title), 'phase 4') THEN '4' END AS phase FROM evidence_sources",
    "normalised_titles": "SELECT trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title, count(*) AS n FROM candidates GROUP BY 1",
    "block_parse": "SELECT fda_id, trim(title) AS title, trim(url) AS url FROM fda_items, (SELECT unnest([1, 2])) WHERE NOT regexp_matches(title, '[\\r\\n]') AND trim(coalesce(pub_date, 'none')) <> ''",
}
