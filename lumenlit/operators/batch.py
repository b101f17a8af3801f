"""Steps between a lane and the review: records of other kinds brought to one shape, bypasses, strict routing, calendar tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import calendar

BYPASS_SCORE = 70


def bypassed(relevance: Column, excused: Column, score: int = BYPASS_SCORE) -> Column:
    """A relevance struct (score, keep, low_confidence, labels), replaced by a constant one where the record is excused."""
    constant = F.struct(F.lit(score).cast("int").alias("score"), F.lit(True).alias("keep"), F.lit(False).alias("low_confidence"), F.array(F.lit("bypass")).alias("labels"))
    return F.when(F.coalesce(excused, F.lit(False)), constant).otherwise(relevance)


def item_records(items: DataFrame, lane: str, journal: str, types: Sequence[str], title: str = "title", text: str = "summary", url: str = "url", date: str = "pub_date") -> DataFrame:
    """Items of a lane without identifiers of their own, in the columns of a literature record; the hash of lane, address and title tells them apart."""
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.sha2(F.concat_ws("|", F.lit(lane), given(url), given(title)), 256)
    return items.withColumns({"pmid": F.lit(""), "abstract": given(text), "journal": F.lit(journal), "publication_date": F.col(date), "publication_types": F.array(*map(F.lit, types)), "text_hash": digest, "conference_source": F.lit(lane)})


def strictly_routed(records: DataFrame, text: Column, site_terms: DataFrame) -> DataFrame:
    """A row (records, site) for each site one of whose terms the text contains; a site without terms takes every record.

    ``site_terms``: site, terms (array); a dimension of fixed size, gathered into
    one row so that each text is looked at once.
    """
    gathered = site_terms.agg(F.collect_list(F.struct("site", F.transform("terms", F.lower).alias("terms"))).alias("sites_"))
    marked = records.withColumn("text_", F.lower(text)).crossJoin(F.broadcast(gathered))
    hits = F.filter("sites_", lambda s: (F.size(s["terms"]) == 0) | F.exists(s["terms"], lambda t: F.col("text_").contains(t)))
    return marked.withColumn("site", F.explode(F.transform(hits, lambda s: s["site"]))).drop("text_", "sites_")


def calendar_tags(records: DataFrame, published: str, reference: str, lookback: int = 35, meetings: Sequence[tuple[str, int, int]] = V.MEETINGS) -> DataFrame:
    """The records that fall into the window of a meeting active at their reference date, tagged by the first such meeting of the calendar.

    The join is on the reference date; the calendar holds a row per date and
    meeting, so a date with any number of records stays spread out.
    """
    due = calendar.active_meetings(records, reference, lookback, list(meetings))
    place = F.create_map(*(F.lit(x) for i, (code, _, _) in enumerate(meetings) for x in (code, i)))
    windows = due.groupBy(reference).agg(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("meeting")).alias("place"), "meeting", "window_start", "window_end"))).alias("due_"))
    inside = F.filter("due_", lambda m: F.col(published).between(m["window_start"], m["window_end"]))
    return records.join(F.broadcast(windows), reference).withColumn("meeting", F.get(F.transform(inside, lambda m: m["meeting"]), F.lit(0))).drop("due_").where("meeting is not null")


def most_trusted(rows: DataFrame, group: str, source: str, date: str, identifier: str) -> DataFrame:
    """Per group the identifier of the row whose kind of source ranks highest; then the earliest date as written, a missing one last, then the least identifier."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in V.CONFIDENCE_RANK.items() for x in kv)), F.col(source)), F.lit(0))
    order = F.struct((-rank).alias("rank"), F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("9999-99-99")).alias("date"), F.col(identifier).alias("id"))
    return rows.groupBy(group).agg(F.min(order).alias("best")).select(group, F.col("best.id").alias(identifier))


def short_lines(text: Column, most_words: int = 4) -> Column:
    """The pieces of a text, between line ends and full stops, of at most so many words that hold three capitals in a row."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.;]"), lambda line: F.regexp_replace(line, r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    return F.array_distinct(F.filter(lines, lambda line: line.rlike("[A-Z]{3}") & (F.size(F.split(line, r"\s+")) <= most_words)))
