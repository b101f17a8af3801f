"""Search lanes: a query as a predicate over records instead of a text for a search service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.functions import rules


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term, a phrase if it has blanks, occurs as whole words."""
    return text.rlike(rules.any_word([t.strip() for t in terms if t.strip()])) if any(t.strip() for t in terms) else F.lit(False)


def any_heading(headings: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(headings, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)


def in_journals(journal: Column, journals: Sequence[str]) -> Column:
    return F.coalesce(F.lower(journal).isin([j.lower() for j in journals]), F.lit(False))


def in_window(published: Column, indexed: Column, start: str, end: str) -> Column:
    """Whether the publication or the indexing date lies in the window, its ends included."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.coalesce(published.between(first, last), F.lit(False)) | F.coalesce(indexed.between(first, last), F.lit(False))


def core(text: Column, headings: Column, site_terms: Sequence[str], tumor_terms: Sequence[str], site_headings: Sequence[str]) -> Column:
    """A term of the site and one of the disease, or a heading."""
    return (any_term(text, site_terms) & any_term(text, tumor_terms)) | any_heading(headings, site_headings)


def lane(records: DataFrame, predicate: Column, order: list[Column], most: int | None = None) -> DataFrame:
    """The records of a lane, at most so many in a total order."""
    hits = records.where(predicate)
    return hits if most is None else hits.orderBy(*order).limit(most)


def synthetic_identifier(title: Column, prefix: str = "WS_") -> Column:
    """An identifier made from the title, the same for the same title."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.lower(title), 256), 1, 12))


def first_tag(text: Column, tags: Sequence[tuple[str, str]]) -> Column:
    """The tag of the first term, in the order given, that the text contains; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(term.lower()), F.lit(tag)) for term, tag in tags])


def watchlist(*lists: Column) -> Column:
    """The entries of all lists, the earlier first, each once."""
    out = lists[0]
    for more in lists[1:]:
        out = F.array_union(out, more)
    return out


def enriched(items: DataFrame, pages: DataFrame, key: str, text: str, page_text: str, least: int = 200) -> DataFrame:
    """Items whose text is shorter than ``least`` take the page's text instead, if there is one."""
    found = items.join(pages.select(key, F.col(page_text).alias("page_text_")), key, "left")
    short = (F.length(F.coalesce(F.col(text), F.lit(""))) < least) & F.col("page_text_").isNotNull()
    return found.withColumn(text, F.when(short, F.col("page_text_")).otherwise(F.col(text))).drop("page_text_")
