"""Text helpers as Column expressions, and the few that need a scanner."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.conf import vocabulary as V


def collapsed(text: Column) -> Column:
    """Lower case, runs of blanks made one, outer blanks gone."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def missing_as_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def content_tokens(text: Column, stopwords: list[str] = V.TITLE_STOPWORDS) -> Column:
    """The distinct words of more than three characters that are no stop words."""
    return F.array_distinct(F.filter(F.split(stripped(text), " "), lambda w: (F.length(w) > 3) & ~w.isin(stopwords)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def without_tags(markup: Column) -> Column:
    """Text without tags and with the common entities read, blanks collapsed."""
    text = F.regexp_replace(markup, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escaped(text: Column) -> Column:
    """Text made safe for HTML."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters; a cut text ends with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def excerpt(text: Column, pattern: str, length: int = 1200, lead: int = 200) -> Column:
    """``length`` characters from ``lead`` before the first match, else from the start."""
    return F.substring(text, F.greatest(F.regexp_instr(text, F.lit(pattern)) - lead, F.lit(1)), F.lit(length))


def ungrounded(quotes: Column, source: Column) -> Column:
    """The quotes that the source does not contain, blanks and case aside; an empty source grounds nothing."""
    body = collapsed(F.coalesce(source, F.lit("")))
    return F.filter(quotes, lambda q: (body == "") | (collapsed(q) == "") | ~body.contains(collapsed(q)))


def grounded(quotes: Column, source: Column) -> Column:
    return (collapsed(F.coalesce(source, F.lit(""))) != "") & (F.size(ungrounded(quotes, source)) == 0)


def trial_acronym(title: Column, skipped: list[str] = V.NOT_ACRONYMS) -> Column:
    """A registry number, else the first word of four or more letters (with up to three digits) that is not a known abbreviation."""
    registered = F.nullif(F.regexp_extract(title, r"\b(NCT\d{8})\b", 1), F.lit(""))
    words = F.transform(F.regexp_extract_all(title, F.lit(r"(?i)\b([A-Z]{3,10}\d{0,3})\b"), 1), F.upper)
    return F.coalesce(registered, F.try_element_at(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(skipped)), F.lit(1)))


def blocks(text: Column, *labels: str) -> Column:
    """Records written as ``LABEL: value`` lines; one struct per record, fields in label order."""
    pattern = r"(?m)" + r"\s*\n".join(rf"^\s*{label}\s*:\s*(.+?)" for label in labels) + r"\s*$"
    parts = [F.regexp_extract_all(text, F.lit(pattern), i + 1) for i in range(len(labels))]
    return F.arrays_zip(*[p.alias(label.lower()) for p, label in zip(parts, labels)])


def infer_phase(text: Column) -> Column:
    """The trial phase that a text names; the tests run in this order, and "phase i" is also part of "phase iv"."""
    low = F.lower(text)
    return F.when(low.rlike("phase iii|phase 3"), "3").when(low.rlike("phase ii|phase 2"), "2").when(low.rlike("phase i|phase 1"), "1").when(low.rlike("phase 4"), "4")


def first_json_object(text: str | None) -> str | None:
    """The first JSON object in a text: the whole, inside a code fence, or the first balanced braces; null if there is none."""
    if not text:
        return None
    fenced = text.split("```")
    for piece in [text, *(p.removeprefix("json") for p in fenced[1::2])]:
        try:
            if isinstance(json.loads(piece), dict):
                return piece.strip()
        except ValueError:
            pass
    start = text.find("{")
    while start >= 0:
        depth, inside, skip = 0, False, False
        for at in range(start, len(text)):
            c = text[at]
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    try:
                        json.loads(text[start : at + 1])
                        return text[start : at + 1]
                    except ValueError:
                        break
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def json_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_json_object)
