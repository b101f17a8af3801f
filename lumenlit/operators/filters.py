"""Record filters: publication type, relevance, routing to sites, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules


def in_language(language: Column, accepted: tuple[str, ...] = ("eng", "english", "en")) -> Column:
    """Whether a record is in an accepted language; a missing one counts as accepted."""
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return low.isin(*accepted, "")


def has_text(abstract: Column, excused: Column) -> Column:
    """Whether there is an abstract, or the record is excused from one."""
    return (F.trim(F.coalesce(abstract, F.lit(""))) != "") | F.coalesce(excused, F.lit(False))


def classify_types(types: Column, keep: list[str] = V.KEEP_TYPES, low: list[str] = V.LOW_PRIORITY_TYPES, drop: list[str] = V.DROP_TYPES) -> Column:
    """A struct (keep, low_priority, rationale) of a record's publication types; the alphabetically first hit is named."""
    given = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    hit = lambda names: F.array_min(F.array_intersect(given, F.array(*map(F.lit, names))))
    kept, lowly, dropped = hit(keep), hit(low), hit(drop)
    decide = lambda k, p, text: F.struct(F.lit(k).alias("keep"), F.lit(p).alias("low_priority"), text.alias("rationale"))
    return (
        F.when(kept.isNotNull(), decide(True, False, F.concat(F.lit("matched keep type: "), kept)))
        .when(dropped.isNotNull() & lowly.isNull(), decide(False, False, F.concat(F.lit("matched drop type: "), dropped)))
        .otherwise(decide(True, True, F.concat(F.lit("low-priority type: "), F.coalesce(lowly, F.lit("unspecified")))))
    )


def filter_types(records: DataFrame, whitelist: list[str], types: str = "publication_types", lane: str = "conference_source", journal: str = "journal") -> DataFrame:
    """Adds pubtype (struct) and keeps the records that pass: lane records as they are, dropped ones of whitelisted journals at low priority."""
    base = classify_types(F.col(types))
    lane_tag = F.nullif(F.col(lane), F.lit(""))
    struct = lambda k, p, text: F.struct(F.lit(k).alias("keep"), F.lit(p).alias("low_priority"), text.alias("rationale"))
    marked = records.withColumn("pubtype", base)
    white = rules.names_match(F.lower(F.coalesce(F.col(journal), F.lit(""))), whitelist)
    decided = (
        F.when(lane_tag.isNotNull(), struct(True, False, F.concat(F.lit("force-kept by lane source: "), lane_tag)))
        .when(~F.col("pubtype.keep") & white, struct(True, True, F.concat(F.lit("force-kept by journal whitelist (would-have-dropped: "), F.col("pubtype.rationale"), F.lit(")"))))
        .otherwise(F.col("pubtype"))
    )
    return marked.withColumn("pubtype", decided).where("pubtype.keep")


def relevance(title: Column, abstract: Column, mesh: Column, site_terms: str, mesh_terms: list[str], modality_terms: str, gynecologic: Column | bool = False, keep: int = 50, low: int = 30) -> Column:
    """A struct (score, keep, low_confidence, labels) of one site's relevance to a record.

    ``site_terms`` and ``modality_terms`` are patterns made by ``rules.any_word``.
    """
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    text = F.concat(title, F.lit("\n"), abstract)
    word = lambda terms: text.rlike(rules.any_word(terms))
    in_title = title.rlike(site_terms)
    gyn = gynecologic if isinstance(gynecologic, Column) else F.lit(gynecologic)
    parts = [
        (in_title, 30, "site term in title"),
        (~in_title & abstract.rlike(site_terms), 15, "site term in abstract"),
        (F.coalesce(F.arrays_overlap(F.transform(mesh, F.lower), F.array(*(F.lit(m.lower()) for m in mesh_terms))), F.lit(False)) if mesh_terms else F.lit(False), 15, "heading"),
        (word(V.TRIAL_TERMS), 20, "trial or guideline"),
        (text.rlike(modality_terms), 15, "modality"),
        (word(V.ENDPOINT_TERMS), 15, "endpoint"),
        (word(V.PRECLINICAL_TERMS) & ~word(V.CLINICAL_TERMS), -30, "preclinical only"),
        (gyn & word(V.BENIGN_TERMS) & ~word(V.CANCER_TERMS), -20, "benign only"),
        (word(V.PEDIATRIC_TERMS) & ~word(V.PEDIATRIC_CANCER_TERMS), -15, "pediatric, not oncology"),
    ]
    total = F.lit(0)
    for hit, points, _ in parts:
        total = total + F.when(hit, points).otherwise(0)
    score = F.least(F.lit(100), F.greatest(F.lit(0), total))
    labels = F.filter(F.array(*(F.when(hit, F.lit(f"{points:+d} {label}")) for hit, points, label in parts)), lambda x: x.isNotNull())
    return F.struct(score.cast("int").alias("score"), (score >= low).alias("keep"), ((score >= low) & (score < keep)).alias("low_confidence"), labels.alias("labels"))


def terms_present(text: Column, terms: Column, most: int = 12) -> Column:
    """The first ``most`` terms (in their order) that the text contains anywhere, case aside."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.slice(F.filter(terms, lambda t: low.contains(F.lower(t))), 1, most)


def routed(texts: DataFrame, text: str, site_terms: DataFrame, key: str, owner: str) -> DataFrame:
    """texts that stay with their owner site: its terms occur, or no site's do.

    ``site_terms``: site, term; a dimension of fixed size, gathered into one row
    so that each text is looked at once.
    """
    gathered = site_terms.groupBy("site").agg(F.collect_list(F.lower("term")).alias("terms")).agg(F.collect_list(F.struct("site", "terms")).alias("sites"))
    hits = F.filter("sites", lambda s: F.exists(s["terms"], lambda t: F.lower(F.col(text)).contains(t)))
    marked = texts.crossJoin(F.broadcast(gathered)).withColumn("hit_sites", F.transform(hits, lambda s: s["site"])).drop("sites")
    return marked.where((F.size("hit_sites") == 0) | F.array_contains("hit_sites", F.col(owner)))


def inferred_site(text: Column, sites: list[tuple[str, list[str]]], default: str) -> Column:
    """The site with most of its terms in the text; the earlier one of equals, the default if none occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counted = [F.struct(sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("site")) for i, (code, terms) in enumerate(sites)]
    best = F.greatest(*counted) if len(counted) > 1 else counted[0]
    return F.when(best["n"] > 0, best["site"]).otherwise(F.lit(default))


def first_site(text: Column, sites: list[tuple[str, list[str]]]) -> Column:
    """The first site, in the order given, one of whose terms the text contains; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda terms: F.exists(F.array(*(F.lit(t.lower()) for t in terms)), low.contains)
    return F.coalesce(*[F.when(hit(terms), F.lit(code)) for code, terms in sites])
