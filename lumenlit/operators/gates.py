"""The three gates of a candidate: hard exclusion, qualifying signal, additive score.

All of it is one projection: each pattern is tried once per row, in SQL that any
engine with the same regular expressions can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules
from lumenlit.functions.rules import quoted

NONE = "NONE"


def hit(column: str, pattern: str, engine: str = "spark") -> str:
    """A predicate that finds a pattern; patterns have no backslashes beyond what both engines read alike."""
    return f"{column} RLIKE r{quoted(pattern)}" if engine == "spark" else f"regexp_matches({column}, {quoted(pattern)})"


def journal_test(column: str, journals: list[str], least: int, engine: str = "spark") -> str:
    """Equal, or containing or contained from ``least`` characters on; a missing journal is none.

    The names are one pattern and one text each, so the list's length does not
    lengthen the generated code.
    """
    long_ones = [j for j in journals if len(j) >= least]
    inside = hit(column, "|".join(long_ones), engine)
    return f"({column} <> '' AND (contains({quoted('|' + '|'.join(journals) + '|')}, concat('|', {column}, '|')) OR {inside} OR contains({quoted('|'.join(long_ones))}, {column})))"


def signal_rules(engine: str = "spark") -> list[rules.Rule]:
    """The ordered tests for the qualifying signal over text_, title_, journal_, source_ (upper case), types_ (joined) and watched_."""
    h = lambda p, c="text_": hit(c, p, engine)
    society = f"source_ IN ({', '.join(map(quoted, V.SOCIETIES))})"
    return [
        ("source_ = 'WEB_SEARCH'", "LLM_CURATED"),
        (f"source_ = 'FDA' OR contains(types_, 'fda drug approval') OR {h(V.APPROVAL)}", "FDA"),
        (f"{h(V.GUIDELINE_BODY)} AND {h(V.GUIDELINE_EVENT)}", "GUIDELINE"),
        ("watched_", "WATCHED_TRIAL"),
        (f"{h(V.RANDOMIZED)} AND {h(V.NEGATIVE)}", "NEGATIVE_TRIAL"),
        (f"{h(V.PHASE_3)} AND {h(V.RANDOMIZED)} AND NOT {h(V.BORROWED)} AND NOT {h(V.RETROSPECTIVE_TITLE, 'title_')}", "PHASE_III_RANDOMIZED"),
        (f"{h(V.RANDOMIZED)} AND {h(V.DEESCALATION)}", "RANDOMIZED_DEESCALATION"),
        (f"{h(V.PHASE_2)} AND {h(V.RANDOMIZED)}", "PHASE_II_RANDOMIZED"),
        (f"CASE WHEN {society} THEN {h(V.LATE_BREAKING)} OR {h(V.CONFERENCE_RESULT)} ELSE {h(V.SOCIETY_LATE_BREAKING)} END", "MAJOR_CONFERENCE"),
        (f"{h(V.PROSPECTIVE)} AND {h(V.RADIOTHERAPY_CHANGE)}", "DIRECT_RADONC_TRIAL"),
        (f"{h(V.PHASE_2)} AND {h(V.REGULATORY)}", "REGULATORY_PHASE_II"),
        (h(V.META_ANALYSIS), "META_ANALYSIS"),
        (f"{journal_test('journal_', V.TOP_JOURNALS, 8, engine)} AND {h(V.TOP_JOURNAL_RESULT)}", "TOP_JOURNAL"),
    ]


def rejection_rules(engine: str = "spark") -> list[rules.Rule]:
    return [(hit(f"{where}_", pattern, engine), name) for name, where, pattern in V.REJECTIONS]


def score_rules() -> list[tuple[str, int, str]]:
    found = [(" OR ".join(f"contains(text_, {quoted(t)})" for t in terms), points, label) for terms, points, label in V.SCORE_TERMS]
    commentary = " OR ".join(f"contains(concat('|', types_, '|'), {quoted(f'|{t}|')})" for t in V.COMMENTARY_TYPES)
    silent = "(contains(text_, 'not_reported') OR contains(text_, 'not reported')) AND contains(text_, 'primary endpoint')"
    return [*found, (commentary, -15, "Editorial/review"), (silent, -10, "Uninterpretable Phase III")]


def gate(candidates: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """Adds hard_excluded, exclusion_reason, qualifying_signal, rejection_reason, signal_score and signal_labels.

    ``candidates`` has title, abstract, journal, conference_source and
    publication_types (an array, or text joined by '|'); ``watched`` lists trial
    names (trial) that admit a record by themselves.
    """
    types = F.col("publication_types")
    if dict(candidates.dtypes)["publication_types"].startswith("array"):
        types = F.array_join(F.transform(types, F.lower), "|")
    rows = candidates.withColumns({
        "title_": F.lower(F.coalesce("title", F.lit(""))), "text_": F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("abstract", F.lit("")))),
        "journal_": F.lower(F.trim(F.coalesce("journal", F.lit("")))), "source_": F.upper(F.coalesce("conference_source", F.lit(""))), "types_": F.lower(F.coalesce(types, F.lit(""))),
    })
    if watched is None:
        rows = rows.withColumn("watched_", F.lit(False))
    else:
        # the watchlist is a dimension: names become one set, and a record's words are looked up in it
        names = watched.select(F.lower(F.trim("trial")).alias("t")).where("t <> ''").agg(F.collect_set("t").alias("names"))
        words = F.regexp_extract_all("text_", F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)*)"), 1)
        rows = rows.crossJoin(F.broadcast(names)).withColumn("watched_", F.arrays_overlap(F.array_distinct(words), "names")).drop("names")
    excluded = F.coalesce(F.nullif(F.regexp_extract("text_", V.HARD_EXCLUDE, 0), F.lit("")), F.nullif(F.regexp_extract("title_", V.HARD_EXCLUDE_TITLE, 0), F.lit("")))
    rows = rows.withColumn("exclusion_reason", F.trim(excluded)).withColumn("hard_excluded", F.col("exclusion_reason").isNotNull())
    rows = rows.withColumn("signal_", F.when(F.col("hard_excluded"), F.lit(NONE)).otherwise(rules.first_match(signal_rules(), NONE)))
    weak = F.expr(f"signal_ IN ('META_ANALYSIS', 'PHASE_II_RANDOMIZED') AND NOT {journal_test('journal_', V.SOUND_JOURNALS, 10)}")
    rows = rows.withColumn("qualifying_signal", F.when(weak, F.lit(NONE)).otherwise(F.col("signal_")))
    rejected = F.when(F.col("hard_excluded") | (F.col("qualifying_signal") != NONE), F.lit(None).cast("string")).when(weak, F.lit("non_whitelist_journal")).otherwise(rules.first_match(rejection_rules(), "no_qualifying_signal"))
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in V.SIGNAL_BASE.items() for x in kv)), F.col("qualifying_signal")), F.lit(0))
    added = rules.additive_score(score_rules())
    rows = rows.withColumns({"rejection_reason": rejected, "added_": added, "base_": base})
    qualified = F.col("qualifying_signal") != NONE
    out = rows.withColumns({"signal_score": F.when(qualified, F.greatest(F.lit(0), F.col("base_") + F.col("added_.score"))).otherwise(0).cast("int"), "signal_labels": F.when(qualified, F.col("added_.labels"))})
    return out.drop("title_", "text_", "journal_", "source_", "types_", "watched_", "signal_", "added_", "base_")


def keep_decision() -> str:
    """The ordered keep rules of a first review (columns: site_correct, keep, force_keep, score, hint) as a CASE."""
    return rules.case_sql([("NOT site_correct AND NOT keep", "drop: wrong site"), ("force_keep", "keep: forced"), ("NOT keep", "drop: reviewer"), ("score >= 50", "keep: score"), ("hint = 'high' AND score >= 40", "keep: high hint")], "drop: score")


def route_without_signal() -> str:
    """Where a record without a signal goes (columns: relevance, keep, review_score)."""
    return rules.case_sql([("relevance < 40", "reject"), ("review_score >= 65 AND keep", "promote"), ("review_score >= 45 AND keep", "quarantine")], "reject")


def priority_hint(column: str) -> str:
    return rules.case_sql([(f"{column} >= 45", "high"), (f"{column} >= 25", "medium")], "low")
