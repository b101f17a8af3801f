"""Rule sets as data: ordered decision lists, additive scores, term and name matching.

A condition is a SQL predicate string, so that the same rule set runs in any
engine; every function returns a Column that stays inside code generation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def case_sql(rules: Sequence[Rule], default: str | None) -> str:
    """A CASE expression that gives the value of the first rule whose condition holds."""
    branches = " ".join(f"WHEN {condition} THEN {quoted(value)}" for condition, value in rules)
    return f"CASE {branches} ELSE {'NULL' if default is None else quoted(default)} END"


def first_match(rules: Sequence[Rule], default: str | None) -> Column:
    return F.expr(case_sql(rules, default))


def points_sql(rules: Sequence[tuple[str, int, str]], least: int | None = None, most: int | None = None) -> str:
    """The sum of the points of all rules that hold, clamped."""
    total = " + ".join(f"CASE WHEN {condition} THEN {points} ELSE 0 END" for condition, points, _ in rules) or "0"
    if most is not None:
        total = f"least({most}, {total})"
    return f"greatest({least}, {total})" if least is not None else total


def additive_score(rules: Sequence[tuple[str, int, str]], least: int | None = None, most: int | None = None) -> Column:
    """A struct of the clamped score and the labels of the rules that hold, in rule order."""
    labels = F.filter(F.array(*(F.when(F.expr(c), F.lit(f"{label} {points:+d}")) for c, points, label in rules)), lambda x: x.isNotNull())
    return F.struct(F.expr(points_sql(rules, least, most)).cast("int").alias("score"), labels.alias("labels"))


def any_word(terms: Sequence[str], whole: bool = True) -> str:
    """One case-insensitive pattern that finds any of the terms, as whole words or anywhere."""
    body = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)
    return rf"(?i)\b(?:{body})\b" if whole else f"(?i)(?:{body})"


def names_match(value: Column, names: Sequence[str], least: int = 0) -> Column:
    """Whether a lower-case value equals, contains or is contained in one of the names; the latter two from ``least`` characters of the name on. An empty value is contained in every name."""
    long_ones = [n for n in names if len(n) >= least]
    loose = (value.rlike("|".join(map(re.escape, long_ones))) | F.lit("|".join(long_ones)).contains(value)) if long_ones else F.lit(False)
    return F.coalesce(value.isin(list(names)) | loose, F.lit(False))


def name_rank(value: Column, names: Sequence[str], default: int) -> Column:
    """The position of the equal name, else of the first that contains or is contained in the value, else the default; also for null and empty values."""
    exact = F.coalesce(*[F.when(value == n, F.lit(i)) for i, n in enumerate(names)])
    loose = F.coalesce(*[F.when(value.contains(n) | F.lit(n).contains(value), F.lit(i)) for i, n in enumerate(names)])
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(exact, loose, F.lit(default))).cast("int")
