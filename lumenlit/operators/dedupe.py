"""Entity resolution: exact, best-of-group and approximate."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules
from lumenlit.functions.columns import unused
from lumenlit.functions.similarity import Known, between, first_copies, has_text, shaped, slices
from lumenlit.functions.text import collapsed
from lumenlit.scratch import Scratch

MAX_ROUNDS = 200


def best_per_key(rows: DataFrame, keys: list[Column], order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in a total order; rows whose keys are all null pass untouched."""
    place = unused("place", rows.columns)
    named = keys[0].isNotNull()
    for k in keys[1:]:
        named = named | k.isNotNull()
    ranked = rows.where(named).withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= keep).drop(place)
    return ranked.unionByName(rows.where(~named))


def quality(abstract: Column, pmc: Column, journal: Column) -> Column:
    """50 for an abstract, 5 for an open full text, and up to 50 for the journal."""
    return F.when(F.coalesce(abstract, F.lit("")) != "", 50).otherwise(0) + F.when(F.coalesce(pmc, F.lit("")) != "", 5).otherwise(0) + F.greatest(F.lit(0), 50 - rules.name_rank(F.lower(journal), V.JOURNAL_RANK, V.DEFAULT_JOURNAL_RANK))


def hard_dedupe(records: DataFrame, quality_column: str, order: str, identifier: str = "pmid", doi: str = "doi", compat_empty: bool = False) -> DataFrame:
    """The first row of each identifier, then of each DOI (case aside) the one of best quality, the earlier of equals.

    Rows without an identifier or DOI are not merged by it; ``compat_empty`` makes
    all rows with an empty identifier one, as a plain fold does.  A row of an
    identifier that lost on its DOI is not reconsidered.
    """
    empty = F.coalesce(F.col(identifier), F.lit(""))
    key = empty if compat_empty else F.nullif(empty, F.lit(""))
    first = best_per_key(records, [key], [F.col(order)])
    return best_per_key(first, [F.nullif(F.lower(F.trim(F.col(doi))), F.lit(""))], [F.col(quality_column).desc(), F.col(order)])


def independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node) that a greedy pass in ascending order keeps: each unless an already kept one is its neighbour.

    ``edges``: first < second.  In every round the nodes without an undecided
    earlier neighbour are kept, and their later neighbours dropped.
    """
    scratch = Scratch(nodes.sparkSession, "independent")
    edges = scratch.cut(edges.select("first", "second").distinct(), "edges-0")
    dropped = scratch.cut(edges.select(F.col("second").alias("node")).where("false"), "dropped-0")
    for number in range(1, MAX_ROUNDS + 1):
        if edges.isEmpty():
            return nodes.select("node").join(dropped, "node", "left_anti")
        leaders = edges.select(F.col("first").alias("node")).distinct().join(edges.select(F.col("second").alias("node")).distinct(), "node", "left_anti")
        lost = scratch.cut(edges.join(leaders.withColumnRenamed("node", "first"), "first", "left_semi").select(F.col("second").alias("node")).distinct(), f"lost-{number}")
        gone = lost.withColumnRenamed("node", "second")
        left = edges.join(leaders.withColumnRenamed("node", "first"), "first", "left_anti").join(gone, "second", "left_anti").join(gone.withColumnRenamed("second", "first"), "first", "left_anti")
        edges = scratch.cut(left, f"edges-{number}")
        dropped = scratch.cut(dropped.unionByName(lost), f"dropped-{number}")
    raise RuntimeError(f"not settled after {MAX_ROUNDS} rounds")


FIRST_ROWS = 2000  # of the first slice: copies are frequent there, and later slices lose theirs to it


def without_copies(rows: DataFrame, threshold: float, days: int | None = None) -> DataFrame:
    """k of the rows (as ``similarity.shaped``) that a greedy pass in ascending order keeps: each unless it is a copy of one already kept.

    The pass goes by slices.  One task keeps the first copies of a slice, and all
    tasks drop from the later rows what is a copy of these, so the pairs of texts
    that are both copies of an earlier one are never compared.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "copies")
    left = scratch.cut(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "left-0")
    kept = []
    for number, (_, upto) in enumerate(slices(left, FIRST_ROWS)):
        kept.append(scratch.cut(first_copies(between(left, None, upto), threshold, days), f"kept-{number}"))
        if upto is not None:
            left = _dropped(scratch, kept[-1], between(left, upto, None), threshold, days, f"left-{number + 1}")
        scratch.drop(f"left-{number}")
    return reduce(DataFrame.unionByName, kept).select("k")


def _dropped(scratch: Scratch, known: DataFrame, rows: DataFrame, threshold: float, days: int | None, name: str) -> DataFrame:
    held = Known(known)
    left = scratch.cut(held.without_copies(rows, threshold, days), name)
    held.shared.destroy()
    return left


def _with_kept(rows: DataFrame, order: str, title: str, kept: DataFrame) -> DataFrame:
    """Rows without a title, and those kept."""
    return rows.where(~has_text(title)).unionByName(rows.where(has_text(title)).join(kept.withColumnRenamed("k", order), order, "left_semi"))


def fuzzy_dedupe(records: DataFrame, order: str, title: str = "title", date: str = "pub_date", threshold: float = 0.92, days: int = 7) -> DataFrame:
    """Records without the near copies of better ones.

    ``order`` is a unique number, the best record first.  Two records are copies
    if their titles reach the ratio and their dates lie within the days (unknown
    dates do).  Records without a title are kept.
    """
    return _with_kept(records, order, title, without_copies(shaped(records, order, title, date), threshold, days))


def trial_dedupe(rows: DataFrame, name: str, title: str, order: str, threshold: float = 0.88) -> DataFrame:
    """One row per named trial (the first in ``order``, a unique number), and the unnamed rows that resemble neither a named winner nor a better unnamed row."""
    key = F.nullif(F.lower(F.trim(F.col(name))), F.lit(""))
    named = best_per_key(rows.where(key.isNotNull()), [key], [F.col(order)])
    unnamed = rows.where(key.isNull())
    scratch = Scratch(rows.sparkSession, "trials")
    winners = scratch.cut(shaped(named, order, title), "winners")
    rest = scratch.cut(shaped(unnamed, order, title).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rest-0")
    for number, bounds in enumerate(slices(winners)):
        rest = _dropped(scratch, between(winners, *bounds), rest, threshold, None, f"rest-{number + 1}")
        scratch.drop(f"rest-{number}")
    kept = without_copies(rest, threshold)
    scratch.close()
    return named.unionByName(_with_kept(unnamed, order, title, kept))


def seen_key(identifier: Column, title: Column) -> Column:
    """The identifier, else a key made of the start of the title."""
    return F.coalesce(F.nullif(F.trim(identifier), F.lit("")), F.concat(F.lit("title:"), F.substring(collapsed(title), 1, 200)))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those already seen; rows without a key pass."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def first_claim(rows: DataFrame, key: str, site_order: str, order: str) -> DataFrame:
    """Each key's rows of the site that comes first, and of these the first."""
    return best_per_key(rows, [F.col(key)], [F.col(site_order), F.col(order)])


def suppress(rows: DataFrame, prior: DataFrame, name: str, exempt: Column) -> DataFrame:
    """Rows unless their name occurred before; exempt rows and rows without a name pass."""
    key = F.lower(F.trim(F.col(name)))
    guarded = F.coalesce(~exempt, F.lit(True)) & (F.coalesce(key, F.lit("")) != "")
    known = prior.select(F.lower(F.trim(F.col(name))).alias("known_name")).where("known_name <> ''").distinct()
    checked = rows.where(guarded).join(known, key == F.col("known_name"), "left_anti")
    return checked.unionByName(rows.where(~guarded))


MOST_SUBSETS = 500  # of one set for one size of partner; beyond it the pairs themselves are compared


def least_common(a: int, b: int, threshold: float) -> int:
    """The least number of common elements with which sets of these sizes reach the Jaccard threshold; at least 1."""
    return next((c for c in range(1, min(a, b) + 1) if c >= threshold * (a + b - c)), min(a, b) + 1)


def _by_subsets(a: int, b: int, threshold: float) -> bool:
    need = least_common(a, b, threshold)
    return max(math.comb(a, need), math.comb(b, need)) <= MOST_SUBSETS


def _subset_keys(partners: list[int], threshold: float, asked: bool):  # noqa: ANN202
    """A function of a column of sets: the subsets in which a set may meet one of a partner's sizes, with both sizes."""

    @F.pandas_udf("array<string>")
    def keys(sets: pd.Series) -> pd.Series:
        out = []
        for words in sets:
            found, n = [], len(words)
            for m in partners:
                a, b = (n, m) if asked else (m, n)
                need = least_common(a, b, threshold)
                if need <= min(a, b) and _by_subsets(a, b, threshold):
                    found += [f"{a} {b} " + "\x1f".join(some) for some in combinations(words, need)]
            out.append(found)
        return pd.Series(out)

    return keys


def title_gaps(wanted: DataFrame, present: DataFrame, key: str, tokens: str, threshold: float = 0.35) -> DataFrame:
    """The wanted rows that no present title resembles by its set of words.

    Exact: sets of given sizes reach the threshold if and only if they have a
    certain number of words in common, that is if they share a subset of that
    size.  So sizes and subset are the key of a semi-join, and no pair is
    compared.  Where a set has too many such subsets, pairs
    that share one of the rarest words of each (all but the commonest
    ``threshold`` of them) are compared.
    """
    spark = wanted.sparkSession
    side = lambda df: df.select(F.array_sort(tokens).alias("set")).where("size(set) > 0").distinct()
    asked, offered = side(wanted), side(present)
    sizes_of = lambda df: sorted(r.n for r in df.select(F.size("set").alias("n")).distinct().collect())  # noqa: E731  a row for each size of a title
    asked_sizes, offered_sizes = sizes_of(asked), sizes_of(offered)
    keyed = asked.select(F.col("set").alias("a"), F.explode(_subset_keys(offered_sizes, threshold, True)("set")).alias("key"))
    # merge joins: sizes are estimated without the subsets, so that any of these would be sent to the driver as if it were small
    near = keyed.join(offered.select(F.explode(_subset_keys(asked_sizes, threshold, False)("set")).alias("key")).distinct().hint("merge"), "key", "left_semi").select("a")
    many = [(a, b) for a in asked_sizes for b in offered_sizes if least_common(a, b, threshold) <= min(a, b) and not _by_subsets(a, b, threshold)]
    if many:
        near = near.unionByName(_near_by_pairs(asked, offered, spark.createDataFrame(many, "na int, nb int"), threshold))
    return wanted.withColumn("a", F.array_sort(tokens)).join(near.distinct().hint("merge"), "a", "left_anti").drop("a")


def _near_by_pairs(asked: DataFrame, offered: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """a: the asked sets that reach the threshold with an offered set, where both sizes are a row of ``sizes``."""
    asked = asked.join(F.broadcast(sizes.select("na").distinct()), F.size("set") == F.col("na"), "left_semi")
    offered = offered.join(F.broadcast(sizes.select("nb").distinct()), F.size("set") == F.col("nb"), "left_semi")
    frequency = asked.unionByName(offered).select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("often"))

    def indexed(sets: DataFrame, name: str) -> DataFrame:
        worded = sets.select(F.col("set").alias(name), F.explode("set").alias("token")).join(frequency.hint("merge"), "token")
        rarest = worded.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ranked"))
        most = F.size(name) - F.ceil(F.size(name) * threshold).cast("int") + 1
        return rarest.select(name, F.explode(F.transform(F.slice("ranked", F.lit(1), most), lambda r: r["token"])).alias("token"))

    # few bytes but many pairs: a fixed number of partitions keeps the work spread
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = indexed(asked, "a").repartition(parts, "token").join(indexed(offered, "b").repartition(parts, "token").hint("merge"), "token")
    near_sizes = (F.size("b") >= F.size("a") * threshold) & (F.size("a") >= F.size("b") * threshold)
    common = F.size(F.array_intersect("a", "b"))
    return pairs.where(near_sizes).where(common >= threshold * (F.size("a") + F.size("b") - common)).select("a").distinct()
