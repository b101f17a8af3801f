"""Groups from pairwise links by random contraction of the link graph.

In each round every vertex hooks to the vertex of its closed neighbourhood that
comes first in a hash order drawn afresh for the round; edges are relabelled
by these representatives, loops and repeats dropped.  A constant share of the
vertices vanishes in every round in expectation, whatever the shape of the graph
(long chains as well as stars), so a logarithmic number of rounds suffices.
The rounds' mappings are expanded from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.scratch import Scratch

MAX_ROUNDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.v", "e.u")


def connected_groups(links: DataFrame, a: str, b: str, seed: int = 17) -> DataFrame:
    """vertex and group_id (the smallest vertex of its group) of every vertex with a link to another.

    Links may come in either order and repeatedly; self-links and links with a
    null end connect nothing.  Vertices are of type long.  No links: no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    usable = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    edges = scratch.cut(usable.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges-0")
    mappings: list[DataFrame] = []
    for number in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        # the hash order is packed with the id: (hash, id) of the vertex itself and of its neighbours
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed + number)).alias("h"), F.col(c).alias("id"))
        rep = _both_ways(edges).groupBy("v").agg(F.min(key("u")).alias("near")).select("v", F.least(key("v"), F.col("near"))["id"].alias("rep"))
        rep = scratch.cut(rep, f"map-{number}")
        mappings.append(rep)
        moved = edges.join(rep.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b")
        moved = moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = scratch.cut(moved, f"edges-{number + 1}")
        scratch.drop(f"edges-{number}")
    else:
        raise RuntimeError(f"not contracted after {MAX_ROUNDS} rounds")
    if not mappings:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("group_id")).where("false")
    roots = mappings[-1]
    for earlier in reversed(mappings[:-1]):
        # a representative missing from the later rounds is already the root of a finished group
        later = roots.select(F.col("v").alias("rep"), F.col("rep").alias("root"))
        roots = earlier.join(later, "rep", "left").select("v", F.coalesce("root", "rep").alias("rep"))
    roots = scratch.cut(roots, "roots")
    for number in range(len(mappings)):
        scratch.drop(f"map-{number}")
    smallest = roots.groupBy("rep").agg(F.min("v").alias("group_id"))
    return roots.join(smallest, "rep").select(F.col("v").alias("vertex"), "group_id")


def current_links(pairs: DataFrame, left: str = "left_id", right: str = "right_id", status: str = "status", decided: str = "decided_at") -> DataFrame:
    """The unordered pairs (a, b) whose latest decision is a match.

    A null decision time counts as oldest; of decisions at the same time a
    rejection wins.  Pairs with a null id or two equal ids are left out.
    """
    named = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    verdict = F.struct(F.coalesce(F.unix_micros(F.col(decided)), F.lit(-(2**62))).alias("at"), F.coalesce(F.col(status) != "match", F.lit(True)).alias("no"))
    latest = named.groupBy(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).agg(F.max(verdict).alias("last"))
    return latest.where("not last.no").select("a", "b")


def evidence_groups(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """evidence_id and group_id of each row linked to another row that exists."""
    known = evidence.select("evidence_id").where("evidence_id is not null").distinct()
    links = current_links(pairs)
    for end in ("a", "b"):
        links = links.join(known.select(F.col("evidence_id").alias(end)), end, "left_semi")
    return connected_groups(links, "a", "b").select(F.col("vertex").alias("evidence_id"), "group_id")
