"""Documents packed whole into containers of one fixed capacity.

A shard of documents is packed by bin completion: the best-fit-decreasing
packing is the incumbent; while it needs more containers than the volume bound,
a depth-first search takes the largest unplaced document, enumerates the
undominated sets of documents that fill up its container, fullest first, and
gives up a branch when the room wasted so far leaves no hope of saving a
container.  A filling is dominated if an unplaced larger document fits in the
place of one or two of its own.  The search has limits (nodes a shard, looks and
fillings a container), which are parameters: with None it is exhaustive.  Where a
limit ended it, its best packing stands and is marked as not proved.

Shards are hash classes of a size that one task packs easily; what lands in
containers that are not well filled is pooled and packed again, so the loss at
shard borders does not grow with the number of shards.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.scratch import Scratch

CAPACITY = 2048
CONTAINERS_PER_SHARD = 256
SHARDS_PER_TASK = 16
NODES, FILLINGS, LOOK = 4_000, 6, 400
WELL_FILLED = 0.97


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers; each item goes, largest first, where it leaves least room."""
    room: list[tuple[int, int]] = []  # (room, container), sorted
    containers: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, c = room.pop(at)
            containers[c].append(i)
            left -= sizes[i]
        else:
            c, left = len(containers), capacity - sizes[i]
            containers.append([i])
        bisect.insort(room, (left, c))
    return containers


def fillings(counts: dict[int, int], order: list[int], room: int, most_waste: int, most: int | None = FILLINGS, look: int | None = LOOK, ended: list[str] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated multisets of sizes from ``order`` (descending, with counts) that leave at most ``most_waste`` of ``room``, fullest first.

    With limits, no more than ``look`` steps are taken, and ``most`` fillings once a perfect one is among them; what a limit cut off is noted in ``ended``.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0

    def stopped() -> bool:
        over = (look is not None and looked > look) or (most is not None and bool(found) and found[0][0] == 0 and len(found) >= most)
        if over and ended is not None and not ended:
            ended.append("fillings")
        return over

    def grow(at: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal looked
        looked += 1
        if stopped():
            return
        fits = False
        used = 0
        for k in range(bisect.bisect_left(order, -left, key=lambda s: -s) if at == 0 or order[at] > left else at, len(order)):
            size = order[k]
            if size > left:
                continue
            used = chosen.count(size)
            if used < counts[size]:
                fits = True
                grow(k, left - size, (*chosen, size))
                if stopped():
                    break
        if not fits and left <= most_waste:
            bisect.insort(found, (left, chosen))

    if order:
        grow(0, room, ())
    elif room <= most_waste:
        found.append((room, ()))
    seen = set()
    for waste, chosen in found:
        key = tuple(sorted(chosen, reverse=True))
        if key in seen or _dominated(key, waste, counts, order):
            continue
        seen.add(key)
        yield key


def _dominated(chosen: tuple[int, ...], waste: int, counts: dict[int, int], order: list[int]) -> bool:
    """Whether an unplaced larger document fits where one or two of the chosen are."""
    parts = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    for part in parts:
        at = bisect.bisect_left(order, -(part + waste), key=lambda s: -s)
        while at < len(order) and order[at] > part:
            if chosen.count(order[at]) < counts[order[at]]:
                return True
            at += 1
    return False


def complete_bins(sizes: list[int], capacity: int, nodes: int | None = NODES, most: int | None = FILLINGS, look: int | None = LOOK) -> list[list[int]]:
    """The packing of items (none above capacity) by bin completion, as lists of item numbers."""
    return proved_bins(sizes, capacity, nodes, most, look)[0]


def proved_bins(sizes: list[int], capacity: int, nodes: int | None = NODES, most: int | None = FILLINGS, look: int | None = LOOK) -> tuple[list[list[int]], bool]:
    """The packing, and whether no other needs fewer containers: it meets the volume bound, or the whole search was made."""
    ended: list[str] = []
    incumbent = best_fit_decreasing(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    if len(incumbent) <= bound or not sizes:
        return incumbent, True
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    order = sorted(counts, reverse=True)
    best: list[tuple[int, ...]] | None = None
    target, spent = len(incumbent) - 1, 0

    def take(size: int) -> None:
        counts[size] -= 1
        if not counts[size]:
            order.pop(bisect.bisect_left(order, -size, key=lambda s: -s))

    def give(size: int) -> None:
        if not counts[size]:
            bisect.insort(order, size, key=lambda s: -s)
        counts[size] += 1

    # depth-first over containers, with an explicit stack: (filling in place, the fillings still to try, waste before it)
    allowed = target * capacity - total
    stack: list[tuple[tuple[int, ...], Iterator[tuple[int, ...]], int]] = []

    def open_next(waste: int) -> tuple[tuple[int, ...], Iterator[tuple[int, ...]], int]:
        largest = order[0]
        take(largest)
        return (largest,), fillings(counts, list(order), capacity - largest, allowed - waste, most, look, ended), waste

    stack.append(open_next(0))
    while stack and (nodes is None or spent < nodes):
        placed, rest, waste = stack.pop()
        for s in placed[1:]:
            give(s)
        more = next(rest, None)
        spent += 1
        if more is None:
            give(placed[0])
            continue
        for s in more:
            take(s)
        placed = (placed[0], *more)
        stack.append((placed, rest, waste))
        wasted = waste + capacity - sum(placed)
        if not order:
            best = [p for p, _, _ in stack]
            if len(best) <= bound:
                break
            allowed = (len(best) - 1) * capacity - total
            continue
        if wasted <= allowed:
            stack.append(open_next(wasted))
    proved = (not stack and not ended) or (best is not None and len(best) <= bound)
    if best is None or len(best) >= len(incumbent):
        return incumbent, proved
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[i], []).append(i)
    return [[by_size[s].pop() for s in placed] for placed in best], proved


def _pack_round(items: DataFrame, capacity: int, shards: int, label: str, limits: tuple[int | None, int | None, int | None]) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        shard = int(pdf["shard"].iloc[0])
        where, fill = [""] * len(pdf), [0] * len(pdf)
        sizes = pdf["tokens"].astype(int).tolist()
        packed, proved = proved_bins(sizes, capacity, *limits)
        for c, members in enumerate(packed):
            used = sum(sizes[i] for i in members)
            for i in members:
                where[i], fill[i] = f"{label}-{shard}-{c}", used
        return pdf.assign(container_id=where, filled=fill, proved=proved)[["container_id", "doc_id", "piece", "first_token", "tokens", "filled", "proved"]]

    salted = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(label)), F.lit(shards)).cast("int"))
    # shards are few bytes but much work, so every few of them are a task of their own
    tasks = max(min(shards, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))), math.ceil(shards / SHARDS_PER_TASK))
    return salted.repartition(tasks, "shard").groupBy("shard").applyInPandas(pack, "container_id string, doc_id long, piece int, first_token long, tokens long, filled long, proved boolean")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODES, most: int | None = FILLINGS, look: int | None = LOOK) -> DataFrame:
    """container_id, doc_id, piece, first_token, tokens, filled (the container's tokens) and proved of every document.

    ``documents``: doc_id, tokens.  A document above the capacity is divided into
    pieces of exactly the capacity and a rest; every other one stays whole.
    Documents of size 0 or null size are placed like any other, at no cost.  No
    documents, no containers.  ``proved`` says that the container's shard cannot do
    with fewer containers; with ``nodes``, ``most`` and ``look`` None every shard is
    proved, however long that takes.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    items = documents.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    whole = F.expr(f"cast(tokens div {capacity} as int)")
    pieces = items.withColumn("last", F.when(F.col("tokens") <= capacity, 0).otherwise(F.when(F.col("tokens") % capacity == 0, whole - 1).otherwise(whole)))
    pieces = pieces.select("doc_id", F.col("tokens").alias("all_tokens"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("all_tokens") - F.col("piece").cast("long") * capacity).alias("tokens"))
    pieces = scratch.cut(pieces, "pieces")
    full = pieces.where(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "first_token", "tokens", F.col("tokens").alias("filled"), F.lit(True).alias("proved"))
    rest = pieces.where(F.col("tokens") < capacity)
    shards_for = lambda df: max(1, math.ceil((df.agg(F.sum("tokens") + F.count("*")).first()[0] or 0) / (capacity * CONTAINERS_PER_SHARD)))
    first = scratch.cut(_pack_round(rest, capacity, shards_for(rest), "a", (nodes, most, look)), "first")
    poor = first.where(F.col("filled") < WELL_FILLED * capacity)
    second = _pack_round(poor.drop("container_id", "filled", "proved"), capacity, shards_for(poor), "b", (nodes, most, look))
    return full.unionByName(first.where(F.col("filled") >= WELL_FILLED * capacity)).unionByName(second)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, their least possible number, tokens, the share of room left over, and the shards whose search a limit ended."""
    shard = F.when(~F.col("proved"), F.regexp_replace("container_id", "-[0-9]+$", ""))
    totals = packed.agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.count_distinct(shard).alias("shards_by_limit"))
    return totals.select("containers", F.ceil(F.coalesce("tokens", F.lit(0)) / capacity).alias("least_containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "pieces", F.round(1 - F.try_divide("tokens", F.col("containers") * capacity), 6).alias("waste"), "shards_by_limit")
