"""Mixed timestamp formats and time zones brought to one unambiguous form.

Every value gives an array of readings.  Of the readings along a source's
record order the cheapest path is taken (Viterbi): a reading against the
source's declared convention, a change of layout and a step back in time cost
something.  The chain of a source is cut into blocks that are solved side by
side: a block yields, for each reading of its first and each of its last row,
the cost of the best path between them (a min-plus matrix) and that path.  The
few block matrices of a source are then chained exactly, and each row looks up
its reading.  The result equals Viterbi over the unbroken chain, while no task
holds more than a partition's stream and a source's block summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.functions.datetimes import readings
from lumenlit.scratch import Scratch

CONTRARY, SWITCH, BACK, SLACK_S = 50.0, 1.0, 2.0, 2 * 86_400
BLOCK_ROWS = 4096
_ORDERS = {"day_month_year": "D", "month_day_year": "M"}

_ROW_SCHEMA = "table_name string, record_id long, delivered timestamp, part int, block int, moments array<string>, contrary array<boolean>, choice array<int>, summary struct<source: string, first_form: array<string>, first_at: array<long>, last_form: array<string>, last_at: array<long>, cost: array<double>>"
_ARROW = pa.schema([
    ("table_name", pa.string()), ("record_id", pa.int64()), ("delivered", pa.timestamp("us", "UTC")), ("part", pa.int32()), ("block", pa.int32()),
    ("moments", pa.list_(pa.string())), ("contrary", pa.list_(pa.bool_())), ("choice", pa.list_(pa.int32())),
    ("summary", pa.struct([("source", pa.string()), ("first_form", pa.list_(pa.string())), ("first_at", pa.list_(pa.int64())), ("last_form", pa.list_(pa.string())), ("last_at", pa.list_(pa.int64())), ("cost", pa.list_(pa.float64()))])),
])


def step_cost(form_a: str, at_a: int, form_b: str, at_b: int) -> float:
    """The price of one reading following another."""
    return (SWITCH if form_a != form_b else 0.0) + (BACK if at_b < at_a - SLACK_S else 0.0)


def own_cost(form: str, order: str | None) -> float:
    """The price of a reading by itself: that of breaking the source's declared day/month order."""
    return CONTRARY if order and form != "day_month_year" and order == "D" and form in ("month_day_year", "short_year_month_day") or order == "M" and form in ("day_month_year", "short_year_month_day") else 0.0


def solve_block(rows: list[list[tuple[str, int, str]]], own: list[list[float]]) -> tuple[list[list[int]], list[float]]:
    """Best paths through one block for each reading of its first and last row.

    Returns, per row, the chosen reading for each (first, last) pair in row-major
    order, and the path costs, the first row's own cost included.
    """
    first, last, n = len(rows[0]), len(rows[-1]), len(rows)
    if first == last == 1 and all(len(x) == 1 for x in rows):
        cost = own[0][0] + sum(step_cost(*rows[i - 1][0][:2], *rows[i][0][:2]) + own[i][0] for i in range(1, n))
        return [[0]] * n, [cost]
    choice: list[list[int]] = [[0] * (first * last) for _ in range(n)]
    costs = [float("inf")] * (first * last)
    for f in range(first):
        best = [own[0][k] if k == f else float("inf") for k in range(first)]
        back: list[list[int]] = []
        for i in range(1, n):
            now, came = [], []
            for k, (form, at, _) in enumerate(rows[i]):
                c, j = min((best[j] + step_cost(fj, aj, form, at), j) for j, (fj, aj, _) in enumerate(rows[i - 1]))
                now.append(c + own[i][k])
                came.append(j)
            best = now
            back.append(came)
        for end in range(last):
            if n == 1 and end != f:
                continue
            costs[f * last + end], k = best[end], end
            for i in range(n - 1, -1, -1):
                choice[i][f * last + end] = k
                if i:
                    k = back[i - 1][k]
    return choice, costs


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number, source, held, out = 0, None, [], []

    def close() -> None:
        nonlocal number
        rows, own = [h[3] for h in held], [h[4] for h in held]
        choice, cost = solve_block(rows, own)
        summary = {"source": source, "first_form": [r[0] for r in rows[0]], "first_at": [r[1] for r in rows[0]], "last_form": [r[0] for r in rows[-1]], "last_at": [r[1] for r in rows[-1]], "cost": cost}
        for i, h in enumerate(held):
            out.append((h[0], h[1], h[2], part, number, [r[2] for r in h[3]], [c > 0 for c in h[4]], choice[i], summary if i == 0 else None))
        number += 1
        held.clear()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(col, t.type) for col, t in zip(zip(*out), _ARROW)], schema=_ARROW)
        out.clear()
        return batch

    for batch in batches:
        for src, name, rid, delivered, raw, zone, order in zip(*(batch.column(c).to_pylist() if c != "delivered" else batch.column(c) for c in ("source", "table_name", "record_id", "delivered", "raw", "home_zone", "day_month"))):
            found = readings(raw, zone)
            if not found:
                continue
            if held and (src != source or len(held) >= BLOCK_ROWS):
                close()
            source = src
            held.append((name, rid, delivered.as_py(), found, [own_cost(x[0], order) for x in found]))
        if len(out) >= 8 * BLOCK_ROWS:
            yield flush()
    if held:
        close()
    if out:
        yield flush()


def chain_blocks(summaries: list[dict]) -> list[int]:
    """Chain one source's block matrices in order; the picked (first, last) pair of each block."""
    best: list[float] = []
    trail: list[list[tuple[int, int]]] = []  # per block and end reading: the first reading used, the end reading before
    for i, s in enumerate(summaries):
        first, last = len(s["first_form"]), len(s["last_form"])
        entry = [(0.0, 0)] * first
        if i:
            p = summaries[i - 1]
            entry = [min((best[j] + step_cost(p["last_form"][j], p["last_at"][j], s["first_form"][f], s["first_at"][f]), j) for j in range(len(best))) for f in range(first)]
        now, came = [], []
        for end in range(last):
            c, f = min((entry[f][0] + s["cost"][f * last + end], f) for f in range(first))
            now.append(c)
            came.append((f, entry[f][1]))
        best = now
        trail.append(came)
    picks, end = [], min(range(len(best)), key=best.__getitem__)
    for i in range(len(summaries) - 1, -1, -1):
        f, before = trail[i][end]
        picks.append(f * len(summaries[i]["last_form"]) + end)
        end = before
    return picks[::-1]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream block summaries sorted by source and place; only one source's summaries are held."""
    types = [pa.int32()] * 3
    keys: list[tuple[int, int]] = []
    held: list[dict] = []

    def close() -> list[tuple[int, int, int]]:
        done = [(part, block, pick) for (part, block), pick in zip(keys, chain_blocks(held))] if held else []
        keys.clear()
        held.clear()
        return done

    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for part, block, summary in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "summary"))):
            if held and held[-1]["source"] != summary["source"]:
                out += close()
            keys.append((part, block))
            held.append(summary)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "block", "pick"])
    if out := close():
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "block", "pick"])


def normalise_timestamps(values: DataFrame, strict: bool = True) -> DataFrame:
    """One moment for each record whose date can be read.

    ``values``: table_name, record_id (long), source, delivered (timestamp), raw
    (the written date), home_zone (IANA, for times without a zone) and day_month
    ('D' or 'M' for the declared order of numeric dates, null if unknown).
    Returns table_name, record_id, moment; further columns are ignored.

    Null, blank and wordy values, impossible dates and unknown zones give no
    row.  With ``strict`` a numeric date that is possible only against the
    declared order counts as impossible.  A record delivered several times comes
    out once, with the reading of its latest readable delivery (equal times: the
    greater moment).  A null source or delivery time is a value of its own that
    sorts first.  An empty input gives an empty result.
    """
    scratch = Scratch(values.sparkSession, "timestamps")
    columns = ["source", "table_name", "record_id", "delivered", "raw", "home_zone", "day_month"]
    ordered = (
        values.select(*columns)
        .where(F.col("raw").isNotNull() & F.col("raw").rlike("[0-9]"))
        .withColumns({"home_zone": F.coalesce("home_zone", F.lit("UTC")), "source": F.coalesce("source", F.lit(""))})
    )
    ordered = ordered.repartitionByRange("source", "delivered", "table_name", "record_id").sortWithinPartitions("source", "delivered", "table_name", "record_id", "raw")
    read = scratch.cut(ordered.mapInArrow(_blocks, _ROW_SCHEMA), "read")
    blocks = read.where("summary is not null").select("part", "block", "summary").repartition(F.col("summary.source")).sortWithinPartitions("summary.source", "part", "block")
    picks = blocks.mapInArrow(_chains, "part int, block int, pick int")
    rows = read.select("table_name", "record_id", "delivered", "part", "block", "moments", "contrary", "choice").join(picks, ["part", "block"])
    index = F.element_at("choice", F.col("pick") + 1) + 1
    rows = rows.select("table_name", "record_id", "delivered", F.element_at("moments", index).alias("moment"), F.element_at("contrary", index).alias("contrary"))
    if strict:
        rows = rows.where(~F.col("contrary"))
    return rows.groupBy("table_name", "record_id").agg(F.max(F.struct("delivered", "moment")).alias("best")).select("table_name", "record_id", "best.moment")
