import itertools
import random
from datetime import datetime, timezone

import pytest

from lumenlit.functions.datetimes import readings
from lumenlit.operators import timestamps as T

SCHEMA = "source string, table_name string, record_id long, delivered timestamp, raw string, home_zone string, day_month string, moment string"


@pytest.mark.parametrize(
    "raw, zone, moment",
    [
        ("2024-03-10 02:03:00 America/New_York", "UTC", "2024-03-10T07:03:00Z"),  # skipped: the offset before the change
        ("2024-11-03 01:30", "America/New_York", "2024-11-03T05:30:00Z"),  # twice: the first
        ("Wed, 17 Jul 2024 09:16:15 CDT", "UTC", "2024-07-17T14:16:15Z"),
        ("Wed, 17 Jul 2024 13:23:08 -0400", "UTC", "2024-07-17T17:23:08Z"),
        ("2024-12-10T17:52:33-08:00[America/Los_Angeles]", "UTC", "2024-12-11T01:52:33Z"),
        ("2025-08-03t17:50:46.555409z", "Asia/Tokyo", "2025-08-03T17:50:46Z"),
        ("20230911T190019Z", "UTC", "2023-09-11T19:00:19Z"),
        ("1733270205", "Asia/Tokyo", "2024-12-03T23:56:45Z"),
        ("1761661835163", "Asia/Tokyo", "2025-10-28T14:30:35Z"),
        ("Jun 15, 2025, 12:28 a.m.", "UTC", "2025-06-15T00:28:00Z"),
        ("18.1.2024, 12:16:14 Uhr", "Europe/Berlin", "2024-01-18T11:16:14Z"),
        (" 2024年9月16日 ", "UTC", "2024-09-16"),
        ("17 de marzo de 2025", "UTC", "2025-03-17"),
        ("29 août 2024", "UTC", "2024-08-29"),
        ("15. April 2023", "UTC", "2023-04-15"),
        ("2022 May-Jun", "UTC", "2022-05"),
        ("2021 Sep", "UTC", "2021-09"),
        ("2022", "UTC", "2022"),
        ("20221219", "UTC", "2022-12-19"),
    ],
)
def test_one_reading(raw, zone, moment):
    assert [r[2] for r in readings(raw, zone)] == [moment]


@pytest.mark.parametrize("raw", [None, "", "  ", "TBD", "last week", "2024-02-30", "2025-13-04", "31/02/2025 10:15", "0000-00-00", "2024-01-01 10:00 XYZ", "9" * 5000])
def test_no_reading(raw):
    assert readings(raw, "UTC") == []


def test_numeric_dates_have_both_readings():
    assert {r[2] for r in readings("3/4/2024", "UTC")} == {"2024-04-03", "2024-03-04"}


def _cost(path, rows, own):
    return sum(own[i][k] for i, k in enumerate(path)) + sum(T.step_cost(*rows[i][a][:2], *rows[i + 1][b][:2]) for i, (a, b) in enumerate(zip(path, path[1:])))


def test_blocks_chain_to_the_unbroken_optimum():
    rng = random.Random(5)
    for _ in range(60):
        rows, own = [], []
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(1, 3)
            rows.append([(rng.choice("ab"), rng.randrange(0, 20) * 86_400, "") for _ in range(n)])
            own.append([rng.choice([0.0, 0.5, 50.0]) for _ in range(n)])
        best = min(_cost(p, rows, own) for p in itertools.product(*(range(len(r)) for r in rows)))
        size, summaries, choices = rng.randint(1, 3), [], []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            choice, cost = T.solve_block(part, own[at : at + size])
            choices.append(choice)
            summaries.append({"first_form": [r[0] for r in part[0]], "first_at": [r[1] for r in part[0]], "last_form": [r[0] for r in part[-1]], "last_at": [r[1] for r in part[-1]], "cost": cost})
        path = [c[pick] for choice, pick in zip(choices, T.chain_blocks(summaries)) for c in choice]
        assert _cost(path, rows, own) == pytest.approx(best)


def _at(day):
    return datetime(2024, 5, day, tzinfo=timezone.utc)


def test_operator(spark):
    rows = [
        ("s", "t", 1, _at(1), "3/4/2024", "UTC", "D", "clash"),
        ("s", "t", 2, _at(2), "3/4/2024", "UTC", "M", "clash"),
        ("s", "t", 3, _at(3), "13/25/2024", "UTC", "M", None),  # impossible both ways
        ("s", "t", 4, _at(4), "25/12/2024", "UTC", "M", None),  # possible only against the declared order
        ("s", "t", 5, _at(5), None, "UTC", None, None),
        (None, "t", 6, None, "2024-01-02", None, None, None),
        ("s", "t", 7, _at(6), "2024-01-02", "UTC", None, None),
        ("s", "t", 7, _at(6), "2024-01-02", "UTC", None, None),  # delivered again
        ("s", "t", 8, _at(6), "x" * 100_000 + "1", "UTC", None, None),
    ]
    found = {r.record_id: r.moment for r in T.normalise_timestamps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: "2024-04-03", 2: "2024-03-04", 6: "2024-01-02", 7: "2024-01-02"}
    loose = {r.record_id for r in T.normalise_timestamps(spark.createDataFrame(rows, SCHEMA), strict=False).collect()}
    assert loose == {1, 2, 4, 6, 7}
    assert T.normalise_timestamps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_in_source_decides_without_a_declared_order(spark):
    raws = ["10/1/2024", "13/1/2024", "15/1/2024", "5/2/2024", "20/2/2024"]
    rows = [("s", "t", i, datetime(2024, 3, i + 1, tzinfo=timezone.utc), raw, "UTC", None, None) for i, raw in enumerate(raws)]
    found = {r.record_id: r.moment for r in T.normalise_timestamps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0] == "2024-01-10" and found[3] == "2024-02-05"


def test_inferred_order_agrees_with_the_declared_one(spark, sf):
    from lumenlit.plans.timestamp_queries import p2_agreement

    got = {r.table_name: r for r in p2_agreement(spark, sf).collect()}
    assert set(got) == {"news_records", "fda_items", "candidates"} and all(0 < r.agreed <= r.records for r in got.values())
    assert got["candidates"].share == 1.0 and min(r.share for r in got.values()) >= 0.9


def test_scratch_is_removed(spark, tmp_path):
    from pathlib import Path

    from lumenlit.scratch import Scratch

    scratch = Scratch(spark, "here")
    kept = scratch.cut(spark.range(3), "a")
    assert kept.count() == 3 and Path(scratch.root).exists()
    scratch.close()
    assert not Path(scratch.root).exists()
