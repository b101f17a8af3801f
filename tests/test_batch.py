from pyspark.sql import functions as F

from lumenlit.operators import batch, changes
from lumenlit.sources import sinks


def test_strict_routing_and_records(spark):
    items = spark.createDataFrame([(1, "Lung drug", None, "u", "2024"), (2, None, "breast and LUNG", None, None), (3, "other", "", "u", None)], "fda_id long, title string, summary string, url string, pub_date string")
    records = batch.item_records(items, "FDA", "J", ["T"])
    assert {r.fda_id: (r.pmid, r.abstract, r.conference_source, len(r.text_hash)) for r in records.collect()} == {1: ("", "", "FDA", 64), 2: ("", "breast and LUNG", "FDA", 64), 3: ("", "", "FDA", 64)}
    sites = spark.createDataFrame([("t", ["lung"]), ("b", ["Breast"]), ("all", [])], "site string, terms array<string>")
    routed = batch.strictly_routed(records, F.concat_ws(" ", "title", "abstract"), sites)
    assert {(r.fda_id, r.site) for r in routed.collect()} == {(1, "t"), (1, "all"), (2, "t"), (2, "b"), (2, "all"), (3, "all")}
    assert batch.strictly_routed(records.where("false"), F.col("title"), sites).count() == 0


def test_most_trusted(spark):
    rows = spark.createDataFrame([("g", "fda", "2024", 3), ("g", "fda", None, 1), ("g", "fda", "2024", 2), ("g", "peer_reviewed", "1999", 0), ("h", None, None, 9), ("h", "unheard", "", 8)], "g string, s string, d string, i long")
    assert {(r.g, r.i) for r in batch.most_trusted(rows, "g", "s", "d", "i").collect()} == {("g", 2), ("h", 8)}


def test_calendar_tags(spark):
    rows = spark.createDataFrame([(1, "2024-06-20", "2024-06-02"), (2, "2024-06-20", "2023-01-01"), (3, "2024-06-20", None)], "id long, day string, published string").selectExpr("id", "date(day) day", "date(published) published")
    assert {(r.id, r.meeting) for r in batch.calendar_tags(rows, "published", "day").collect()} == {(1, "ASCO")}


def test_short_lines(spark):
    row = spark.createDataFrame([("ABC trial\nlower only; Some very long line with XYZ inside it. KEYNOTE",), (None,)], "t string").select(batch.short_lines(F.col("t")).alias("l")).collect()
    assert row[0].l == ["ABC trial", "KEYNOTE"] and row[1].l == []


def test_sign_up_and_tokens(spark):
    users = spark.createDataFrame([(1, "A@x"), (2, None), (3, "b@X")], "u long, m string")
    accounts = spark.createDataFrame([(10, "a@X"), (9, "A@X"), (11, None)], "a long, m string")
    assert {(r.u, r.a) for r in changes.linked(users, "u", "m", accounts, "a", "m").collect()} == {(1, 9), (2, None), (3, None)}
    rows = spark.createDataFrame([("email", "o", True, "store"), ("push", "o", True, "clear"), ("email", "o", True, "unsubscribe"), (None, None, None, None)], "delivery string, push_token string, verified boolean, act string")
    got = [tuple(r) for r in changes.subscriber_action(rows, F.col("act"), F.lit("n")).drop("act").collect()]
    assert got == [("both", "n", True), ("push", None, True), ("email", "o", False), (None, None, None)]


def test_touched(spark):
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, None, "old")], "k long, v string, at string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k long, v string")
    assert {tuple(r) for r in changes.touched(old, new, ["k"], ["v"], "at", F.lit("new")).collect()} == {(1, "old"), (2, "new"), (3, "old"), (4, "new")}


def test_digest_pages_leave_no_row_out(spark):
    rows = spark.createDataFrame([("A" if i < 7 else "B", f"t{i}", "u", 0) for i in range(12)], "tier string, title string, url string, n int")
    pages = list(sinks.digest_pages(rows, "Digest", size=5))
    assert len(pages) == 3 and sum(p.count("<li>") for p in pages) == 12 and all("A (7)" in p for p in pages[:2]) and "B (5)" in pages[2]
    assert len(list(sinks.digest_pages(rows.where("false"), "Digest"))) == 1
