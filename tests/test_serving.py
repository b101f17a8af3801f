import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenlit.functions import calendar, text
from lumenlit.operators import changes, feed, ranking
from lumenlit.plans import serving_queries, stream_queries
from lumenlit.sources import records, sinks
from lumenlit.streaming import events


def _value(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], ddl).select(column.alias("x")).first()[0]


def test_feed(spark):
    users = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "c@x"), (4, "d@x")], "user_id int, email string")
    prefs = spark.createDataFrame([(2, "breast_oncology", "C"), (3, "radiation_oncology", "B"), (4, "custom", "C")], "user_id int, specialty string, min_tier string")
    subs = spark.createDataFrame([(u, s, not (u == 4 and s == 2)) for u in (1, 2, 3, 4) for s in (1, 2)], "user_id int, site_id int, is_active boolean")
    sites = spark.createDataFrame([(1, "breast"), (2, "gu")], "site_id int, site_code string")
    alerts = spark.createDataFrame([(10, 1, "PUBLISHED", "A", None, "none"), (11, 2, "PUBLISHED", "B", None, "direct"), (12, 1, "EXTRACTED", "A", None, "direct"), (13, 1, "PUBLISHED", "C", None, None), (14, 1, "PUBLISHED", "NOISE", None, None)], "alert_id int, site_id int, status string, tier string, published_at timestamp, relevance string")
    rows = feed.user_alert_feed(users, prefs, subs, sites, alerts)
    assert {(r.user_id, r.alert_id) for r in rows.collect()} == {(1, 10), (2, 10), (2, 13), (3, 11), (4, 10), (4, 13)}
    flat = feed.user_alert_feed(users, prefs, subs, sites, alerts, by_specialty=False)
    assert (2, 11) in {(r.user_id, r.alert_id) for r in flat.collect()}
    assert {r.user_id for r in feed.worth_sending(rows).collect()} == {1, 2, 4}
    sent = spark.createDataFrame([(1, 10)], "user_id int, alert_id int")
    assert (1, 10) not in {(r.user_id, r.alert_id) for r in feed.not_yet_sent(rows, sent).collect()}
    summary = {r.user_id: r.subscribed_sites for r in feed.preference_summary(users, subs.where("user_id <> 1"), sites, []).collect()}
    assert summary == {1: None, 2: ["breast", "gu"], 3: ["breast", "gu"], 4: ["breast"]}


def test_change_log(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, "d", 4)], "k int, s string, n int")
    got = {r.k: (r.operation, r.diff) for r in changes.change_log(old, new, "k", ["s", "n"]).collect()}
    assert got[2] == ("update", {"n": "null -> 2"}) and got[3][0] == "delete" and got[4] == ("insert", {"s": "null -> d", "n": "null -> 4"}) and 1 not in got
    merged = {tuple(r) for r in changes.upsert(old, new, ["k"], insert_only=["s"]).collect()}
    assert merged == {(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)}


def test_constraints(spark):
    df = spark.createDataFrame([(1, "C", True), (2, "A", True), (3, None, None)], "k int, tier string, alert boolean")
    rules = {"quiet": "tier <> 'C' or not alert"}
    assert [tuple(r) for r in changes.violations(df, "k", rules).collect()] == [(1, "quiet")]
    with pytest.raises(ValueError):
        changes.guarded(df, "k", rules)
    assert changes.guarded(df.where("k > 1"), "k", rules).count() == 2


def test_dates(spark):
    lenient = lambda v: str(_value(spark, calendar.lenient_date(F.col("v")), v=("string", v)))
    assert [lenient(v) for v in ("2024-01-05", "2024-1", "2024", "2024-02-30", "", "soon", None, "20240105", "2024-01-05T10:00")] == ["2024-01-05", "2024-01-01", "2024-01-01", "None", "None", "None", "None", "None", "2024-01-05"]
    strict = lambda v: str(_value(spark, calendar.strict_date(F.col("v")), v=("string", v)))
    assert strict("2024-01-05T10:00") == "None" and strict("2024-3") == "2024-03-01"
    days = spark.createDataFrame([("2024-01-10",), ("2024-06-20",)], "d string").select(F.to_date("d").alias("d"))
    got = {(str(r.d), r.meeting) for r in calendar.active_meetings(days, "d").collect()}
    assert ("2024-01-10", "ASH") in got and ("2024-06-20", "ASCO") in got and ("2024-06-20", "ASH") not in got


def test_text(spark):
    one = lambda c, v, t="string": _value(spark, c, v=(t, v))
    v = F.col("v")
    assert one(text.without_tags(v), "<p>A &amp; b<br/> c</p>") == "A & b c"
    assert one(text.trial_acronym(v), "The PATHOS study NCT03521153") == "NCT03521153" and one(text.trial_acronym(v), "OS in FLAURA2: x") == "FLAURA2" and one(text.trial_acronym(v), "OS") is None
    assert one(text.shortened(v, 5), "abcdefg") == "abcd…" and one(text.shortened(v, 5), "abc") == "abc"
    ground = lambda q, s: _value(spark, text.grounded(F.col("q"), F.col("s")), q=("array<string>", q), s=("string", s))
    assert ground(["A  b"], "x a b y") and not ground(["zz"], "x") and not ground([], "") and ground([], "x") and not ground(["a"], None)
    assert one(text.infer_phase(v), "Phase III") == "3" and one(text.infer_phase(v), "phase iv") == "1" and one(text.infer_phase(v), "none") is None
    assert text.first_json_object('say {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}' and text.first_json_object("```json\n{\"x\": 1}\n```") == '{"x": 1}' and text.first_json_object("{ no") is None and text.first_json_object(None) is None
    page = "TITLE: one\nDATE: d\nURL: u1\n\nTITLE: two\nDATE: d\nURL: u2"
    assert [b.title for b in one(text.blocks(v, "TITLE", "DATE", "URL"), page)] == ["one", "two"]
    assert one(text.excerpt(v, "match", 10, 3), "0123456789match") == "789match" and one(text.excerpt(v, "zz", 4), "abcdef") == "abcd"


ARTICLE = """<Set><PubmedArticle><MedlineCitation><PMID Version="1">42</PMID><Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Mar</Month></PubDate></JournalIssue><ISOAbbreviation>J X</ISOAbbreviation></Journal>
<ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="BACKGROUND">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract><Language>eng</Language>
<AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>NCT00000001</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D2">Lung Neoplasms</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>"""


def test_article_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLE)
    r = records.articles(spark, str(tmp_path / "a.xml")).first()
    assert (r.pmid, r.title, r.abstract, r.journal, r.pub_date, r.doi, r.pmc_id, r.language) == ("42", "A title", "BACKGROUND: First.\nSecond.", "J X", "2024-03", "10.1/x", "PMC1", "eng")
    assert r.authors == ["Doe J", "Group"] and r.nct_ids == ["NCT00000001"] and r.mesh_terms == ["Lung Neoplasms"] and r.publication_types == ["Journal Article"] and len(r.raw_hash) == 64


def test_other_sources(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> T </title><link>u</link><description>&lt;b&gt;x&lt;/b&gt;</description></item><item><title>S</title><link>u</link></item></channel></rss>")
    assert records.feed_items(spark, str(tmp_path / "f.xml")).count() == 1
    pages = spark.createDataFrame([(1, "<table><tr><td><a href='/x'>Drug</a></td><td>for <b>y</b></td><td>1/2/2024</td></tr><tr><td>short</td></tr></table>")], "page int, html string")
    assert [tuple(r) for r in records.table_rows(pages, "html", "page").collect()] == [(1, 0, "/x", "Drug", "for y", "1/2/2024")]
    apps = spark.createDataFrame([("a", [("AP", "2024-01", "S"), ("AP", "2024-03", "T"), ("TA", "2025", "U")]), ("b", [])], "application string, submissions array<struct<status string, date string, kind string>>")
    assert [tuple(r) for r in records.latest_submission(apps).collect()] == [("a", "2024-03", "T")]
    answers = spark.createDataFrame([(1, 'text {"n": 3} more'), (2, "none"), (3, None)], "id int, answer string")
    assert {r.id: r.fields and r.fields.n for r in records.extracted(answers, "answer", "n int", "id").collect()} == {1: 3, 2: None, 3: None}
    one = spark.createDataFrame([("u", 1), ("", 2)], "url string, n int")
    two = spark.createDataFrame([("u", 3), ("v", 4), ("", 5)], "url string, n int")
    assert {(r.url, r.n) for r in records.merged([one, two], "url").collect()} == {("u", 1), ("v", 4), ("", 2), ("", 5)}
    assert records.with_fallback(one.where("false"), two).count() == 3 and records.with_fallback(one, two).count() == 2
    with pytest.raises(ValueError):
        records.read(spark, "x", "csv")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (2, 20, "b")], "user_id int, alert_id int, title string")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, ["user_id", "alert_id"]) == 2 and sinks.append_new(df, path, ["user_id", "alert_id"]) == 0
    sent = []
    assert sinks.deliver(df, str(tmp_path / "d"), lambda rows: None, dry_run=True) == 2
    assert sinks.deliver(df, str(tmp_path / "d"), lambda rows: sent.extend(rows), dry_run=False) == 2
    assert sinks.deliver(df, str(tmp_path / "d"), lambda rows: None, dry_run=False) == 0
    for day, n in (("d1", 1), ("d2", 2), ("d1", 3)):
        sinks.overwrite_partition(spark.createDataFrame([(day, n)], "day string, n int"), str(tmp_path / "p"), "day")
    assert {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("d1", 3), ("d2", 2)}
    for stamp in ("1", "2", "3"):
        assert {r.name: r.n for r in sinks.backup({"x": df}, str(tmp_path / "b"), stamp).collect()} == {"x": 3}
    assert sinks.prune_backups(spark, str(tmp_path / "b"), keep=2) == ["1"]
    page = sinks.digest_page(spark.createDataFrame([("A", "<x>", "u"), ("B", None, None)], "tier string, title string, url string"), "T&C")
    assert "&lt;x&gt;" in page and "A (1)" in page and "T&amp;C" in page
    assert sinks.report(spark.createDataFrame([(1,)], "n int")) == '{"n": 1}'


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:00:00")], "k int, ts string").select("k", F.to_timestamp("ts").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    events.run_once(events.unseen_stream(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    seen = []
    events.deliver_stream(stream, str(tmp_path / "cp2"), lambda batch, _: seen.append(batch.count()))
    assert sum(seen) == 3


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_was_sent_is_a_condition_on_the_feed_and_not_a_second_feed(spark, sf):
    rows = serving_queries.already_sent_anti(spark, sf)
    assert "LeftAnti" not in _plan(rows)
    whole = serving_queries.user_alert_feed(spark, sf).select("user_id", "alert_id")
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r) for r in whole.collect() if (r.user_id + r.alert_id) % 3)


def _feed_tables(spark):
    rng = random.Random(5)
    users = spark.createDataFrame([(u, f"u{u}@x") for u in range(40)] + [(3, "u3@x")], "user_id int, email string")
    prefs = spark.createDataFrame([(u, rng.choice(["breast_oncology", "radiation_oncology", "custom", "none"]), rng.choice("ABC")) for u in range(0, 40, 2)], "user_id int, specialty string, min_tier string")
    subs = spark.createDataFrame([(u, s, rng.random() < 0.8) for u in range(40) for s in (1, 2, 3) if rng.random() < 0.7], "user_id int, site_id int, is_active boolean")
    sites = spark.createDataFrame([(1, "breast"), (2, "gu"), (3, "lung")], "site_id int, site_code string")
    alerts = [(a, rng.randint(1, 3), rng.choice(["PUBLISHED", "PUBLISHED", "EXTRACTED"]), rng.choice("BCNA" if a % 5 == 0 else "BC"), rng.choice([None, "2024-01-01", "2024-01-02"]), rng.choice(["direct", "none", None])) for a in range(150)]
    alerts = spark.createDataFrame([*alerts, alerts[0]], "alert_id int, site_id int, status string, tier string, at string, relevance string").withColumn("published_at", F.to_timestamp("at")).drop("at")
    return users, prefs, subs, sites, alerts


def _order():
    return [F.col("tier"), F.col("published_at").desc_nulls_last(), F.col("alert_id")]


def test_first_rows_by_channel_are_those_of_the_whole_feed(spark, sf):
    *people, alerts = _feed_tables(spark)
    whole = ranking.ranked(feed.user_alert_feed(*people, alerts), _order(), ["user_id"]).where("place <= 4")
    best = feed.best_of_feed(feed.feed_readers(*people), alerts, _order(), 4)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "place", "alert_id").collect()))
    assert rows(best) == rows(whole) and len(rows(best)) > 60


def test_messages_by_channel_are_those_of_the_whole_feed(spark):
    *people, alerts = _feed_tables(spark)
    title = F.concat(F.lit("alert "), "alert_id")
    whole = ranking.messages(feed.user_alert_feed(*people, alerts).withColumn("title", title), "user_id", "tier", _order()[1:])
    by_channel = feed.feed_messages(feed.feed_readers(*people), alerts, title, _order()[1:])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(by_channel) == rows(whole) and any("updates" in r[2] for r in rows(whole))


def test_feeds_worth_sending_are_known_before_they_are_made(spark):
    *people, alerts = _feed_tables(spark)
    unsent = F.expr("(user_id + alert_id) % 3 <> 0")
    whole = feed.worth_sending(feed.user_alert_feed(*people, alerts).where(unsent))
    got = feed.feed_worth_sending(feed.feed_readers(*people), alerts, unsent)
    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "alert_id", "tier").collect())
    assert rows(got) == rows(whole) and rows(got)


def test_recipients_are_distinct_without_comparing_all_pairs(spark, sf):
    users = spark.createDataFrame([(1, "a@x"), (2, "B@x"), (3, "c@x")], "user_id int, email string")
    subs = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (3, 2, True), (3, 1, False)], "user_id int, site_id int, is_active boolean")
    accounts = spark.createDataFrame([(11, "A@x", True), (12, "a@x", True), (21, "b@x", True), (31, "c@x", True)], "account_id int, email string, notify boolean")
    alerts = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "alert_id int, site_id int")
    comments = spark.createDataFrame([(100, 1, 11), (100, 1, 11), (101, 1, 21), (102, 2, 31), (103, 1, None)], "comment_id int, alert_id int, author int")
    got = [tuple(r) for r in feed.comment_recipients(comments, alerts, subs, users, accounts).collect()]
    assert sorted(got) == [(100, "B@x"), (100, "a@x"), (101, "a@x"), (102, "B@x"), (102, "a@x")]
    assert not _plan(serving_queries.comment_recipients(spark, sf)).startswith("Aggregate")


def test_the_comment_stream_stores_comments_and_not_their_recipients(spark, sf, monkeypatch):
    through, stored = stream_queries._through, []
    monkeypatch.setattr(stream_queries, "_through", lambda spark, stream: stored.append(through(spark, stream)) or stored[-1])
    rows = stream_queries.comment_notify_stream(spark, sf)
    assert rows.count() > 5 * stored[0].count() > 0


def _told_and_readers(spark):
    told = spark.range(3000).select(F.hash("id").cast("long").alias("comment_id"), (F.col("id") % 2).cast("int").alias("site_id"), F.when(F.col("id") % 50 != 7, F.col("id") % 900).alias("author"))
    readers = spark.range(1500).select((F.col("id") % 3).cast("int").alias("site_id"), F.concat(F.lit("User"), F.hash("id"), F.lit("@Mail.example")).alias("email"), (F.col("id") % 700).alias("account_id"))
    return told.unionByName(told.limit(20)), readers.unionByName(readers.limit(30))


def test_tiles_of_comments_and_readers_give_the_rows_of_a_plain_join(spark, monkeypatch):
    told, readers = _told_and_readers(spark)
    want = Counter(map(tuple, told.join(readers, "site_id").where("account_id <> author").select("comment_id", "email").collect()))
    for run, tile, part in ((feed.RUN, feed.TILE, feed.PART), (7, 21, 100)):
        for name, value in (("RUN", run), ("TILE", tile), ("PART", part)):
            monkeypatch.setattr(feed, name, value)
        assert Counter(map(tuple, feed.told_recipients(told, readers).collect())) == want and max(want.values()) > 1
    assert feed.told_recipients(told.where("false"), readers).count() == feed.told_recipients(told, readers.where("false")).count() == 0


@pytest.mark.parametrize("distinct", [False, True])
def test_recipients_are_stored_in_a_fraction_of_a_byte_a_row(spark, tmp_path, distinct):
    told, readers = _told_and_readers(spark)
    told, readers = told.withColumn("site_id", F.lit(1)), readers.withColumn("site_id", F.lit(1))
    if distinct:
        comments = told.select("comment_id", F.lit(1).alias("alert_id"), "author")
        users, accounts = readers.select("account_id", "email").distinct(), readers.select("account_id", "email", F.lit(True).alias("notify"))
        subs = users.select(F.col("account_id").alias("user_id"), F.lit(1).alias("site_id"), F.lit(True).alias("is_active")).distinct()
        rows = feed.comment_recipients(comments, spark.createDataFrame([(1, 1)], "alert_id int, site_id int"), subs, users.withColumnRenamed("account_id", "user_id"), accounts)
    else:
        rows = feed.told_recipients(told, readers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        rows.write.parquet(str(tmp_path / "told"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored, n = sum(p.stat().st_size for p in (tmp_path / "told").glob("*.parquet")), spark.read.parquet(str(tmp_path / "told")).count()
    assert n > 4_000_000 and stored < 0.7 * n, stored / n


def test_blocks_of_alerts_give_the_rows_of_single_ones(spark):
    *people, alerts = _feed_tables(spark)
    more = spark.range(2000).select((F.col("id") + 1000).cast("int").alias("alert_id"), F.lit(1).alias("site_id"), F.lit("PUBLISHED").alias("status"), F.expr("case when id % 7 = 0 then null when id % 7 < 3 then 'NOISE' else 'B' end").alias("tier"), F.expr("case when id % 2 = 0 then 'direct' end").alias("relevance"), F.lit(None).cast("timestamp").alias("published_at"))
    alerts = alerts.unionByName(more)
    readers = feed.feed_readers(*people)
    singly = feed.fan_out(readers, feed._published(alerts), "site_id", "user_id").where(feed._admitted())
    got = feed.feed_of(readers, alerts)
    rows = lambda df: Counter(map(tuple, df.select(*got.columns).collect()))
    assert rows(got) == rows(singly) and max(rows(got).values()) > 1 and sum(rows(got).values()) > 4 * feed.BLOCK


def test_a_feed_is_stored_in_a_fraction_of_a_byte_a_row(spark, tmp_path):
    readers = spark.range(450).select(F.col("id").alias("user_id"), F.lit("a@x").alias("email"), F.lit("custom").alias("specialty"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("min_tier"), F.lit(1).alias("site_id"), F.lit("gu").alias("site_code"), F.lit(False).alias("relevant_only"))
    alerts = spark.range(12000).select(F.hash("id").alias("alert_id"), F.lit(1).alias("site_id"), F.lit("PUBLISHED").alias("status"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("tier"), F.lit("direct").alias("relevance"), F.lit(None).cast("timestamp").alias("published_at"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        feed.feed_of(readers, alerts).select("user_id", "alert_id", "tier").write.parquet(str(tmp_path / "feed"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = sum(p.stat().st_size for p in (tmp_path / "feed").glob("*.parquet"))
    rows = spark.read.parquet(str(tmp_path / "feed")).count()
    assert rows == 450 * 8000 and stored < 0.5 * rows, stored / rows
