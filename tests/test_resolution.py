import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumenlit.functions import similarity
from lumenlit.functions.similarity import Likeness, signatures, similar_pairs
from lumenlit.operators import cluster, dedupe, ranking

RECORDS = "id int, pmid string, doi string, quality int, title string, pub_date string"


def test_hard_dedupe(spark):
    rows = [(1, "p1", None, 5, "", ""), (2, "p1", None, 9, "", ""), (3, "p2", "10.1/X", 1, "", ""), (4, "p3", "10.1/x", 2, "", ""), (5, "", "10.1/y", 1, "", ""), (6, "", None, 1, "", ""), (7, None, None, 1, "", ""), (8, "p4", "10.1/y", 1, "", "")]
    df = spark.createDataFrame(rows, RECORDS)
    assert {r.id for r in dedupe.hard_dedupe(df, "quality", "id").collect()} == {1, 4, 5, 6, 7}
    assert {r.id for r in dedupe.hard_dedupe(df, "quality", "id", compat_empty=True).collect()} == {1, 4, 5}
    assert dedupe.hard_dedupe(df.where("false"), "quality", "id").count() == 0


def _greedy(rows, threshold, days):
    kept = []
    near = lambda a, b: not a or not b or abs(int(a[-2:]) - int(b[-2:])) <= days
    for key, title, date in rows:
        t = " ".join(title.lower().split())
        if not any(t and k[1] and SequenceMatcher(None, t, k[1]).ratio() >= threshold and near(date, k[2]) for k in kept):
            kept.append((key, t, date))
    return {k[0] for k in kept}


def test_fuzzy_dedupe_equals_the_greedy_fold(spark):
    rng = random.Random(9)
    words = "trial of adjuvant pembrolizumab versus placebo in resected stage two melanoma final overall survival analysis of patients".split()
    base = [" ".join(rng.sample(words, 12)) for _ in range(25)]
    rows = []
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        rows.append((i, "".join(t) if rng.random() > 0.05 else "", rng.choice(["", "2024-01-01", "2024-01-05", "2024-01-20"])))
    df = spark.createDataFrame(rows, "id int, title string, pub_date string")
    got = {r.id for r in dedupe.fuzzy_dedupe(df, "id").collect()}
    assert got == _greedy(rows, 0.92, 7)


@pytest.mark.parametrize("titles, dates, left", [(["A new trial of X in lung cancer", "A new trial of X in lung cancer."], ["2024-01-15", "2024-01-16"], 1), (["A new trial of X in lung cancer"] * 2, ["2024-01-15", "2024-02-15"], 2), (["", ""], ["", ""], 2), (["A new trial of X in lung cancer"] * 2, ["", "2024-02-15"], 1), ([None, None], [None, None], 2)])
def test_fuzzy_cases(spark, titles, dates, left):
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(zip(titles, dates))], "id int, title string, pub_date string")
    assert dedupe.fuzzy_dedupe(df, "id").count() == left


def test_similar_pairs_reach_brute_force(spark, sf):
    titles = [r.title for r in spark.read.parquet(f"{sf}/news_records.parquet").select("title").distinct().limit(150).collect()]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {(r.first, r.second) for r in similar_pairs(df, "id", "title", 0.85).collect()}
    norm = [" ".join(t.lower().split()) for t in titles]
    want = {(i, j) for i in range(len(norm)) for j in range(i + 1, len(norm)) if SequenceMatcher(None, norm[j], norm[i]).ratio() >= 0.85}
    assert got <= want and len(got) >= 0.9 * len(want)


def _edited(rng, base, most):
    """Copies of the texts with single letters changed, lost or added far apart from each other, which leaves few pieces of four whole."""
    out = []
    for text in base:
        for edits in range(most + 1):
            t = list(text)
            for at in range(edits):
                t[3 + 5 * at : 4 + 5 * at] = rng.choice([["ж"], [], ["x", "é"]])
            out.append("".join(t))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.92])
def test_likeness_loses_no_pair(threshold):
    rng = random.Random(5)
    texts = _edited(rng, ["".join(rng.choice("abcdefghij klmno") for _ in range(n)) for n in (1, 2, 9, 24, 24, 40, 70, 199, 260, 400)], 6)
    index = Likeness(texts, threshold)
    for text, bits in zip(texts, signatures(texts).T):
        got = dict(index.like(text, bits))
        ratios = [1.0 if text == t else SequenceMatcher(None, text, t).ratio() for t in texts]
        assert got == {i: r for i, r in enumerate(ratios) if r >= threshold and text}


def test_similar_pairs_of_scattered_edits(spark):
    rng = random.Random(4)
    texts = [" ".join(t.split()) for t in _edited(rng, ["".join(rng.choice("abcdefghijklmno") for _ in range(24)) for _ in range(20)], 3)]
    got = {(r.first, r.second) for r in similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, title string"), "id", "title", 0.85).collect()}
    assert got == {(i, j) for j in range(len(texts)) for i in range(j) if SequenceMatcher(None, texts[j], texts[i]).ratio() >= 0.85}


def test_fuzzy_dedupe_by_slices_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FIRST_ROWS", 30)
    monkeypatch.setattr(similarity, "SLICE_ROWS", 60)
    rng = random.Random(8)
    rows = [(i, f"dosing of {rng.choice(['ab', 'xylo', 'quin'])} at {rng.randint(1, 999)} mg every {rng.randint(1, 9)} weeks was feasible", rng.choice([None, "2024-01-01", "2024-01-09", "2024-01-20"])) for i in range(300)] + [(300, None, None), (301, " ", "2024-01-01")]
    df = spark.createDataFrame(rows, "id int, title string, pub_date string")
    got = {r.id for r in dedupe.fuzzy_dedupe(df.repartition(3), "id").collect()}
    assert got == _greedy([(i, t or "", d or "") for i, t, d in rows], 0.92, 7) and {300, 301} <= got and len(got) < 200


def test_fuzzy_dedupe_compares_few_pairs_of_one_template(monkeypatch):
    """A greedy pass over n copies needs about n comparisons, not one for each of their pairs."""
    calls = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *args: calls.append(1) or SequenceMatcher(*args))
    texts = [f"dosing at {i % 90 + 10} mg/kg every {i % 7} weeks was feasible, unexpectedly, in most of the patients" for i in range(600)]
    first, n = Likeness(texts[:1], 0.92), 0
    for text, bits in zip(texts, signatures(texts).T):
        n += next(first.like(text, bits), None) is not None
    assert n == 600 and len(calls) <= 600


def test_trial_dedupe(spark):
    rows = [(1, "LAURA", "Title one of the laura trial"), (2, " laura ", "Another"), (3, None, "Title one of the laura trial."), (4, "", "Something else entirely here"), (5, None, "Something else entirely here!"), (6, None, "")]
    df = spark.createDataFrame(rows, "id int, name string, title string")
    assert {r.id for r in dedupe.trial_dedupe(df, "name", "title", "id").collect()} == {1, 4, 6}


def test_trial_dedupe_by_slices_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "FIRST_ROWS", 20)
    monkeypatch.setattr(similarity, "SLICE_ROWS", 40)
    rng = random.Random(6)
    titles = [" ".join(t.split()) for t in _edited(rng, ["".join(rng.choice("abcdefghijklmno ") for _ in range(28)) for _ in range(40)], 4)]
    rows = [(i, rng.choice([None, "", f"T-{rng.randint(1, 60)}"]), t) for i, t in enumerate(rng.sample(titles, len(titles)))] + [(900, None, None), (901, "T-1", None)]
    like = lambda new, kept: bool(new and kept) and SequenceMatcher(None, new, kept).ratio() >= 0.88
    winners, kept = {}, []
    for i, name, title in rows:
        if name:
            winners.setdefault(name, (i, title))
    for i, name, title in rows:
        if not name and not any(like(title, t) for _, t in [*winners.values(), *kept]):
            kept.append((i, title))
    got = {r.id for r in dedupe.trial_dedupe(spark.createDataFrame(rows, "id int, name string, title string").repartition(3), "name", "title", "id").collect()}
    assert got == {i for i, _ in [*winners.values(), *kept]}


def test_independent_set_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)], "first int, second int")
    assert {r.node for r in dedupe.independent_set(nodes, edges).collect()} == {0, 2, 4, 6, 8, 10}


def test_suppress_and_unseen(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "b", "FDA"), (3, None, "x"), (4, "c", "x")], "id int, name string, kind string")
    prior = spark.createDataFrame([(" a",), ("B",), (None,)], "name string")
    assert {r.id for r in dedupe.suppress(rows, prior, "name", F.col("kind") == "FDA").collect()} == {2, 3, 4}
    key = dedupe.seen_key(F.col("name"), F.col("kind"))
    assert [r[0] for r in rows.select(key).orderBy("id").collect()] == ["A", "b", "title:x", "c"]


def test_title_gaps(spark):
    a = spark.createDataFrame([(1, ["lung", "drug"]), (2, ["skin", "cream"]), (3, [])], "id int, tokens array<string>")
    b = spark.createDataFrame([(9, ["lung", "drug", "more"]), (8, ["skin", "a", "b", "c", "d"])], "id int, tokens array<string>")
    assert {r.id for r in dedupe.title_gaps(a, b, "id", "tokens").collect()} == {2, 3}


@pytest.mark.parametrize("most", [500, 3, 0])
def test_title_gaps_equal_brute_force_by_subsets_and_by_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(dedupe, "MOST_SUBSETS", most)
    rng, words = random.Random(3), [f"w{i}" for i in range(24)]
    draw = lambda n: [(i, rng.sample(words, rng.randint(0, 8))) for i in range(n)]
    wanted, present = draw(80), draw(25)
    near = lambda a, b: a and b and len(a & b) >= 0.35 * len(a | b)
    want = {i for i, a in wanted if not any(near(set(a), set(b)) for _, b in present)}
    a, b = (spark.createDataFrame(rows, "id int, tokens array<string>") for rows in (wanted, present))
    gaps = dedupe.title_gaps(a, b, "id", "tokens")
    assert {r.id for r in gaps.collect()} == want and 0 < len(want) < 80
    assert ("array_intersect" in gaps._jdf.queryExecution().optimizedPlan().toString()) == (most < 500)


@pytest.mark.parametrize("most", [500, 0])
def test_title_gaps_send_no_subsets_or_words_to_the_driver(spark, monkeypatch, most):
    monkeypatch.setattr(dedupe, "MOST_SUBSETS", most)
    a = spark.createDataFrame([(i, [f"w{i}", f"w{i + 1}", "v"]) for i in range(9)], "id int, tokens array<string>")
    gaps = dedupe.title_gaps(a, a.where("id > 4"), "id", "tokens")
    assert {r.id for r in gaps.collect()} == {0, 1, 2, 3}
    sent = [x for x in gaps._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "[n" not in x and "size(" not in x]
    assert not sent, sent


@pytest.mark.parametrize("cap, want", [(0, {0, 1, 2, 3, 4, 5, 6}), (1, {0, 1}), (4, {0, 1, 3, 4}), (6, {0, 1, 2, 3, 4, 5}), (50, {0, 1, 2, 3, 4, 5, 6})])
def test_caps(spark, cap, want):
    rows = [(0, "A", 1.0, "x"), (1, "A", 9.0, "x"), (2, "B", 5.0, "x"), (3, "B", 7.0, "x"), (4, "B", 7.0, "x"), (5, "C", 99.0, "x"), (6, "C", None, "x")]
    df = spark.createDataFrame(rows, "id int, tier string, score double, place string")
    assert {r.id for r in ranking.capped(df, "tier", "score", "id", cap).collect()} == want
    assert {r.id for r in ranking.capped(df, "tier", "score", "id", cap, within="place").collect()} == want


def test_messages(spark):
    df = spark.createDataFrame([(1, "A", i, f"t{i}") for i in range(5)] + [(2, "B", 1, "b"), (2, "C", 2, "c")], "user_id int, tier string, alert_id int, title string")
    got = {(r.user_id, r.place): r.message for r in ranking.messages(df, "user_id", "tier", [F.col("alert_id")]).collect()}
    assert got == {(1, 1): "t0", (1, 2): "t1", (1, 3): "t2", (2, 1): "2 updates"}


def test_signals(spark):
    df = spark.createDataFrame([(3, "k", "asco"), (2, "k", "PUBMED"), (1, "k", "journal"), (4, "k", None), (5, "j", "blog")], "id int, key string, source_type string")
    got = {r.key: tuple(r)[1:] for r in cluster.signals(df, "key", "id").collect()}
    assert got["k"] == (4, 3, "ASCO", "ASCO + JOURNAL + PUBMED") and got["j"] == (1, 5, "BLOG", "BLOG")
