import pytest
from pyspark.sql import functions as F

from lumenlit.conf import vocabulary as V
from lumenlit.functions import rules
from lumenlit.operators import filters, gates, metrics


def _one(spark, column, **values):
    ddl = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], ddl).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("journal, rank", [("New England Journal of Medicine", 0), ("NEW ENGLAND JOURNAL OF MEDICINE", 0), ("The Lancet Oncol", 1), ("Acta Obscura", 127), ("", 127), (None, 127)])
def test_journal_rank(spark, journal, rank):
    assert _one(spark, rules.name_rank(F.lower("j"), V.JOURNAL_RANK, V.DEFAULT_JOURNAL_RANK), j=("string", journal)) == rank


@pytest.mark.parametrize("types, keep, low", [(["Randomized Controlled Trial", "Letter"], True, False), (["Editorial", "Journal Article"], True, True), (["Review"], False, False), (["Never Seen"], True, True), ([], True, True), (None, True, True)])
def test_publication_types(spark, types, keep, low):
    got = _one(spark, filters.classify_types(F.col("t")), t=("array<string>", types))
    assert (got.keep, got.low_priority) == (keep, low)


def test_type_filter_bypasses(spark):
    rows = spark.createDataFrame([(1, ["News"], "FDA", "x"), (2, ["Editorial"], None, "Lancet Oncology"), (3, ["Editorial"], "", "Acta"), (4, ["Editorial"], None, "Lancet")], "id int, publication_types array<string>, conference_source string, journal string")
    got = {r.id: r.pubtype.low_priority for r in filters.filter_types(rows, ["lancet oncology"]).collect()}
    assert got == {1: False, 2: True, 4: True}


def _relevance(spark, title, abstract, mesh=(), gyn=False):
    r = filters.relevance(F.col("t"), F.col("a"), F.col("m"), rules.any_word(["lung"]), ["Lung Neoplasms"], rules.any_word(["chemotherapy"]), gyn)
    return _one(spark, r, t=("string", title), a=("string", abstract), m=("array<string>", list(mesh)))


def test_relevance_weights(spark):
    assert _relevance(spark, "Lung", "").score == 30
    assert _relevance(spark, "", "lung").score == 15
    assert _relevance(spark, "", "", ["lung neoplasms"]).score == 15
    assert _relevance(spark, "", "randomized").score == 20 and _relevance(spark, "", "chemotherapy").score == 15 and _relevance(spark, "", "overall survival").score == 15
    assert _relevance(spark, "Lung xenograft", "").score == 0 and _relevance(spark, "Lung xenograft in a patient", "").score == 30
    full = _relevance(spark, "Lung phase III", "chemotherapy, overall survival", ["Lung Neoplasms"])
    assert full.score == 95 and full.keep and not full.low_confidence
    assert _relevance(spark, "Fibroid lung", "", gyn=True).score == 10
    assert _relevance(spark, "Lung disease in children", "").score == 15 and _relevance(spark, "Lung neuroblastoma in children", "").score == 30
    low = _relevance(spark, "Lung", "")
    assert low.keep and low.low_confidence
    assert _relevance(spark, None, None).score == 0 and not _relevance(spark, None, None).keep


GATE_CASES = [
    ("A mixture cure model of survival", "", "", [], None, "NONE", None),
    ("Narrative review of guideline updates", "", "", [], None, "NONE", None),
    ("A post-hoc analysis of a trial", "", "", [], None, "NONE", None),
    ("x", "x", "Acta Zyx", [], "WEB_SEARCH", "LLM_CURATED", None),
    ("Notice", "", "Acta Zyx", [], "FDA", "FDA", None),
    ("Notice", "", "Acta Zyx", ["FDA Drug Approval"], None, "FDA", None),
    ("Updated NCCN guideline", "the nccn published an updated guideline", "Acta Zyx", [], None, "GUIDELINE", None),
    ("NCCN meeting report", "", "Acta Zyx", [], None, "NONE", "no_qualifying_signal"),
    ("Results of LAURA", "", "Acta Zyx", [], None, "WATCHED_TRIAL", None),
    ("Results of LAURAX", "", "Acta Zyx", [], None, "NONE", "no_qualifying_signal"),
    ("A randomized trial", "did not meet its primary endpoint", "Acta Zyx", [], None, "NEGATIVE_TRIAL", None),
    ("A cohort", "did not meet its primary endpoint", "Acta Zyx", [], None, "NONE", "no_qualifying_signal"),
    ("A phase III randomized trial", "", "Acta Zyx", [], None, "PHASE_III_RANDOMIZED", None),
    ("Retrospective study of a phase III randomized trial", "", "Acta Zyx", [], None, "NONE", "retrospective_database"),
    ("Randomized de-escalation", "", "Acta Zyx", [], None, "RANDOMIZED_DEESCALATION", None),
    ("Randomized phase II", "", "Test Journal", [], None, "NONE", "non_whitelist_journal"),
    ("Randomized phase II", "", "Journal of Clinical Oncology", [], None, "PHASE_II_RANDOMIZED", None),
    ("Late-breaking abstract", "", "Acta Zyx", [], "ASCO", "MAJOR_CONFERENCE", None),
    ("An asco plenary presentation", "", "Acta Zyx", [], None, "MAJOR_CONFERENCE", None),
    ("Prospective trial of SBRT", "", "Acta Zyx", [], None, "DIRECT_RADONC_TRIAL", None),
    ("Phase II for an orphan drug", "", "Acta Zyx", [], None, "REGULATORY_PHASE_II", None),
    ("Systematic review", "", "Test Journal", [], None, "NONE", "non_whitelist_journal"),
    ("Overall survival", "", "Lancet Oncology", [], None, "TOP_JOURNAL", None),
    ("A mouse model", "", "Acta Zyx", [], None, "NONE", "preclinical"),
    (None, None, None, None, None, "NONE", "no_qualifying_signal"),
]


def test_gates(spark):
    rows = [(i, *case[:5]) for i, case in enumerate(GATE_CASES)]
    df = spark.createDataFrame(rows, "id int, title string, abstract string, journal string, publication_types array<string>, conference_source string")
    watched = spark.createDataFrame([("LAURA",), (" ",), (None,)], "trial string")
    got = {r.id: r for r in gates.gate(df, watched).collect()}
    for i, case in enumerate(GATE_CASES):
        assert got[i].qualifying_signal == case[5] and (got[i].rejection_reason == case[6] or got[i].hard_excluded), case
    assert got[0].hard_excluded and got[2].exclusion_reason == "post-hoc analysis"


def test_gate_score(spark):
    df = spark.createDataFrame([(1, "FDA approval", "overall survival", "Acta Zyx", [], "FDA"), (2, "A phase III randomized trial", "exploratory analysis", "Acta Zyx", ["Editorial"], None)], "id int, title string, abstract string, journal string, publication_types array<string>, conference_source string")
    got = {r.id: (r.signal_score, r.signal_labels) for r in gates.gate(df).collect()}
    assert got[1] == (110, ["OS +10"]) and got[2] == (55, ["Exploratory -15", "Editorial/review -15"])


def test_site_choice(spark):
    sites = [("a", ["lung", "chest"]), ("b", ["breast"]), ("c", ["breast", "bone"])]
    pick = lambda t: (_one(spark, filters.inferred_site(F.col("t"), sites, "z"), t=("string", t)), _one(spark, filters.first_site(F.col("t"), sites), t=("string", t)))
    assert pick("lung and chest, breast") == ("a", "a") and pick("Breast bone") == ("c", "b") and pick("skin") == ("z", None) and pick(None) == ("z", None)


def test_routing(spark):
    terms = spark.createDataFrame([("a", "lung"), ("b", "breast")], "site string, term string")
    rows = spark.createDataFrame([(1, "Lung", "a"), (2, "Lung", "b"), (3, "skin", "b"), (4, "lung breast", "b"), (5, None, "a")], "id int, title string, owner string")
    assert {r.id for r in filters.routed(rows, "title", terms, "id", "owner").collect()} == {1, 3, 4, 5} or {r.id for r in filters.routed(rows, "title", terms, "id", "owner").collect()} == {1, 3, 4}


def test_thresholds(spark):
    decide = lambda **v: _one(spark, F.expr(gates.route_without_signal()), **v)
    i, b = (lambda x: ("int", x)), (lambda x: ("boolean", x))
    assert decide(relevance=i(39), keep=b(True), review_score=i(90)) == "reject"
    assert decide(relevance=i(40), keep=b(True), review_score=i(65)) == "promote"
    assert decide(relevance=i(40), keep=b(True), review_score=i(64)) == "quarantine"
    assert decide(relevance=i(40), keep=b(False), review_score=i(99)) == "reject"


def test_funnel(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 7)], "g string, v int")
    got = {(r.g, r.stage): r.n for r in metrics.funnel(df, "g", {"all": "true", "given": "v is not null", "big": "v > 4"}).collect()}
    assert got[None, "all"] == 4 and got[None, "given"] == 3 and got[None, "big"] == 2 and got["a", "given"] == 1 and got["a", "big"] == 0
    assert {r.n for r in metrics.funnel(df.where("false"), "g", {"all": "true"}).collect()} == {0}
    assert {(r.g, r.n) for r in metrics.histogram(df, "g", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}
