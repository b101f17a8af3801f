import os
import random

import pytest

from lumenlit.llm import pii, truncation, visual


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Write to jo.smith+x@mail.example.org please", {"email"}),
        ("claire65 AT ward7 DOT invalid", {"email"}),
        ("goran (at) example (dot) org", {"email"}),
        ("5 mg @ week 3, then 87 mg @ week 31. Follow @onco_digest.", set()),
        ("Call (030) 23125-233 after clinic.", {"phone"}),
        ("713 five-five-five 0147", {"phone"}),
        ("cost was 622 810 8799 units in the model", set()),
        ("Order set 1799607819 still lists the old dose. PMID 982840435", set()),
        ("Patient with NHS no. 999 740 8777 relapsed", {"id_number"}),
        ("Her 970-24-3857 is on page two.", {"id_number"}),
        ("DNI 99277211B", {"id_number"}),
        ("Protocol 59-181-065 allowed crossover; n=720, lot 20248124.", set()),
        ("Lives at 240, chandler's court, eastreach and cannot travel.", {"address"}),
        ("Lindenstraße 288a, Ostervelde", {"address"}),
        ("PO Box 357, Harrowick.", {"address"}),
        ("At Harrowick Cancer Centre we stopped. The Milan criteria were used.", set()),
        ("Dr. Quarlenko raised the same point.", {"name"}),
        ("Signed, helga quarlwick", {"name"}),
        ("As Krellez, Vera said, the crossover matters.", {"name"}),
        ("", set()),
        (None, set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for _, _, k, _ in pii.spans(text)} == kinds


@pytest.mark.parametrize("text, named", [("Tumor Board 904", False), ("onco-nurse", False), ("devika.x [at] lab.example.org", False), ("Griskez, Bettina", True), ("O. Isterez, MD", True), ("ivo morvini", True), ("Dario F.", True), ("Team Northmere", False), ("", False)])
def test_display_names(text, named):
    assert any(k == "name" for _, _, k, _ in pii.spans(text, True)) == named


def test_checksums():
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468")
    body = 2550875115001
    assert pii.mod97(f"{body}{97 - body % 97:02d}") and not pii.mod97(f"{body}{(98 - body % 97) % 97:02d}")


def test_redaction_leaves_the_rest(spark):
    text = "Hi, write to jo.smith@example.org or call 415-555-0132.\n" + "filler. " * 20_000
    assert pii.redact(text) == text.replace("jo.smith@example.org", "[EMAIL]").replace("415-555-0132", "[PHONE]")
    rows = [("a", "Vera Ulmerwick", "Text me at 6175550155.", 1)] * 3 + [("b", None, None, 1), (None, "", "", 1)]
    df = spark.createDataFrame(rows, "comment_id string, display_name string, content string, kind int")
    assert {tuple(r) for r in pii.personal_kinds(df).collect()} == {("a", "content", "phone"), ("a", "display_name", "name")}
    assert {tuple(r) for r in pii.redacted(df).collect()} == {("a", "[NAME]", "Text me at [PHONE]."), ("b", None, None), (None, "", "")}
    assert pii.personal_kinds(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_names_are_learned_where_the_list_has_gaps(spark):
    comments = spark.read.parquet("/root/testdata/sf0.1/comments.parquet").select("comment_id", "content", "display_name")
    learned, rng = pii.learned_filter(comments), random.Random(13)
    half = pii.Names(learned, set(rng.sample(sorted(pii.GIVEN_NAMES), len(pii.GIVEN_NAMES) // 2)))
    none = pii.Names(learned, set())
    alone = pii.Names(b"", set())
    texts = [(r.content, False) for r in comments.limit(3000).collect()] + [(r.display_name, True) for r in comments.limit(3000).collect()]
    named = lambda names: [any(k == "name" for _, _, k, _ in pii.spans(t, d, names)) for t, d in texts]
    whole, by_half, by_none, unlearned = named(pii.Names()), named(half), named(none), named(alone)
    kept = lambda found: sum(a and b for a, b in zip(whole, found)) / sum(whole)
    assert kept(by_half) >= 0.98 and kept(by_none) >= 0.95 > kept(unlearned)
    assert sum(b and not a for a, b in zip(whole, by_none)) <= 0.01 * sum(whole)


def test_given_names_by_place(spark):
    shown = ["Ozra Quarlby", "Ozra Munt", "Ozra Velt, MD", "Team North", "Team South", "Team West", "Quarlby, Timo", "Munt, Timo", "Velt, Timo", "Velt Ozra", None, "", "ozra munt"]
    df = spark.createDataFrame([("c", t, None) for t in shown], "comment_id string, display_name string, content string")
    assert {r.given for r in pii.given_names(df).collect()} == {"ozra", "timo"}
    assert pii.given_names(df.where("false")).count() == 0 and "ozra" in pii.Names(pii.learned_filter(df)) and "velt" not in pii.Names(pii.learned_filter(df))


def test_consistent_forms():
    form = lambda t: visual.consistent_form(t)[0]
    assert form("Τhe Ѕаіnt‑Оrvance ｄａｉｌｙ ﬁne​ Ⅲ") == "The Saint-Orvance daily fine III"
    assert form("Tяжёлыe побoчныe эффекты") == "Тяжёлые побочные эффекты"
    assert form("café x") == "café x" and form("m²") == "m²" != form("m2")
    assert form("The patients had PI3Kα and NF-κВ") == form("The patients had PI3Kα and NF-κB")
    assert form("A") != form("a") and form("résumé") != form("resume") and form("a!") != form("a.")
    assert form(None) is None and form("") == "" and len(form("а" * 200_000)) == 200_000


def test_forms_are_linear_and_stable():
    import time

    began = time.perf_counter()
    long = "the patients had a response " * 400 + "к"
    assert visual.consistent_form(long)[0] == visual.consistent_form(long[:-1] + "к")[0] and len(visual.consistent_form(long)[0]) == len(long)
    assert time.perf_counter() - began < 2
    rng = random.Random(9)
    letters = "abcopxyABCHKMeéñüßµ αβγσΣοΟΑΒабсеорухАВСЕНКМй Ϲϲſİıﬁ①²Ⅳ…´ ῾´-‑‐\u200b\u00ad0１.,\n"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        form = visual.consistent_form(text)[0]
        assert visual.consistent_form(form)[0] == form


def test_latin_texts_are_their_own_form(monkeypatch):
    import re

    texts = ["", "plain text.", "Für die Größe: 5 µg", "Ça coûte 3 × 4 €", "cope scope Hex", "AB-12\nÉÀ"]
    fast = [visual.consistent_form(t) for t in texts]
    monkeypatch.setattr(visual, "_LATIN", re.compile("(?!)"))
    assert fast == [visual.consistent_form(t) for t in texts]


def test_look_classes(spark):
    rows = [(1, "The dose", 0), (2, "Тhe dоsе", 0), (3, "The dose", 0), (3, "The dose", 0), (4, "the dose", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, look int")
    assert sorted(r.documents for r in visual.look_classes(df).collect()) == [1, 2] and visual.look_classes(df.where("false")).count() == 0


def test_look_alikes(spark):
    rows = [(1, "The dose", 0), (2, "Тhe dоsе", 0), (3, "The dose", 0), (4, "the dose", 0), (5, None, 0), (6, "", 0), (7, "", 0), (8, "The dose", 0), (8, "The dose", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, look int")
    assert {tuple(r) for r in visual.look_alikes(df).collect()} == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8)}
    assert visual.look_alikes(df.where("false")).count() == 0


def _corpus(rng, n):
    ends = ["was well tolerated by most patients", "improved overall survival in the treated group", "showed no benefit for older participants", "was stopped early because accrual was slow", "reduced the rate of nausea after surgery"]
    starts = ["The combination", "Adjuvant treatment", "A second course", "Radiotherapy", "The new regimen"]
    return [" ".join(f"{rng.choice(starts)} {rng.choice(ends)}." for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_truncation_held_out_accuracy(spark):
    rng = random.Random(4)
    rows, cut = [], set()
    for i, t in enumerate(_corpus(rng, 1500)):
        source = "bare" if i % 5 == 0 else "other"
        if rng.random() < 0.2 and len(t) > 60:
            t = t[: rng.randrange(40, len(t) - 2)].rstrip()
            if not t.endswith("."):
                cut.add(i)
        elif source == "bare" and rng.random() < 0.5:
            t = t.rstrip(".")  # this source leaves out the last stop
        elif rng.random() < 0.05:
            t += " Source: company statement"
        rows.append(("news", i, source, t, 1.0))
    rows += [("news", 9001, None, "It was stopped early because accr…", 0.0), ("news", 9002, "other", "<p>The combination was well tolerated by most patients.", 0.0), ("news", 9003, "other", None, 0.0), ("news", 9004, "other", "  ", 0.0), ("news", 0, "bare", rows[0][3], 0.0), ("news", 9005, "other", "The combination was well tolerated by most patients. " * 3000, 0.0)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string, mid double")
    scores = truncation.truncation_scores(df).collect()
    assert len(scores) == len({r.record_id for r in scores}) == 1503
    found = {r.record_id for r in scores if r.cut}
    assert {9001, 9002} <= found and 9005 not in found
    found -= {9001, 9002}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.03 * len(cut)


def test_contexts_counted_in_passes_give_the_same_scores(spark, monkeypatch):
    rows = [("news", i, "s", t if i % 7 else t[: len(t) * 2 // 3]) for i, t in enumerate(_corpus(random.Random(12), 300))]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")
    once = {r.record_id: (round(r.log_odds, 9), r.cut) for r in truncation.truncation_scores(df).collect()}
    monkeypatch.setattr(truncation, "MOST_BITS", 1 << 13)
    monkeypatch.setattr(truncation, "LEAST_BITS", 1 << 10)
    assert truncation.filter_plan(300 * len(truncation.ORDERS))[1] == 4
    assert {r.record_id: (round(r.log_odds, 9), r.cut) for r in truncation.truncation_scores(df).collect()} == once


def test_passes_hold_one_filter_and_repeats_need_none(spark, monkeypatch):
    rows = [("news", i + 300 * copy, "s", t) for copy in range(4) for i, t in enumerate(_corpus(random.Random(12), 300))]
    df = spark.createDataFrame(rows, "table_name string, record_id long, source string, text string")
    planned, held, most = [], set(), [0]
    plan, share = truncation.filter_plan, spark.sparkContext.broadcast
    monkeypatch.setattr(truncation, "filter_plan", lambda contexts: planned.append(contexts) or plan(contexts))

    def broadcast(value):
        shared = share(value)
        destroy = shared.destroy
        held.add(id(shared))
        most[0] = max(most[0], len(held))
        shared.destroy = lambda *a: (held.discard(id(shared)), destroy(*a))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(truncation, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(truncation, "LEAST_BITS", 1 << 6)
    assert truncation.truncation_scores(df).count() == 1200
    assert planned[0] <= 1.1 * 300 * len(truncation.ORDERS) and plan(planned[0])[1] > 1 and most == [1]


def test_truncation_of_nothing(spark):
    empty = spark.createDataFrame([], "table_name string, record_id long, source string, text string")
    scores = truncation.truncation_scores(empty)
    assert scores.count() == 0 and truncation.truncation_rates(scores).count() == 0
