import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_is_readable_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_core_does_not_need_the_llm_package():
    code = "import sys; sys.modules['lumenlit.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p3_found' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    named = [p for p in (ROOT / "lumenlit").rglob("*.py") if "llm" not in p.relative_to(ROOT / "lumenlit").parts and "lumenlit.llm" in p.read_text()]
    assert not named


def test_flagship(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.queries()["weekly_selection"](spark, sf)
    assert rows.columns == ["candidate_id", "cancer_site_code", "qualifying_signal", "signal_score", "tier"] and rows.count() > 0
