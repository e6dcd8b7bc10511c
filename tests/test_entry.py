"""The driver contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == 270 and rows.columns == ["series_id", "ds", "trend", "seasonality", "yhat"]


def test_without_the_corpus_operators():
    code = "import sys; sys.modules['cadenza.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'fit_kkt' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_them():
    for f in [*ROOT.glob("cadenza/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in f.relative_to(ROOT).parts and f.name != "test_entry.py":
            assert "llm" not in f.read_text(), f
