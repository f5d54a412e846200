import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_and_queries_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "docspark", tmp_path / "docspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "docspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "docspark").parts:
            assert "docspark.llm" not in path.read_text() and "import llm" not in path.read_text()


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 40 and {r.status for r in rows} <= {"grounded", "low_confidence", "not_found"}
