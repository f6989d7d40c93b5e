import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 30


def test_without_the_training_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, timeout=120, check=False).returncode == 0


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).orderBy("ef").collect()
    means = [r.recall_mean for r in rows]
    assert [r.ef for r in rows] == [10, 20, 40, 80, 160] and means == sorted(means)
