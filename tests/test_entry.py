import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_queries_and_sql_have_the_same_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_subpackage(tmp_path):
    """The rest imports and registers its queries when filigrane/llm and corpus_pipeline.py are gone."""
    for name in ("__spark_entry__.py", "filigrane"):
        at = REPO / name
        shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if at.is_dir() else shutil.copy(at, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metrics_summary' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (REPO / "filigrane").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "filigrane").parts:
            assert "filigrane.llm" not in p.read_text(), p
