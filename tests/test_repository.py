"""The entry point works with and without the optional subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['temblor.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_zone_stats' in q and 'pipeline' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, check=False).returncode == 0


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "temblor").rglob("*.py"):
        if "llm" not in path.parts:
            assert "temblor.llm" not in path.read_text(), path
    assert importlib.import_module("temblor.plans.registry").QUERIES
