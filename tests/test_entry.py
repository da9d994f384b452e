import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_the_optional_subpackage(tmp_path):
    """A copy of the repository without it still imports, lists its own queries and runs them."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "sluice").rglob("*.py"):
        rel = p.relative_to(ROOT)
        if rel.parts[1:2] != ("llm",):
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(p.read_text())
    code = """
import __spark_entry__ as e
n = set(e.queries())
assert n and not any(x.startswith("op") for x in n) and set(e.oracle_sql()) <= n
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()["urls"](spark, e.SMALL).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_errors_inside_the_subpackage_are_raised(monkeypatch):
    import __spark_entry__ as entry

    def broken(name):
        raise ImportError(name)

    if entry._llm() is None:
        pytest.skip("no subpackage here")
    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ImportError):
        entry.queries()
