"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from verisect.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "source", "docs", "hits", "share"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 200


def test_imports_without_the_optional_parts(tmp_path):
    (tmp_path / "verisect").symlink_to(ROOT / "verisect")
    code = "import sys; sys.modules['verisect.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.queries() and e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": "/tmp"})


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "verisect").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "verisect.llm" not in path.read_text()
