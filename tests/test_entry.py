"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "case_rank", "in_case", "chunk_id", "score", "channel", "uris"] and rows.count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    (tmp_path / "tessella").mkdir()
    for p in (REPO / "tessella").iterdir():
        if p.name != "llm":
            (tmp_path / "tessella" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
