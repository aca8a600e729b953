"""The driver's contract: importable without a session, every oracle belongs to a query."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_session_or_optional_package(tmp_path):
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert int(subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, check=True).stdout) > 50
    for name in ("__spark_entry__.py", "helixframe"):
        (tmp_path / name).symlink_to(ROOT / name)
    bare = tmp_path / "bare"
    (bare / "helixframe").mkdir(parents=True)
    (bare / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "helixframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (bare / "helixframe" / p.name).symlink_to(p)
    assert int(subprocess.run([sys.executable, "-B", "-c", code], cwd=bare, env=env, capture_output=True, text=True, check=True).stdout) > 50
