"""The entry module stands without the subpackage ``llm`` and names an oracle only for queries it has."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "fleetlens"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    pkg = tmp_path / "fleetlens"
    pkg.mkdir()
    for x in (ROOT / "fleetlens").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (pkg / x.name).symlink_to(x)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
