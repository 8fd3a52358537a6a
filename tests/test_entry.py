"""The entry point with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print(','.join(sorted(e.queries())), ','.join(sorted(e.oracle_sql())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(x.split(",")) for x in out.stdout.split()]


def copied(folder, *without):
    hidden = {str(ROOT / w) for w in without}
    skip = lambda at, inside: [x for x in inside if f"{at}/{x}" in hidden or x in ("__pycache__", ".git", "tests")]
    return shutil.copytree(ROOT, folder, ignore=skip)


def test_queries_without_llm(tmp_path):
    own = None
    for k, without in enumerate((["vectrine/llm"], ["vectrine/llm", "corpus_pipeline.py"])):
        found, sql = names(copied(tmp_path / str(k), *without))
        assert "label_direction_cosines" in found and sql <= found
        assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in found)
        own = own or found
        assert found == own
