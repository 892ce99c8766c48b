"""The ranking engine stands without the corpus operators and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(o) - set(q)))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_corpus_operators(tmp_path, pipeline):
    left = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n, ops, unknown = map(int, out.stdout.split())
    assert n > 200 and ops == 0 and unknown == 0


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("tideline/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "tideline.llm" not in path.read_text(), path
