"""Very long texts of bad shapes: what a worker takes for one, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
MB = 1 << 20
RUN = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
{setup}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{run}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
FIELD = "from tideline.llm import quality as q; f = q.Field(np.ones((len(q.NAMES), 2)), np.zeros((2, 2)), np.zeros(2))"
LM = "from tideline.llm import toxicity as t; r = t.Reader(np.zeros((32, 32, 32)))"
#: name: (what is set up, what is run with a text of 8 MB, MB that it may take)
SHAPES = {
    "lines of three bytes": (FIELD + "; x = b'ab\\n' * ((8 << 20) // 3)", "q.measure([x], f)", 500),
    "one line": (FIELD + "; x = b'word ' * ((8 << 20) // 5)", "q.measure([x], f)", 400),
    "one token": (LM + "; x = 'a1' * (4 << 20)", "r.features(x)", 300),
    "letters set apart": (LM + "; x = 'a ' * (4 << 20)", "r.features(x)", 300),
    "a recording": ("from tideline.llm import telephony as t; x = t.store(t.pad(b'x' * (32 << 20)))", "t.features([t.load(x)])", 300),
}


@pytest.mark.parametrize("name", SHAPES)
def test_memory(name):
    setup, run, most = SHAPES[name]
    out = subprocess.run([sys.executable, "-c", RUN.format(root=str(ROOT), setup=setup, run=run)], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout) < most
