"""What a Python worker holds between two tasks, and at most."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import re
import numpy as np, pyarrow as pa
from quarrylight.llm import linededup, neardup
from quarrylight.llm.textkernel import lean
def mb(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
r = np.random.default_rng(1)
words = ["".join(map(chr, 97 + r.integers(0, 26, 6))) for _ in range(3000)]
texts = [" ".join(words[i] for i in r.integers(0, 3000, 300)) for _ in range(8000)]
n = len(texts)
batch = pa.record_batch([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["__id", "__rid", "__text"])
del texts
before = mb("RssAnon")
for run in (neardup._sign, linededup._signer(4)):
    for _ in lean(run)(iter([batch])):
        pass
print(mb("RssAnon") - before, mb("VmHWM") - before)
"""


def test_signing_takes_little_and_gives_it_back():
    out = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    held, most = map(int, re.findall(r"-?\d+", out))
    assert held < 40 and most < 160, (held, most)
