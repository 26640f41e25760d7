"""Python workers are kept by Spark for later tasks: what a step took must not stay with them."""

import subprocess
import sys
from pathlib import Path

import pytest

MADE = """
import random, re, sys
import pyarrow as pa
from plumbline.llm import quality, similar, simhash
from plumbline.llm.decontaminate import _document_counts, Space, cut_items

class Sent:
    def __init__(self, value): self.value = value

def held():
    seen = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", seen))) / 1024

def batch(seed, rows, words):
    draw = random.Random(seed)
    texts = [" ".join(f"w{draw.randrange(50_000)}" for _ in range(words)) for _ in range(rows)]
    return pa.record_batch([pa.array(range(rows)), pa.array(range(rows)), pa.array(texts)], ["id", "th", "text"])

def read(seed, rows, words):
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, (made := batch(seed, rows, words)).schema) as to:
        to.write_batch(made)
    return pa.ipc.open_stream(out.getvalue()).read_next_batch()

def items():
    return [(i, " ".join(f"w{100 * i + k}" for k in range(60))) for i in range(50)]

works = {
    "count": lambda: similar._count,
    "marks": lambda: similar._marks,
    "prefixes": lambda: similar._prefixes(Sent(__import__("numpy").zeros(similar.CELLS, "uint8"))),
    "counts": lambda: _document_counts(Sent(Space(cut_items(items())))),
}
work = works[sys.argv[1]]()
for _ in work(iter([batch(0, 2, 50)])):
    pass
before = held()
for _ in work(read(k, 60, 20_000) for k in range(2)):
    del _
print(held() - before)
"""


@pytest.mark.parametrize("work", ["count", "marks", "prefixes", "counts"])
def test_a_worker_is_small_after_a_task(work):
    root = Path(__file__).resolve().parents[2]
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("memory can't be read here")
    ran = subprocess.run([sys.executable, "-c", MADE, work], cwd=root, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 40, ran.stdout
