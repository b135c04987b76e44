import subprocess
import sys

import pytest

#: Runs tasks in a process of its own, as a worker does, and prints the MB that it keeps over its start.
TASKS = """
import re
import numpy as np
import pyarrow as pa
from dugout.llm import jaccard_join, string_kernel

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = np.random.default_rng(5)
    words = np.array(["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20_000)])
    for _ in range(2):
        yield pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(words, 300)) for _ in range(4_000)]})

for batch in batches():
    pass
del batch
start = held()
for task in range(2):
    for counted in jaccard_join._count(5, 6)(batches()):
        pass
    del counted
print(held() - start)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_memory_back_at_a_tasks_end():
    """A worker waits for further tasks: what one has freed must not stay with it."""
    said = subprocess.run([sys.executable, "-c", TASKS], capture_output=True, text=True, timeout=120, check=True).stdout
    assert float(said.split()[-1]) < 20


def test_a_release_comes_after_the_last_batch_and_changes_none(monkeypatch):
    from dugout.llm import runtime

    said = []
    monkeypatch.setattr(runtime, "release", lambda: said.append("released"))
    for batch in runtime.releasing(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        said.append(batch)
    assert said == [2, 3, "released"]
