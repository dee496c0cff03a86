"""What a Python worker holds after a task."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import tokens

_ROOT = Path(__file__).resolve().parents[2]
_HELD = """
import gc, re, sys
import pyarrow as pa
from tabloom.llm import common

def held():
    return sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

pins = []
def run(batches):
    parts = [b"x" * 50_000 for _ in range(4000)]
    pins.append(parts[-1])  # at the end of the heap, which therefore does not shrink by itself
    yield from batches

before = held()
list(common.lean(run)([])) if sys.argv[1] == "lean" else list(run([]))
gc.collect()
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_a_task_hands_freed_memory_back():
    got = {}
    for how in ("plain", "lean"):
        done = subprocess.run([sys.executable, "-c", _HELD, how], cwd=_ROOT, capture_output=True, text=True, check=True)
        got[how] = int(re.findall(r"-?\d+", done.stdout)[-1])
    assert got["plain"] > 150 and got["lean"] < 30, got


def test_other_operators_drop_the_tables_of_a_tokenizer():
    from tabloom.llm.common import lean
    from tabloom.llm.packing import word_vocabulary

    texts = pa.array(["one two, été."])
    want = tokens.encoder(word_vocabulary(), True).encode(texts).ids
    list(lean(iter, keeps=True)([]))
    assert tokens.encoder.cache_info().currsize >= 1
    list(lean(iter)([]))
    assert tokens.encoder.cache_info().currsize == tokens._load.cache_info().currsize == 0
    assert np.array_equal(tokens.encoder(word_vocabulary(), True).encode(texts).ids, want)


_PEAK = """
import random, re, threading, time
import pyarrow as pa
from tabloom.llm import alignment

def held():
    return sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def watched():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.02)

rng = random.Random(1)
word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
batches = [pa.record_batch({"text": [" ".join(word() for _ in range(400)) for _ in range(700)]}) for _ in range(2)]
run = alignment._encode(alignment.byte_vocabulary(), alignment.piece_vocabulary(), "text", False)
list(run([pa.record_batch({"text": ["a few words"]})]))
before, most = held(), [0]
threading.Thread(target=watched, daemon=True).start()
rows = sum(b.num_rows for b in run(batches))
print(rows, most[0] - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_alignment_takes_little_memory_beside_its_vocabularies():
    """Two workers and a JVM with a full heap share an executor."""
    done = subprocess.run([sys.executable, "-c", _PEAK], cwd=_ROOT, capture_output=True, text=True, check=True)
    rows, most = map(int, done.stdout.split("\n")[0].split())
    assert rows == 1400 and most < 220, most


def test_long_chunks_fill_a_table_before_many_do():
    from tabloom.llm import alignment

    pieces = alignment.Pieces(alignment.piece_vocabulary())
    coder = alignment._Spaced(alignment.byte_vocabulary(), False, 10)
    for c in "abcdef":
        texts = pa.array([c * 300])
        assert pieces.encode(texts)[0].tolist() == pieces.model.encode(c * 300)
        assert coder.encode(texts).ids.tolist() == coder.tokenizer.encode(" " + c * 300, add_special_tokens=False).ids
    assert len(coder.table.code) <= 3
