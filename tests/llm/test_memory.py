"""What a task no longer uses is not kept by its Python worker."""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import op03_substring
from quantloom.llm import textarrays as ta


def _own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs Linux with glibc")
def test_slices_give_memory_back():
    batch = pa.RecordBatch.from_arrays([pa.array(["text"] * 3)], names=["text"])
    before, pins = _own_mb(), []
    for _ in ta.slices(batch, 0, 1):
        blocks = [np.ones(8000) for _ in range(3000)]  # 192 MB in blocks that the C library keeps
        pins.append(blocks[-1])  # what lies last stays in use
        del blocks
    assert _own_mb() - before < 60


def test_kept_of_no_rows():
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.list_(pa.struct({"start": pa.int32(), "windows": pa.int32()})))], names=["id", "text", "spans"])
    assert [b.num_rows for b in op03_substring._kept(20, True, False)(iter([none]))] == [0]


def test_verification_gives_memory_back(monkeypatch):
    from quantloom.llm import op04_near_dup

    calls, sets = [], [np.arange(100, dtype=np.uint64)] * 2
    monkeypatch.setattr(ta, "give_back", lambda: calls.append(1))
    rows = pa.table({"doc": pa.array([7, 3]), "family": pa.array([1, 1]), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    assert op04_near_dup._verified(85)(rows).column("component").to_pylist() == [3, 3]
    assert calls
