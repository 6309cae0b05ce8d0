"""What the training-data operators hold in a worker's memory."""
import ctypes
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from rolecall.llm import exchange, repeats


def held_mb():
    return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) / 1024


def test_identifiers_keep_only_the_lengths_still_needed():
    data = np.random.default_rng(5).integers(0, 256, 300_000).astype(np.uint8)
    tracemalloc.start()
    half, whole = repeats._identifiers(data, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6.5 * 8 * len(data)  # arrays of all nine lengths were 13 times as much
    assert len(half) == len(data) - 99 and len(whole) == len(data) - 199


def test_freed_memory_goes_back_to_the_system():
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        return
    small = [bytes(2000) for _ in range(60_000)]  # small blocks lie on the heap, held open by the last one
    tables = [pa.array([str(i) * 20 for i in range(2000)]) for _ in range(100)]
    last = bytes(2000)
    full = held_mb()
    del small, tables
    for _ in exchange.giving_back(iter([1, 2])):
        pass
    assert held_mb() < full - 100 and len(last) == 2000


def test_frames_pass_unchanged_and_in_order():
    assert list(exchange.giving_back(iter(range(5)))) == list(range(5))
    assert list(exchange.giving_back(iter([]))) == []


def test_workers_share_one_heap(spark):
    exchange.prepare(spark)
    assert spark.sparkContext.environment["ARROW_DEFAULT_MEMORY_POOL"] == "system"
