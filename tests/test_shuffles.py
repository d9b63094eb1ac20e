"""The permutation test in batches of draws: the same shuffles, and what they leave on disk."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from upland.operators import shuffles, validation

SCHEMA = "id long, latitude double, longitude double, v double"


def shuffled_bytes(spark) -> int:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data") if f.exists())


def test_hashes_of_packed_texts():
    texts = [*[str(i) for i in range(0, 3000, 7)], str(10**18), "-5", "é" * 20, "x" * 60, ""]
    halves = shuffles.md5_halves(pa.array(texts))
    for ending in (b"-0-42", b"-999-42"):
        found = [(int(a) << 64 | int(b)).to_bytes(16, "big").hex() for a, b in zip(*halves(ending), strict=True)]
        assert found == [hashlib.md5(t.encode() + ending).hexdigest() for t in texts]


def test_equal_first_halves_go_by_the_second():
    table = pa.table({"draw": [3, 3], "range": [0, 0], "before": [4, 5], "high": [np.array([7, 2], np.uint64).tobytes(), np.array([7], np.uint64).tobytes()], "low": [np.array([9, 1], np.uint64).tobytes(), np.array([5], np.uint64).tobytes()], "xs": [np.array([1.0, 2.0]).tobytes(), np.array([3.0]).tobytes()]})
    rows = shuffles.ordered(10)(table).to_pylist()
    assert [(r["block"], r["first"], np.frombuffer(r["xs"]).tolist()) for r in rows] == [(0, 9, [2.0]), (1, 0, [3.0, 1.0])]


def test_batches_of_draws_leave_no_files(spark, monkeypatch):
    """Disk holds a batch's shuffles, not all draws of all points; blocks, parts and batches give what one matrix gives."""
    n, draws, k, real, plane = 1200, 59, 4, validation.cut, validation.balanced.plane
    for name, size in (("AT_ONCE", 1), ("LEAST_DRAWS", 7), ("TASK_VALUES", 2000), ("VALUES", 1), ("RANGE_ROWS", 500)):
        monkeypatch.setattr(validation, name, size, raising=False)
    monkeypatch.setattr(validation.balanced, "LEAF", 16)
    monkeypatch.setattr(validation.balanced, "plane", lambda places, own, count, leaf=64: plane(places, own, count, 64))
    left = []

    def watched(df, name):
        before, out = shuffled_bytes(spark), real(df, name)
        for _ in range(100 if name == "statistics" else 0):
            left.append(shuffled_bytes(spark) - before)
            if left[-1] <= 0:
                break
            time.sleep(0.1)
        return out

    monkeypatch.setattr(validation, "cut", watched)
    rng = random.Random(4)
    spots = [(20 + rng.random(), 70 + rng.random()) for _ in range(300)]
    rows = [(i, *(rng.choice(spots) if i % 3 else (8 + rng.random(), 90.0)), rng.random()) for i in range(n)]
    got = validation.moran_permutations(spark.createDataFrame(rows, SCHEMA), "v", k, draws=draws).first()
    assert left and left[-1] <= 0
    x = np.array([r[3] for r in rows]) - np.mean([r[3] for r in rows])
    at = np.array([r[1:3] for r in rows])
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(n), d2.shape), d2))[:, :k]
    order = lambda d: sorted(range(n), key=lambda i: hashlib.md5(f"{i}-{d}-42".encode()).hexdigest())
    stat = lambda y: (y * y[near].mean(1)).sum() / (y * y).sum()
    drawn, y = [], np.empty(n)
    for d in range(1, draws + 1):
        y[order(0)] = x[order(d)]
        drawn.append(stat(y))
    assert got.i == pytest.approx(stat(x)) and got.p_value == pytest.approx(np.mean(np.array(drawn) >= stat(x)))
