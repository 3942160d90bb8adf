"""Neighbours of a full block are found with a bounded part of the similarities held."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tideway.operators import embeddings


def test_block_of_neighbours_holds_few_similarities():
    rng = np.random.default_rng(2)
    n, m = embeddings.BLOCK_TRAIN, embeddings.BLOCK_TEST
    x, y = rng.integers(-9, 10, (n, 4)).astype(float), rng.integers(-9, 10, (m, 4)).astype(float)
    train = pa.table({"id": rng.permutation(n), "label": rng.integers(0, 9, n), "z": pa.array(list(x))})
    test = pa.table({"test_id": np.arange(m), "z": pa.array(list(y))})
    tracemalloc.start()
    found = embeddings._top(3)((), train, test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    ids = train.column("id").to_numpy()
    for i in (0, 700, m - 1):
        best = sorted(zip(-(x @ y[i]), ids, strict=True))[:3]
        rows = found.slice(3 * i, 3)
        assert list(zip(-rows.column("sim").to_numpy(), rows.column("train_id").to_numpy(), strict=True)) == best
