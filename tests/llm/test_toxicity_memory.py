"""The driver's memory while toxicity is fitted."""

import tracemalloc

import numpy as np

from hyperslice.llm import toxicity


def test_fit_holds_little_besides_the_rows():
    """4.4 million terms in 3,000 rows: the sort of all terms and the tables of all pairs of terms took 170 MB before, 49 MB now."""
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 300_000, 1200), rng.integers(300_000, 302_000, 300)])).astype(np.int32) for _ in range(3000)]
    toxic = (rng.random(3000) < 0.4).astype(np.float64)
    rows = [np.union1d(r, [400_000] if y else [400_001]).astype(np.int32) if i % 3 else r for i, (r, y) in enumerate(zip(rows, toxic))]
    tracemalloc.start()
    model = toxicity.fit_sample(rows, toxic, 0.4, epochs=3)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert {400_000, 400_001} <= set(model.slots.tolist())
    assert peak < 80, peak
