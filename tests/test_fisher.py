import math
import random

import numpy as np

from seqtrend.functions import stats


def every_table(a, b, c, d):
    """The same from the logarithms of all tables."""
    f = np.vectorize(lambda k: math.lgamma(k + 1))
    x = np.arange(max(0, a - d), min(a + b, a + c) + 1)
    logs = math.lgamma(a + b + 1) + math.lgamma(c + d + 1) + math.lgamma(a + c + 1) + math.lgamma(b + d + 1) - math.lgamma(a + b + c + d + 1) - f(x) - f(a + b - x) - f(a + c - x) - f(d - a + x)
    return min(1.0, np.exp(logs[logs <= logs[int(a - x[0])] + 1e-7]).sum())


def test_unlikely_tables_are_not_made(monkeypatch):
    """the exact test of two large variants makes few of their tables, and its p is that of all."""
    rng, made = random.Random(1), []
    for i in range(400):
        n = 10 ** rng.uniform(0, 4)
        share = 10 ** rng.uniform(-3, 0)
        cells = [max(0, round(rng.gauss(m, 2 * math.sqrt(m)))) for m in (n, n * share, n * rng.uniform(0.8, 1.2), n * share * rng.uniform(0.8, 1.2))]
        if min(cells[0] + cells[1], cells[2] + cells[3], cells[0] + cells[2], cells[1] + cells[3]):
            want = every_table(*cells)
            assert abs(stats.fisher_exact(*cells) - want) <= 1e-7 * want + 1e-300, cells
    real = np.arange
    monkeypatch.setattr(np, "arange", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    stats.fisher_exact(10_000, 9_900, 10_100, 10_050)
    assert len(made[0]) < 2_000
