"""Small statistics on numpy arrays and plain numbers."""

from __future__ import annotations

import math

import numpy as np


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table [[a, b], [c, d]]: the sum of all tables no likelier than it.

    Logarithms of neighbouring tables differ by four terms, so only the first one needs factorials. Where the table is
    within five standard deviations of the mean, those beyond ten (and 40 tables) are too unlikely to change the sum
    in double precision and aren't made: so the work grows with the root of the counts.
    """
    if min(a + b, c + d, a + c, b + d) == 0:
        return 1.0
    rows, cols, n = (a + b, c + d), (a + c, b + d), a + b + c + d
    low, high = max(0, cols[0] - rows[1]), min(rows[0], cols[0])
    mean = rows[0] * cols[0] / n
    spread = math.sqrt(mean * (rows[1] / n) * (cols[1] / max(1, n - 1)))
    if abs(a - mean) <= 5 * spread + 5:
        low, high = max(low, math.floor(mean - 10 * spread) - 40), min(high, math.ceil(mean + 10 * spread) + 40)
    x = np.arange(low, high + 1, dtype=float)
    f = lambda k: math.lgamma(k + 1)
    first = f(rows[0]) + f(rows[1]) + f(cols[0]) + f(cols[1]) - f(n) - f(x[0]) - f(rows[0] - x[0]) - f(cols[0] - x[0]) - f(rows[1] - cols[0] + x[0])
    y = x[:-1]
    steps = np.log((rows[0] - y) * (cols[0] - y) / ((y + 1) * (rows[1] - cols[0] + y + 1)))
    logs = first + np.concatenate([[0.0], np.cumsum(steps)])
    here = logs[int(a - x[0])]
    return float(min(1.0, np.exp(logs[logs <= here + 1e-7]).sum()))


def chi2_yates(a: float, b: float, c: float, d: float) -> float:
    """p of the chi-square test with one degree of freedom and Yates' correction; 1 for an empty margin."""
    n = a + b + c + d
    margins = (a + b, c + d, a + c, b + d)
    if not all(margins):
        return 1.0
    expected = [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n]
    gap = abs(a - expected[0])
    gap -= min(0.5, gap)
    return math.erfc(math.sqrt(sum(gap * gap / e for e in expected) / 2))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on its distribution function."""

    def below(t: float) -> float:
        # Integral of the density by Simpson's rule over the angle atan(t / sqrt(df)).
        angle, n = math.atan(t / math.sqrt(df)), 2000
        xs = np.linspace(0.0, angle, n + 1)
        ys = np.cos(xs) ** (df - 1)
        area = (ys[0] + ys[-1] + 4 * ys[1:-1:2].sum() + 2 * ys[2:-1:2].sum()) * (angle / n) / 3
        norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        return 0.5 + norm * area

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2
