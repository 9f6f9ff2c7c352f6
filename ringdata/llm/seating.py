"""Numbers of tables in Pitman-Yor restaurants: exact draws and moments of their full conditional.

The tables t of a word with c customers, where a new table weighs x, follow
p(t) ~ S(c, t) x^t (S: generalised Stirling numbers of discount d). Up to EXACT
customers draws invert the exact distribution. For any more, mean and variance come
from the recurrence of the normaliser Z(c + 1) / Z(c) = x + c - d E[t], which gives
dE[t]/dc = (x - d V[t]) / (x + c - d E[t]) with V[t] = dE[t] / d ln x, integrated from
EXACT on; t is a sum of independent 0/1 variables, so two moments describe it well.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EXACT = 64
#: Grid of ln x, and growth of c from one row of the table of moments to the next.
LOG_X = np.arange(-30.0, 30.05, 0.1)
GROWTH = 1.02
MOST = 1e12
CHUNK = 1 << 16


@lru_cache(maxsize=8)
def log_stirling(d: float) -> np.ndarray:
    """log S(c, t) for discount d, for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            t = np.arange(EXACT + 2)
            old = out[c] + np.log(np.maximum(c - d * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], old[1:])
    return out[:, : EXACT + 1]


@lru_cache(maxsize=8)
def moments(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers of each row, and tables (row, ln x) of the mean and the variance of t."""
    table, x = log_stirling(d), np.exp(LOG_X)
    rows, means = [0.0], [np.zeros(len(x))]
    for c in range(1, EXACT + 1):
        t = np.arange(1, c + 1)
        w = table[c, 1 : c + 1] + LOG_X[:, None] * t
        w = np.exp(w - w.max(axis=1, keepdims=True))
        rows.append(float(c))
        means.append((w @ t) / w.sum(axis=1))

    def slope(c: float, m: np.ndarray) -> np.ndarray:
        return (x - d * np.gradient(m, LOG_X)) / (x + c - d * m)

    c, m = rows[-1], means[-1]
    while c < MOST:
        h = c * (GROWTH - 1)
        k1 = slope(c, m)
        k2 = slope(c + h / 2, m + h / 2 * k1)
        k3 = slope(c + h / 2, m + h / 2 * k2)
        k4 = slope(c + h, m + h * k3)
        c, m = c + h, np.clip(m + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), 1.0, c + h)
        rows.append(c)
        means.append(m)
    means = np.array(means)
    return np.array(rows), means, np.maximum(np.gradient(means, LOG_X, axis=1), 0.0)


def _look_up(c: np.ndarray, x: np.ndarray, d: float, which: int) -> np.ndarray:
    """Bilinear in ln x and, above EXACT, in ln c; CHUNK numbers at a time, as each takes some ten on the way."""
    if len(c) > CHUNK:
        return np.concatenate([_look_up(c[lo : lo + CHUNK], x[lo : lo + CHUNK], d, which) for lo in range(0, len(c), CHUNK)])
    rows, table = moments(d)[0], moments(d)[which]
    s = np.clip((np.log(np.maximum(x, 1e-300)) - LOG_X[0]) / (LOG_X[1] - LOG_X[0]), 0, len(LOG_X) - 1.001)
    i, fs = s.astype(np.int64), s - s.astype(np.int64)
    r = np.where(c <= EXACT, c, EXACT + np.log(np.maximum(c, EXACT) / EXACT) / np.log(GROWTH))
    r = np.clip(r, 0, len(rows) - 1.001)
    k, fr = r.astype(np.int64), r - r.astype(np.int64)
    at = lambda k: table[k, i] * (1 - fs) + table[k, i + 1] * fs
    return at(k) * (1 - fr) + at(k + 1) * fr


def mean_tables(c: np.ndarray, x: np.ndarray, d: float) -> np.ndarray:
    """E[t] of words with c customers (0 for none)."""
    return np.where(c <= 1, c, _look_up(c, x, d, 1))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) that only depends on key and salt, so that draws do not depend on how work is dealt."""
    z = key + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sample_tables(c: np.ndarray, x: np.ndarray, d: float, key: np.ndarray, salt: int) -> np.ndarray:
    """One draw of t for each word."""
    t = np.minimum(c, 1).astype(np.int64)
    draw = uniform(key, 3 * salt)
    table = log_stirling(d)
    order = np.argsort(np.minimum(c, EXACT + 1), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        chunk = 4 * CHUNK // n  # rows of n numbers
        for lo in range(bounds[n], bounds[n + 1], chunk):
            rows = order[lo : min(lo + chunk, bounds[n + 1])]
            w = table[n, 1 : n + 1] + np.log(x[rows])[:, None] * np.arange(1, n + 1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (w < draw[rows][:, None] * w[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    if len(rows):
        mean, var = (_look_up(c[rows], x[rows], d, i) for i in (1, 2))
        normal = np.sqrt(-2 * np.log(uniform(key[rows], 3 * salt + 1))) * np.cos(2 * np.pi * uniform(key[rows], 3 * salt + 2))
        # rounding up or down by chance keeps the mean and adds a variance of 1/6 or less
        spread = np.sqrt(np.maximum(var - 1 / 6, 0.0)) * (mean > 4)
        t[rows] = np.clip(np.floor(mean + spread * normal + draw[rows]), 1, c[rows])
    return t
