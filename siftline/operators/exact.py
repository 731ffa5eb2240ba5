"""Exact binomial tails and intervals for any number of trials, over arrays."""

from __future__ import annotations

import math

import numpy as np

LARGE = 1000.0  # from here on for both parameters, the density is so smooth that fixed nodes integrate it
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) by its continued fraction, for x below (a + 1) / (a + b + 2), where it converges fast."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 5000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    front = _lgamma(a + b).astype(float) - _lgamma(a).astype(float) - _lgamma(b).astype(float) + a * np.log(x) + b * np.log1p(-x)
    return np.exp(front) * h / a


def _integral(lo: np.ndarray, hi: np.ndarray, mode: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The density between lo and hi as a multiple of that at the mode."""
    half = (hi - lo) / 2
    away = half[:, None] * (_NODES + 1) + (lo - mode)[:, None]
    log = (a - 1)[:, None] * np.log1p(away / mode[:, None]) + (b - 1)[:, None] * np.log1p(-away / (1 - mode)[:, None])
    return half * (np.exp(log) * _WEIGHTS).sum(1)


def _smooth(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I_x(a, b) for large a and b: the share of the density below x, all of it within 12 deviations of the mode."""
    mode = (a - 1) / (a + b - 2)
    sd = np.sqrt(mode * (1 - mode) / (a + b))
    least, most = np.maximum(mode - 12 * sd, 0), np.minimum(mode + 12 * sd, 1)
    whole = _integral(least, mode, mode, a, b) + _integral(mode, most, mode, a, b)
    # the tail beyond x, where it falls off with the distance
    far = np.maximum(np.abs(x - mode) / sd, 1)
    reach = np.minimum(12.0, 40 / far) * sd
    below = x < mode
    tail = np.where(below, _integral(np.maximum(x - reach, 0), x, mode, a, b), _integral(x, np.minimum(x + reach, 1), mode, a, b)) / whole
    return np.clip(np.where(below, tail, 1 - tail), 0, 1)


def beta_share(x, a, b) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b) of arrays; a, b > 0."""
    x, a, b = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(x, a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    inside = (x > 0) & (x < 1)
    smooth = inside & (np.minimum(a, b) >= LARGE)
    turned = inside & ~smooth & (x > (a + 1) / (a + b + 2))
    plain = inside & ~smooth & ~turned
    with np.errstate(all="ignore"):
        if smooth.any():
            out[smooth] = _smooth(x[smooth], a[smooth], b[smooth])
        if turned.any():
            out[turned] = 1 - _fraction(1 - x[turned], b[turned], a[turned])
        if plain.any():
            out[plain] = _fraction(x[plain], a[plain], b[plain])
    return np.clip(out, 0, 1)


def binomial_tail(k, n, p) -> np.ndarray:
    """P(Bin(n, p) >= k) of arrays."""
    k, n, p = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(k, n, p))
    sure, never = k <= 0, k > n
    return np.where(sure, 1.0, np.where(never, 0.0, beta_share(p, np.maximum(k, 1), np.maximum(n - k + 1, 1))))


def clopper_pearson(k, n, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Exact binomial intervals of arrays of counts; (0, 1) for n = 0."""
    k, n = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(k, n))

    def solve(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
        lo, hi = np.zeros(len(a)), np.ones(len(a))
        for _ in range(64):
            mid = (lo + hi) / 2
            less = beta_share(mid, a, b) < share
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return (lo + hi) / 2

    low = np.where((k <= 0) | (n <= 0), 0.0, solve(np.maximum(k, 1), np.maximum(n - k + 1, 1), alpha / 2))
    high = np.where((k >= n) | (n <= 0), 1.0, solve(k + 1, np.maximum(n - k, 1), 1 - alpha / 2))
    return low, high
