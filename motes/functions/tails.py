"""Tail probabilities as Arrow UDFs.  They run on aggregated rows: one per marker,
pair or combination, never on objects."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _stirling_error(n: float) -> float:
    """log(n!) minus its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    n2 = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n2)) / n2) / n2) / n


def _deviance(x: float, m: float) -> float:
    """x*log(x/m) + m - x without cancellation (Loader 2000)."""
    if abs(x - m) < 0.1 * (x + m):
        v = (x - m) / (x + m)
        s, ej, j = (x - m) * v, 2 * x * v, 1
        while True:
            ej *= v * v
            nxt = s + ej / (2 * j + 1)
            if nxt == s:
                return s
            s, j = nxt, j + 1
    return x * math.log(x / m) + m - x


def _log_binom(x: float, n: float, p: float) -> float:
    q = 1 - p
    if p <= 0 or q <= 0:
        return 0.0 if x == n * p else -math.inf
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    c = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeom(x: int, total: int, good: int, drawn: int) -> float:
    """log P(X = x) for ``drawn`` of ``total`` items with ``good`` successes; precise for huge counts."""
    if x < max(0, drawn - (total - good)) or x > min(good, drawn):
        return -math.inf
    if total == 0:
        return 0.0
    p = drawn / total
    return (_log_binom(x, good, p) + _log_binom(drawn - x, total - good, p) - _log_binom(drawn, total, p))


def _tail(x: int, step: int, total: int, good: int, drawn: int) -> float:
    """Sum of P(x), P(x+step), ... until the terms no longer matter."""
    lo, hi = max(0, drawn - (total - good)), min(good, drawn)
    log_p = log_hypergeom(x, total, good, drawn)
    out, chunk = 0.0, 4096
    while lo <= x <= hi and log_p > -745:
        n = min(chunk, (hi - x if step > 0 else x - lo) + 1)
        k = x + step * np.arange(n, dtype=float)
        if step > 0:
            ratio = (good - k) * (drawn - k) / ((k + 1) * (total - good - drawn + k + 1))
        else:
            ratio = k * (total - good - drawn + k) / ((good - k + 1) * (drawn - k + 1))
        with np.errstate(divide="ignore"):
            logs = log_p + np.concatenate([[0.0], np.cumsum(np.log(np.maximum(ratio, 0.0)))])
        part = float(np.exp(logs[:n]).sum())
        out += part
        if part < out * 1e-17:
            break
        x, log_p = x + step * n, float(logs[n])
    return out


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of [[a, b], [c, d]]."""
    total, good, drawn = a + b + c + d, a + b, a + c
    lo, hi = max(0, drawn - (total - good)), min(good, drawn)
    if lo == hi:
        return 1.0
    limit = log_hypergeom(a, total, good, drawn) + 1e-7
    mode = min(hi, max(lo, (good + 1) * (drawn + 1) // (total + 2)))

    def edge(inside: int, outside: int) -> int | None:
        """Nearest value towards ``outside`` whose probability is at most the observed one."""
        if log_hypergeom(outside, total, good, drawn) > limit:
            return None
        while abs(outside - inside) > 1:
            mid = (inside + outside) // 2
            if log_hypergeom(mid, total, good, drawn) > limit:
                inside = mid
            else:
                outside = mid
        return outside

    if log_hypergeom(mode, total, good, drawn) <= limit:
        return 1.0
    left, right = edge(mode, lo), edge(mode, hi)
    p = 0.0
    if left is not None:
        p += _tail(left, -1, total, good, drawn)
    if right is not None:
        p += _tail(right, 1, total, good, drawn)
    return min(1.0, p)


@pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype=float)


def chi2_tail(x: float, df: int) -> float:
    """P(chi2 > x), finite sums for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else chi2_tail(float(v), int(k)) for v, k in zip(x, df)], dtype=float)


@lru_cache(maxsize=16)
def _partition_terms(n1: int) -> tuple[int, list[int]]:
    """Period L and numerator of 1 / ((1-q)(1-q)(1-q^2)..(1-q^n1)) written over (1-q^L)^(n1+1)."""
    period = math.lcm(*range(1, n1 + 1))
    top = [1]
    for i in [1, *range(1, n1 + 1)]:
        # times (1 - q^L) / (1 - q^i) = 1 + q^i + q^2i + ...: a running sum of stride i, cut after L / i terms
        out = top + [0] * (period - i)
        for j in range(i, len(out)):
            out[j] += out[j - i]
        top = [x - (out[j - period] if j >= period else 0) for j, x in enumerate(out)]
    return period, top


def _mwu_exact(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, for any size of the larger side.

    The counts of U are the Gaussian binomial coefficient; its numerator is opened by inclusion and
    exclusion over the small side, and each term counts partitions by a closed form in whole numbers.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    most = n1 * n2 - math.ceil(u)
    if most < 0:
        return 0.0
    period, top = _partition_terms(n1)

    def up_to(t: int) -> int:
        return sum(top[j] * math.comb((t - j) // period + n1, n1) for j in range(t % period, min(t, len(top) - 1) + 1, period))

    sums = {0: 1}
    for i in range(1, n1 + 1):
        nxt = dict(sums)
        for s, c in sums.items():
            nxt[s + n2 + i] = nxt.get(s + n2 + i, 0) - c
        sums = nxt
    return sum(c * up_to(most - s) for s, c in sums.items() if c and s <= most) / math.comb(n1 + n2, n1)


def mwu_p(u1: float, n1: int, n2: int, tie_sum: float) -> float:
    """Two-sided Mann-Whitney p: exact for a small tie-free side, else the
    continuity-corrected normal approximation with tie correction."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and tie_sum == 0:
        return min(1.0, 2 * _mwu_exact(u, n1, n2))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


@pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mwu_p(float(a), int(b), int(c), float(t)) for a, b, c, t in zip(u, n1, n2, ties)], dtype=float)


#: NumPy draws hypergeometric numbers for populations below this size; above it the same law is drawn here.
DRAW_LIMIT = 1_000_000_000


def _draw_large(rng: np.random.Generator, total: int, good: int, drawn: int) -> int:
    """One hypergeometric number for a population of any size.

    Few expected successes: inversion from the lower end.  Else ratio of uniforms (Stadlober 1990),
    accepted by the exact probabilities.
    """
    lo, hi = max(0, drawn - (total - good)), min(good, drawn)
    if lo == hi:
        return lo
    mean = drawn * (good / total)
    if mean - lo < 10:
        x, u = lo, rng.random()
        p = math.exp(log_hypergeom(lo, total, good, drawn))
        while u > p and x < hi:
            u -= p
            p *= (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))
            x += 1
        return x
    if hi - mean < 10:
        return drawn - _draw_large(rng, total, total - good, drawn)
    var = mean * (1 - good / total) * ((total - drawn) / (total - 1))
    mode = min(hi, max(lo, (good + 1) * (drawn + 1) // (total + 2)))
    top = log_hypergeom(mode, total, good, drawn)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if lo <= x <= hi and 2 * math.log(u) <= log_hypergeom(x, total, good, drawn) - top:
            return x


def overlap_draws(n: int, counts: list[int], draws: int, seed: int) -> np.ndarray:
    """Overlap sizes of independently shuffled 0/1 columns with the given numbers of ones.

    The overlap of the first i+1 columns is a hypergeometric draw given the overlap
    of the first i, whatever the size of the table.
    """
    rng = np.random.default_rng(seed)
    h = np.full(draws, counts[0], dtype=np.int64)
    for c in counts[1:]:
        if n < DRAW_LIMIT:
            h = rng.hypergeometric(h, n - h, c)
        else:
            h = np.array([_draw_large(rng, n, int(x), c) for x in h], dtype=np.int64)
    return h


def exact_overlap_p(n: int, counts: list[int], observed: int) -> float:
    """P(overlap >= observed) by chaining the hypergeometric laws in logs; for tables of moderate size."""
    fact = np.vectorize(lambda k: math.lgamma(k + 1.0), otypes=[float])

    def choose(a, b):
        return np.where((b >= 0) & (b <= a), fact(a) - fact(np.clip(b, 0, n)) - fact(np.clip(a - b, 0, n)), -np.inf)

    h, log_w = np.array([counts[0]]), np.zeros(1)
    for c in counts[1:]:
        x = np.arange(0, min(int(h.max()), c) + 1)
        new = np.full(len(x), -np.inf)
        for own, w in zip(h.tolist(), log_w.tolist()):
            new = np.logaddexp(new, w + choose(np.full(len(x), own), x) + choose(np.full(len(x), n - own), c - x) - choose(n, c))
        h, log_w = x[new > -np.inf], new[new > -np.inf]
    return float(min(1.0, np.exp(log_w[h >= observed]).sum()))
