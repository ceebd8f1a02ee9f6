"""Scalar p-value math on small, already-aggregated results (one number per
column).  No SciPy: closed forms and classic series."""

from __future__ import annotations

import math

import numpy as np


def ks_2samp_exact_p(d: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the two-sample KS statistic ``d``: the share of
    monotone lattice paths from (0,0) to (n1,n2) that leave the band
    |i/n1 - j/n2| < d.

    The paths that leave are counted themselves, by the first point outside: paths that
    stay inside up to the step before it, times all ways on from there.  Every term is
    positive, so a small p keeps its digits where 1 minus the paths inside would lose
    them.  Rows are rescaled as they go so nothing overflows."""
    if n1 <= 0 or n2 <= 0:
        return float("nan")
    m, n = (n1, n2) if n1 >= n2 else (n2, n1)
    # inside while |i/m - j/n| < d  <=>  |i*n - j*m| < d*m*n (with a
    # small tolerance so that paths exactly at distance d count as outside)
    lim = d * m * n - 1e-7 * max(1.0, d * m * n)
    if lim <= 0:
        return 1.0
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, m + n + 1)))])

    def ways(i, j):
        """log of the number of paths from (i, j) to the end."""
        return log_fact[m - i + n - j] - log_fact[m - i] - log_fact[n - j]

    # the inside of row i is j = first..last
    rows = np.arange(m + 1)
    first = np.maximum(0, np.floor((rows * n - lim) / m).astype(int) + 1)
    last = np.minimum(n, np.ceil((rows * n + lim) / m).astype(int) - 1)
    total, terms, scale = ways(0, 0), [], 0.0
    row = np.zeros(n + 2)  # scaled paths to (i, j) that never left
    row[0] = 1.0
    for i in range(m + 1):
        lo, hi = first[i], last[i]
        if i:
            below = np.zeros(n + 2)
            below[lo:hi + 1] = row[lo:hi + 1]
            row = below
        row[lo:hi + 1] = np.cumsum(row[lo:hi + 1])
        top = row[lo:hi + 1].max() if hi >= lo else 0.0
        if top <= 0:
            break
        row[lo:hi + 1] /= top
        scale += math.log(top)
        if hi < n and row[hi] > 0:  # a step beyond the last
            terms.append(math.log(row[hi]) + scale + ways(i, hi + 1))
        if i < m:  # steps down to a point before the next row's first
            j = np.arange(lo, min(hi + 1, first[i + 1]))
            j = j[row[j] > 0]
            terms.extend((np.log(row[j]) + scale + ways(i + 1, j)).tolist())
    return float(min(1.0, math.fsum(math.exp(t - total) for t in terms)))


def kolmogorov_sf(lam: float) -> float:
    """Survival function of the Kolmogorov distribution.  From 1 on
    2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2); below, where that series converges
    slowly, 1 minus its theta-function transform
    sqrt(2 pi) / lambda * sum_{k>=1} exp(-(2k-1)^2 pi^2 / (8 lambda^2))."""
    if lam <= 0:
        return 1.0
    if lam < 1:
        base = -math.pi ** 2 / (8 * lam * lam)
        inside = math.fsum(math.exp(base * (2 * k - 1) ** 2) for k in range(1, 6))
        return float(min(1.0, max(0.0, 1.0 - math.sqrt(2 * math.pi) / lam * inside)))
    return float(2.0 * math.fsum((1 if k % 2 else -1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 20)))


def ks_2samp_p(d: float, n1: int, n2: int, exact_limit: int = 10000) -> tuple[float, str]:
    """Exact when both samples are at most ``exact_limit`` rows, else the
    Kolmogorov limit at the effective size n1*n2/(n1+n2)."""
    if d is None or n1 <= 0 or n2 <= 0:
        return float("nan"), "none"
    if max(n1, n2) <= exact_limit:
        return ks_2samp_exact_p(d, n1, n2), "exact"
    en = n1 * n2 / (n1 + n2)
    return kolmogorov_sf(math.sqrt(en) * d), "asymp"


def _gammainc_lower_series(a: float, x: float) -> float:
    s, term, k = 1.0 / a, 1.0 / a, 0
    while k < 100000:
        k += 1
        term *= x / (a + k)
        s += term
        if abs(term) < abs(s) * 1e-16:
            break
    return s * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gammainc_upper_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, dof: int) -> float:
    """Survival function of chi-square: regularised upper gamma Q(dof/2, x/2)."""
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    if z < a + 1.0:
        return float(max(0.0, 1.0 - _gammainc_lower_series(a, z)))
    return float(min(1.0, _gammainc_upper_cf(a, z)))
