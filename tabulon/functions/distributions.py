"""Statistical distributions of the sheet and their inverses, as pandas functions over Arrow batches.

The regularized incomplete gamma and beta functions are the usual pair of a power series and a continued fraction (each where it converges
fast), worked out for a whole batch at a time; inverses bracket the quantile and close in by Newton steps that fall back to halving.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Lanczos' approximation of the gamma function for g = 7 (fixed values).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY, _STEPS = 1e-300, 1000


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    y = np.where(small, 1 - x, x) - 1
    total = LANCZOS[0] + sum(c / (y + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = y + 7.5
    out = 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(total)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(small, np.log(np.pi) - np.log(np.abs(np.sin(np.pi * x))) - out, out)


def gamma_p(a: np.ndarray, x: np.ndarray, upper: bool = False) -> np.ndarray:
    """Regularized lower (or upper) incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        head = np.exp(-x + a * np.log(x) - ln_gamma(a))
        term, total, n = 1 / a, 1 / a, a.copy()
        for _ in range(_STEPS):
            n = n + 1
            term = term * x / n
            total = total + term
            if not (np.abs(term) > np.abs(total) * 1e-17)[x < a + 1].any():
                break
        series = head * total
        b, c = x + 1 - a, np.full(a.shape, 1 / _TINY)
        d = 1 / np.where(b == 0, _TINY, b)
        h = d.copy()
        for i in range(1, _STEPS):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if not (np.abs(d * c - 1) > 5e-16)[x >= a + 1].any():
                break
        fraction = head * h
    low = np.where(x < a + 1, series, 1 - fraction)
    high = np.where(x < a + 1, 1 - series, fraction)
    return np.where(x <= 0, float(upper), np.where(np.isinf(x), float(not upper), high if upper else low))


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    with np.errstate(all="ignore"):
        front = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        swap = x >= (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        c, d = np.ones(p.shape), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        for m in range(1, _STEPS):
            for aa in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + aa * d
                d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = 1 + aa / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                h = h * d * c
            if not (np.abs(d * c - 1) > 5e-16).any():
                break
        part = front * h / p
    out = np.where(swap, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def erf(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * gamma_p(0.5, np.square(x))


def _phi(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution, with its full precision in both tails."""
    z = np.asarray(z, float)
    tail = 0.5 * gamma_p(0.5, z * z / 2, upper=True)
    return np.where(z < 0, tail, 1 - tail)


def inverse(cdf: Callable, pdf: Callable, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """x with cdf(x) = p: the bracket grows where an end is infinite, then Newton steps, or halving where a step leaves the bracket."""
    p, lo, hi = (np.array(v, float) for v in np.broadcast_arrays(p, low, high))
    with np.errstate(all="ignore"):
        for sign, end in ((-1, lo), (1, hi)):
            step, open_ = 1.0, np.isinf(end)
            end[open_] = sign
            while open_.any() and step < 1e300:
                step *= 2
                open_ &= (cdf(end) - p) * sign < 0
                end[open_] = sign * step
        x = (lo + hi) / 2
        for _ in range(200):
            gap = cdf(x) - p
            hi, lo = np.where(gap >= 0, x, hi), np.where(gap < 0, x, lo)
            new = x - gap / pdf(x)
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
            done = (np.abs(new - x) <= 4e-15 * np.abs(new)) | (hi - lo <= 4e-16 * np.abs(new)) | (gap == 0)
            x = np.where(gap == 0, x, new)
            if done.all():
                break
    return x


def _gamma_pdf(a, x, scale):
    with np.errstate(all="ignore"):
        return np.exp((a - 1) * np.log(x / scale) - x / scale - ln_gamma(a)) / scale


def _beta_pdf(a, b, x):
    with np.errstate(all="ignore"):
        return np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))


def _t_cdf(x, v):
    tail = 0.5 * beta_i(v / 2, 0.5, v / (v + x * x))
    return np.where(x > 0, 1 - tail, tail)


def _t_pdf(x, v):
    return np.exp(ln_gamma((v + 1) / 2) - ln_gamma(v / 2)) / np.sqrt(v * np.pi) * (1 + x * x / v) ** (-(v + 1) / 2)


def _f_cdf(x, a, b):
    return beta_i(a / 2, b / 2, a * x / (a * x + b))


def _f_tail(x, a, b):
    """1 - _f_cdf, by whichever of both is exact."""
    return np.where(a * x < b, 1 - _f_cdf(x, a, b), beta_i(b / 2, a / 2, b / (a * x + b)))


def _f_pdf(x, a, b):
    y = a * x / (a * x + b)
    return _beta_pdf(a / 2, b / 2, y) * a * b / (a * x + b) ** 2


def _choose(n, k):
    return ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1)


def _discrete_inverse(cdf: Callable, p: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least whole number whose cumulated probability reaches p."""
    lo, hi = np.full(p.shape, -1.0), np.array(high, float)
    while (hi - lo > 1).any():
        mid = np.floor((lo + hi) / 2)
        reached = cdf(mid) >= p * (1 - 1e-14)
        lo, hi = np.where(~reached & (hi - lo > 1), mid, lo), np.where(reached & (hi - lo > 1), mid, hi)
    return hi


_INF = np.inf
_POSITIVE, _CHANCE, _ANY = (lambda x: x > 0), (lambda x: (x >= 0) & (x <= 1)), (lambda x: np.isfinite(x))
_AT_LEAST_0, _OPEN, _DEGREES = (lambda x: x >= 0), (lambda x: (x > 0) & (x < 1)), (lambda x: x >= 1)

#: name: (function of arrays, a test of each argument); a row that fails one has no value, as a sheet shows an error there.
KINDS: dict[str, tuple[Callable, tuple[Callable, ...]]] = {
    "NORM.DIST": (lambda x, m, s: _phi((x - m) / s), (_ANY, _ANY, _POSITIVE)),
    "NORM.PDF": (lambda x, m, s: np.exp(-((x - m) / s) ** 2 / 2) / (s * np.sqrt(2 * np.pi)), (_ANY, _ANY, _POSITIVE)),
    "NORM.INV": (lambda p, m, s: m + s * inverse(_phi, lambda z: np.exp(-z * z / 2) / np.sqrt(2 * np.pi), p, -_INF, _INF), (_OPEN, _ANY, _POSITIVE)),
    "LOGNORM.DIST": (lambda x, m, s: _phi((np.log(x) - m) / s), (_POSITIVE, _ANY, _POSITIVE)),
    "LOGNORM.INV": (lambda p, m, s: np.exp(m + s * inverse(_phi, lambda z: np.exp(-z * z / 2) / np.sqrt(2 * np.pi), p, -_INF, _INF)), (_OPEN, _ANY, _POSITIVE)),
    "GAMMA.DIST": (lambda x, a, b: gamma_p(a, x / b), (_AT_LEAST_0, _POSITIVE, _POSITIVE)),
    "GAMMA.PDF": (lambda x, a, b: _gamma_pdf(a, x, b), (_POSITIVE, _POSITIVE, _POSITIVE)),
    "GAMMA.INV": (lambda p, a, b: b * inverse(lambda x: gamma_p(a, x), lambda x: _gamma_pdf(a, x, 1.0), p, 0.0, _INF), (_OPEN, _POSITIVE, _POSITIVE)),
    "CHISQ.DIST": (lambda x, v: gamma_p(v / 2, x / 2), (_AT_LEAST_0, _DEGREES)),
    "CHISQ.DIST.RT": (lambda x, v: gamma_p(v / 2, x / 2, upper=True), (_AT_LEAST_0, _DEGREES)),
    "CHISQ.INV": (lambda p, v: inverse(lambda x: gamma_p(v / 2, x / 2), lambda x: _gamma_pdf(v / 2, x, 2.0), p, 0.0, _INF), (_OPEN, _DEGREES)),
    "CHISQ.INV.RT": (lambda p, v: inverse(lambda x: -gamma_p(v / 2, x / 2, upper=True), lambda x: _gamma_pdf(v / 2, x, 2.0), -p, 0.0, _INF), (_OPEN, _DEGREES)),
    "BETA.DIST": (lambda x, a, b: beta_i(a, b, x), (_CHANCE, _POSITIVE, _POSITIVE)),
    "BETA.PDF": (lambda x, a, b: _beta_pdf(a, b, x), (_OPEN, _POSITIVE, _POSITIVE)),
    "BETA.INV": (lambda p, a, b: inverse(lambda x: beta_i(a, b, x), lambda x: _beta_pdf(a, b, x), p, 0.0, 1.0), (_OPEN, _POSITIVE, _POSITIVE)),
    "T.DIST": (_t_cdf, (_ANY, _DEGREES)),
    "T.DIST.RT": (lambda x, v: _t_cdf(-x, v), (_ANY, _DEGREES)),
    "T.DIST.2T": (lambda x, v: 2 * _t_cdf(-x, v), (_AT_LEAST_0, _DEGREES)),
    "T.INV": (lambda p, v: inverse(lambda x: _t_cdf(x, v), lambda x: _t_pdf(x, v), p, -_INF, _INF), (_OPEN, _DEGREES)),
    "T.INV.2T": (lambda p, v: -inverse(lambda x: _t_cdf(x, v), lambda x: _t_pdf(x, v), p / 2, -_INF, 0.0), (_OPEN, _DEGREES)),
    "F.DIST": (_f_cdf, (_AT_LEAST_0, _DEGREES, _DEGREES)),
    "F.DIST.RT": (_f_tail, (_AT_LEAST_0, _DEGREES, _DEGREES)),
    "F.INV": (lambda p, a, b: inverse(lambda x: _f_cdf(x, a, b), lambda x: _f_pdf(x, a, b), p, 0.0, _INF), (_OPEN, _DEGREES, _DEGREES)),
    "F.INV.RT": (lambda p, a, b: inverse(lambda x: -_f_tail(x, a, b), lambda x: _f_pdf(x, a, b), -p, 0.0, _INF), (_OPEN, _DEGREES, _DEGREES)),
    "WEIBULL.DIST": (lambda x, a, b: -np.expm1(-((x / b) ** a)), (_AT_LEAST_0, _POSITIVE, _POSITIVE)),
    "WEIBULL.PDF": (lambda x, a, b: a / b * (x / b) ** (a - 1) * np.exp(-((x / b) ** a)), (_POSITIVE, _POSITIVE, _POSITIVE)),
    "EXPON.DIST": (lambda x, r: -np.expm1(-r * x), (_AT_LEAST_0, _POSITIVE)),
    "POISSON.DIST": (lambda k, m: gamma_p(np.floor(k) + 1, m, upper=True), (_AT_LEAST_0, _POSITIVE)),
    "POISSON.PMF": (lambda k, m: np.exp(np.floor(k) * np.log(m) - m - ln_gamma(np.floor(k) + 1)), (_AT_LEAST_0, _POSITIVE)),
    "BINOM.DIST": (lambda k, n, p: np.where(np.floor(k) >= np.floor(n), 1.0, beta_i(np.maximum(np.floor(n) - np.floor(k), 1e-9), np.floor(k) + 1, 1 - p)), (_AT_LEAST_0, _AT_LEAST_0, _CHANCE)),
    "BINOM.PMF": (lambda k, n, p: np.where(np.floor(k) > np.floor(n), 0.0, np.exp(_choose(np.floor(n), np.minimum(np.floor(k), np.floor(n))) + np.floor(k) * np.log(p) + np.maximum(np.floor(n) - np.floor(k), 0) * np.log1p(-p))), (_AT_LEAST_0, _AT_LEAST_0, _OPEN)),
    "BINOM.INV": (lambda n, p, a: _discrete_inverse(lambda k: KINDS["BINOM.DIST"][0](k, n, p), a, np.floor(n)), (_AT_LEAST_0, _OPEN, _OPEN)),
    "NEGBINOM.DIST": (lambda f, s, p: beta_i(np.floor(s), np.floor(f) + 1, p), (_AT_LEAST_0, _DEGREES, _OPEN)),
    "HYPGEOM.PMF": (lambda k, n, m, t: np.exp(_choose(m, k) + _choose(t - m, n - k) - _choose(t, n)), (_AT_LEAST_0, _AT_LEAST_0, _AT_LEAST_0, _POSITIVE)),
    "GAMMALN": (ln_gamma, (_POSITIVE,)),
    "ERF": (erf, (_ANY,)),
    "ERFC": (lambda x: np.where(x < 0, 1 + erf(-x), gamma_p(0.5, x * x, upper=True)), (_ANY,)),
    "CONFIDENCE.NORM": (lambda a, s, n: -KINDS["NORM.INV"][0](a / 2, 0.0, 1.0) * s / np.sqrt(np.floor(n)), (_OPEN, _POSITIVE, _DEGREES)),
    "CONFIDENCE.T": (lambda a, s, n: KINDS["T.INV.2T"][0](a, np.floor(n) - 1) * s / np.sqrt(np.floor(n)), (_OPEN, _POSITIVE, lambda n: n >= 2)),
}


def values(name: str, *arguments: np.ndarray) -> np.ndarray:
    """A function of `KINDS` over arrays; not a number where an argument is outside its range or not a number."""
    function, tests = KINDS[name]
    columns = [np.array(v, float) for v in np.broadcast_arrays(*arguments)]
    fine = np.ones(columns[0].shape, bool)
    for column, test in zip(columns, tests, strict=True):
        with np.errstate(invalid="ignore"):
            fine &= np.isfinite(column) & test(column)
    out = np.full(columns[0].shape, np.nan)
    if fine.any():
        with np.errstate(all="ignore"):
            out[fine] = function(*(c[fine] for c in columns))
    return out


def distribution(name: str, *arguments: Column | float) -> Column:
    """A distribution of the sheet by its name (cumulative; PDF and PMF name densities): null where an argument is null or outside its range."""
    if name not in KINDS:
        raise ValueError(f"unknown distribution: {name}")
    if len(arguments) != len(KINDS[name][1]):
        raise ValueError(f"{name} takes {len(KINDS[name][1])} arguments")

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        got = values(name, *(c.to_numpy(float, na_value=np.nan) for c in columns))
        return pd.Series(got).astype("Float64").mask(np.isnan(got))

    return run(*((a if isinstance(a, Column) else F.lit(float(a))).cast("double") for a in arguments))
