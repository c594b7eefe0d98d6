"""Small numeric Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def as_col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def safe_div(num, den, floor: float = TINY) -> Column:
    """num / max(den, floor); null where `den` is unknown."""
    den = as_col(den)
    return F.when(den.isNotNull(), as_col(num) / F.greatest(den, F.lit(floor)))


def clip(x, lo=None, hi=None) -> Column:
    x = as_col(x)
    if lo is not None:
        x = F.when(x.isNotNull(), F.greatest(x, as_col(lo)))
    if hi is not None:
        x = F.when(x.isNotNull(), F.least(x, as_col(hi)))
    return x


def round_step(x, step) -> Column:
    """Nearest multiple of `step`, halves to even."""
    return F.bround(as_col(x) / as_col(step), 0) * as_col(step)


def neutral(x, value: float) -> Column:
    """Replace null, NaN and infinities by a neutral value."""
    x = as_col(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(value)).otherwise(x)


def pnl_currency(side, entry, exit_, volume, point=0.01, tick_value=0.01) -> Column:
    """(exit - entry) in points, signed by side, times tick value and volume."""
    move = F.when(as_col(side) == "buy", as_col(exit_) - as_col(entry)).otherwise(as_col(entry) - as_col(exit_))
    return move / F.greatest(as_col(point), F.lit(TINY)) * as_col(tick_value) * as_col(volume)


def fill_price(side, price, spread, point=0.01, slippage=0.0, spread_model=1.0) -> Column:
    """Entry fill: half the modelled spread plus slippage against the trader."""
    cost = as_col(spread) * point * spread_model * 0.5 + slippage * point
    return F.when(as_col(side) == "buy", as_col(price) + cost).otherwise(as_col(price) - cost)


def target_at(values, index) -> Column:
    """Element of a list parameter (0-based); beyond its end the last element."""
    values = as_col(values)
    return F.coalesce(F.try_element_at(values, (as_col(index) + 1).cast("int")), F.element_at(values, -1))


def mix(*parts, seed: int = 42) -> Column:
    """Reproducible pseudo-random integer in [0, 2147483647) from integer parts.

    Plain 64-bit arithmetic modulo a prime, so any SQL engine can reproduce the draw.
    """
    p = 2147483647
    x = F.lit(seed).cast("long")
    for part in parts:
        x = (x * 48271 + as_col(part).cast("long")) % p
        x = (x * x + 12345) % p
        x = (x * 69621 + as_col(part).cast("long")) % p
        x = (x * x + x) % p
    return x


def mix_values(*parts, seed: int = 42) -> np.ndarray:
    """``mix`` of arrays or numbers, none of them negative, for use inside tasks."""
    p = np.uint64(2147483647)
    mod = lambda a: a - a // p * p
    parts = np.broadcast_arrays(*[np.asarray(part) for part in parts])
    out = np.empty(parts[0].shape, np.int64)
    for i in range(0, len(out), 1 << 13):  # stays in the cache
        x = np.uint64(seed)
        for part in parts:
            part = part[i : i + (1 << 13)].astype(np.uint64)
            x = mod(x * np.uint64(48271) + part)
            x = mod(x * x + np.uint64(12345))
            x = mod(x * np.uint64(69621) + part)
            x = mod(x * x + x)
        out[i : i + (1 << 13)] = x
    return out


# Coefficients of Acklam's published rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_TAIL = 0.02425
EULER_GAMMA = 0.5772156649015329


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p) -> Column:
    """Inverse of the standard normal distribution function, as a pure Column expression."""
    p = as_col(p).cast("double")

    def tail(prob: Column) -> Column:
        q = F.sqrt(-2.0 * F.log(prob))
        return _horner(ACKLAM_C, q) / (_horner(ACKLAM_D, q) * q + 1.0)

    q = p - 0.5
    r = q * q
    middle = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1.0)
    return (
        F.when(p <= 0, F.lit(float("-inf")))
        .when(p >= 1, F.lit(float("inf")))
        .when(p < ACKLAM_TAIL, tail(p))
        .when(p > 1 - ACKLAM_TAIL, -tail(1 - p))
        .otherwise(middle)
    )


# Published coefficients of a rational approximation of the error function (three ranges of |x|).
ERF_NEAR_A = (1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03)
ERF_NEAR_B = (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERF_MID_C = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
    2.05107837782607147e03, 1.23033935479799725e03,
)
ERF_MID_D = (
    1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03,
    1.23033935480374942e03,
)
ERF_FAR_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERF_FAR_Q = (1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
ERF_NEAR, ERF_MID = 0.46875, 4.0


def erfc(x) -> Column:
    """Complementary error function as a pure Column expression, to about 15 digits."""
    x = as_col(x).cast("double")
    a = F.abs(x)
    y = x * x
    near = 1.0 - x * (_horner(ERF_NEAR_A, y) / _horner(ERF_NEAR_B, y))
    z = 1.0 / y
    far = (1 / math.sqrt(math.pi) - z * (_horner(ERF_FAR_P, z) / _horner(ERF_FAR_Q, z))) / a
    tail = F.exp(-y) * F.when(a <= ERF_MID, _horner(ERF_MID_C, a) / _horner(ERF_MID_D, a)).otherwise(far)
    return F.when(F.isnan(x), F.lit(float("nan"))).when(a <= ERF_NEAR, near).when(a > 30, F.when(x > 0, 0.0).otherwise(2.0)).when(x < 0, 2.0 - tail).otherwise(tail)


def norm_cdf(x) -> Column:
    """Standard normal distribution function."""
    return 0.5 * erfc(-as_col(x).cast("double") / math.sqrt(2.0))


def two_sided_p(r, n) -> Column:
    """Two-sided p-value of a correlation `r` over `n` rows (t statistic, normal tail); null below three rows."""
    r, n = as_col(r).cast("double"), as_col(n).cast("double")
    t = r * F.sqrt((n - 2) / F.when(F.abs(r) < 1, 1 - r * r))
    return F.when(F.isnan(r) | (n < 3), None).when(F.abs(r) >= 1, 0.0).otherwise(erfc(F.abs(t) / math.sqrt(2.0)))


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson correlation, null where a side is constant (the built-in raises on that in ANSI mode).

    Only rows where both are known count; `over` makes it a window function.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    win = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(win(F.covar_pop(a, b)), win(F.stddev_pop(a)) * win(F.stddev_pop(b)))
