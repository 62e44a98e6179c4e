"""Rating arithmetic: as column expressions, and as numpy for folds."""

from __future__ import annotations

import json
from math import erf, exp, factorial, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RATING

_PIECE, _PIECES, _DEGREE = 0.25, 25, 13


def _erf_table() -> list[list[float]]:
    """Taylor coefficients of erf (highest power first) around the middle of each piece of its positive side, from Hermite polynomials."""
    out = []
    for k in range(_PIECES):
        m = (k + 0.5) * _PIECE
        hermite, c = [1.0, 2 * m], [erf(m)]
        for n in range(1, _DEGREE + 1):
            c.append(2 / sqrt(pi) * (-1) ** (n - 1) * hermite[n - 1] * exp(-m * m) / factorial(n))
            hermite.append(2 * m * hermite[n] - 2 * n * hermite[n - 1])
        out.append(c[::-1])
    return out


_ERF_TABLE = json.dumps(_erf_table())


def erf_column(x: Column) -> Column:
    """The error function to double precision from built-in expressions: a polynomial for each quarter unit up to 6.25, then 1."""
    table = F.from_json(F.lit(_ERF_TABLE), "array<array<double>>")  # folded into one constant

    def value(v: Column) -> Column:
        at = F.least(F.floor(F.abs(v) / _PIECE), F.lit(_PIECES - 1)).cast("int")
        near = F.aggregate(F.get(table, at), F.lit(0.0), lambda acc, c: acc * (F.abs(v) - (at + 0.5) * _PIECE) + c)
        return F.signum(v) * F.when(F.abs(v) >= _PIECE * _PIECES, 1.0).otherwise(near)

    return F.element_at(F.transform(F.array(x), value), 1)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to double precision; null and NaN give null."""
    return 0.5 * (1.0 + erf_column(F.when(~F.isnan(x), x) / F.lit(sqrt(2.0))))


def normal_pdf(x: Column) -> Column:
    return F.exp(-(x * x) / 2.0) / F.lit(sqrt(2.0 * pi))


def clamp_sigma(sigma: Column) -> Column:
    return F.greatest(sigma, F.lit(RATING.epsilon))


def win_argument(mu_a: Column, sigma_a: Column, mu_b: Column, sigma_b: Column) -> Column:
    """What normal_cdf turns into the probability that the first wins."""
    spread = F.sqrt(F.lit(2 * RATING.performance**2) + clamp_sigma(sigma_a) * clamp_sigma(sigma_a) + clamp_sigma(sigma_b) * clamp_sigma(sigma_b))
    return F.lit(RATING.steepness) * (mu_a - mu_b) / F.greatest(spread, F.lit(RATING.epsilon))


def expected_win(mu_a: Column, sigma_a: Column, mu_b: Column, sigma_b: Column) -> Column:
    return normal_cdf(win_argument(mu_a, sigma_a, mu_b, sigma_b))


def public_score(mu: Column, sigma: Column) -> Column:
    """The probability of winning against a fresh rating."""
    return expected_win(mu, sigma, F.lit(RATING.mean), F.lit(RATING.deviation))


def conservative(mu: Column, sigma: Column) -> Column:
    return mu - 3.0 * sigma


def with_noise(sigma: Column) -> Column:
    return F.sqrt(clamp_sigma(sigma) * clamp_sigma(sigma) + F.lit(RATING.dynamics**2))


def update(w: tuple[float, float], lo: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """New (mean, deviation) of winner and loser: the mean moves by variance / c * v, the variance shrinks by variance / c^2 * v * (v + t)."""
    vw, vl = (max(s, RATING.epsilon) ** 2 + RATING.dynamics**2 for s in (w[1], lo[1]))
    c2 = 2 * RATING.performance**2 + vw + vl
    c = sqrt(max(c2, RATING.epsilon))
    t = (w[0] - lo[0]) / c
    v = exp(-t * t / 2) / sqrt(2 * pi) / (0.5 * (1 + erf(t / sqrt(2))))
    shrink = v * (v + t)
    return (w[0] + vw / c * v, sqrt(vw * max(1 - vw / c2 * shrink, RATING.epsilon))), (lo[0] - vl / c * v, sqrt(vl * max(1 - vl / c2 * shrink, RATING.epsilon)))


def update_columns(mu_w: Column, sigma_w: Column, mu_l: Column, sigma_l: Column) -> dict[str, Column]:
    """One comparison as columns: new_mu_w, new_sigma_w, new_mu_l, new_sigma_l."""
    nw, nl = with_noise(sigma_w), with_noise(sigma_l)
    c2 = F.lit(2 * RATING.performance**2) + nw * nw + nl * nl
    c = F.sqrt(F.greatest(c2, F.lit(RATING.epsilon)))
    t = (mu_w - mu_l) / c
    v = normal_pdf(t) / normal_cdf(t)
    shrink = v * (v + t)

    def deviation(n: Column) -> Column:
        return F.sqrt(n * n * F.greatest(1 - n * n / c2 * shrink, F.lit(RATING.epsilon)))

    return {"new_mu_w": mu_w + nw * nw / c * v, "new_sigma_w": deviation(nw), "new_mu_l": mu_l - nl * nl / c * v, "new_sigma_l": deviation(nl)}
