"""Statistics as Column expressions: log-odds, polarity, chi-squared tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: smoothing of the class counts ------------------------------
ALPHA = 0.01

# --- fixed values: Chebyshev fit of erfc, relative error below 1.2e-7 ---------
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for a in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = a + t * poly
    return t * F.exp(-x * x + poly)


def chi2_survival(chi2: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return erfc(F.sqrt(chi2 / 2.0))


def log_odds(c_pos: Column, c_neg: Column, n_pos: Column, n_neg: Column, size: Column,
             alpha: float = ALPHA) -> Column:
    """ln of the smoothed share in class 1 over the smoothed share in class 0."""
    p1 = (c_pos + alpha) / (n_pos + alpha * size)
    p0 = (c_neg + alpha) / (n_neg + alpha * size)
    return F.log(p1 / p0)


def z_score(logodds: Column, c_pos: Column, c_neg: Column, alpha: float = ALPHA) -> Column:
    return logodds / F.sqrt(1.0 / (c_pos + alpha) + 1.0 / (c_neg + alpha))


def signed_unit(total: Column, alpha: float) -> Column:
    """Map a sum of valences into (-1, 1)."""
    return total / F.sqrt(total * total + alpha)
