"""Vector arithmetic on arrays, and the density of von Mises-Fisher distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def scale(a: Column, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(doubles(a), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def equal(a: Column, b: Column) -> Column:
    """Whether all elements are equal."""
    return doubles(a) == doubles(b)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """At unit length; null for a zero vector."""
    return scale(a, 1 / F.nullif(norm(a), F.lit(0.0)))


def distance(a: Column, b: Column) -> Column:
    """Squared distance of unit vectors, rounding errors below 0 folded up."""
    return F.abs(signed_distance(a, b))


def signed_distance(a: Column, b: Column) -> Column:
    return 2 - 2 * dot(a, b)


def log_bessel_bound(kappa: Column, a: Column, b: Column) -> Column:
    """The integral that bounds the normalising constant."""
    u = F.sqrt(kappa * kappa + b * b)
    return u - b - F.when(a == 0, F.lit(0.0)).otherwise(a * F.ln((a + u) / (a + b)))


def vmf_log_constant(kappa: Column, dimension: Column) -> Column:
    """Approximate ln of the normalising constant for a concentration."""
    nu = dimension.cast("double") / 2 - 1
    half = nu + 0.5
    beta = F.sqrt(half * half)
    low = F.least(kappa, F.sqrt((3 * nu + 5.5) * (nu + 1.5)))
    return log_bessel_bound(kappa, half, beta) + log_bessel_bound(low, nu, nu + 2) - log_bessel_bound(low, half, beta)


def log_constant(kappa: np.ndarray, dimension: int) -> np.ndarray:
    """As vmf_log_constant(), of numpy arrays."""
    nu = dimension / 2 - 1
    half = nu + 0.5

    def bound(k: np.ndarray, a: float, b: float) -> np.ndarray:
        u = np.sqrt(k * k + b * b)
        return u - b - (a * np.log((a + u) / (a + b)) if a else 0.0)

    low = np.minimum(kappa, np.sqrt((3 * nu + 5.5) * (nu + 1.5)))
    return bound(kappa, half, abs(half)) + bound(low, nu, nu + 2) - bound(low, half, abs(half))


def vmf_log_density(alpha: Column, log_constant: Column, kappa: Column, cosine: Column) -> Column:
    return F.ln(alpha) + log_constant + kappa * cosine
