"""Schedules of a parameter over iterations, as plain functions and as Columns."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bezier(x: float, keys: list[float], values: list[float]) -> float:
    """A map's value: clamped at its ends; between keys a cubic Bezier with horizontal tangents, control points at a half of the way."""
    if x <= keys[0]:
        return values[0]
    if x >= keys[-1]:
        return values[-1]
    k = bisect.bisect_right(keys, x)
    u = (x - keys[k - 1]) / (keys[k] - keys[k - 1])
    lo, hi = 0.0, 1.0  # x(t) = 1.5 t (1 - t)**2 + 1.5 t**2 (1 - t) + t**3 rises
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if 1.5 * t * (1 - t) + t**3 < u else (lo, t)
    s = 3 * lo * lo - 2 * lo**3
    return values[k - 1] + s * (values[k] - values[k - 1])


def between(x: float, keys: list[float], values: list[float]) -> float:
    """A checkpoint's value, or between two a smooth shift: a Fermi function of ten widths, half-way in the middle. Clamped at the ends."""
    order = sorted(zip(keys, values, strict=True))
    low, high = [v for v in order if v[0] <= x], [v for v in order if v[0] >= x]
    if not low or not high:
        return (high[0] if high else low[-1])[1]
    (a, u), (b, v) = low[-1], high[0]
    return u if a == b else v + (u - v) / (math.exp(10 * ((x - a) / (b - a) - 0.5)) + 1)


def beta_at(x: float, beta: float, keys_map=None, checkpoints=None, over: float = 0.0) -> float:
    """The feedback at an iteration: a map before checkpoints before a rise from 0.75 within about `over` iterations before the constant."""
    if keys_map:
        return bezier(x, *map(list, zip(*keys_map, strict=True)))
    if checkpoints:
        return between(x, *map(list, zip(*checkpoints, strict=True)))
    return 0.75 + (beta - 0.75) * (1 - math.exp(-((x / over) ** 3))) if over else beta


def area_at(x: float, first: float, last: float = 0.0, over: float = 0.0, keys_map=None, checkpoints=None) -> float:
    """The object's area at an iteration: a map before checkpoints before a Gaussian decay over `over` iterations (three deviations) before the constant."""
    if keys_map:
        return bezier(x, *map(list, zip(*keys_map, strict=True)))
    if checkpoints:
        return between(x, *map(list, zip(*checkpoints, strict=True)))
    return (first - last) * math.exp(-((3.0 * x / over) ** 2) / 2) + last if over else first


def _stretch(x: Column, keys: Column, values: Column, within) -> Column:
    """Clamped at the ends; between two keys what within(share of the way, value before, value after) gives."""
    n = F.size(F.filter(keys, lambda k: k <= x))
    before, after = F.get(keys, n - 1), F.get(keys, n)
    inside = within((x - before) / (after - before), F.get(values, n - 1), F.get(values, n))
    return F.when(n == 0, F.get(values, F.lit(0))).when(n >= F.size(keys), F.get(values, F.size(keys) - 1)).otherwise(inside)


def mapped(x: Column, keys: Column, values: Column) -> Column:
    """bezier() as a Column of arrays of rising keys and of values: the cubic t**3 - 1.5 t**2 + 1.5 t = u has the one root 0.5 + sinh(asinh(4 u - 2) / 3)."""

    def within(u, low, high):
        t = 0.5 + F.sinh(F.asinh(4 * u - 2) / 3)
        return low + (3 * t * t - 2 * t * t * t) * (high - low)

    return _stretch(x, keys, values, within)


def shifted(x: Column, keys: Column, values: Column) -> Column:
    """between() as a Column of arrays of rising keys and of values."""
    return _stretch(x, keys, values, lambda u, low, high: high + (low - high) / (F.exp(10 * (u - 0.5)) + 1))


def linear(x: Column, lower_key: Column, upper_key: Column, lower: Column, upper: Column) -> Column:
    return lower + (upper - lower) * (x - lower_key) / F.nullif(upper_key - lower_key, F.lit(0.0))


def fermi(x: Column, at: float, kt: float, low: float, high: float) -> Column:
    """From high to low around `at`."""
    return low + (high - low) / (F.exp((x - at) / kt) + 1)


def dynamic_beta(x: Column, start: float, over: float) -> Column:
    """start + (1 - start) (1 - exp(-(x / over)**3))."""
    return start + (1 - start) * (1 - F.exp(-F.pow(x / over, F.lit(3.0))))


def decay(x: Column, most: float, least: float, over: float, method: str = "gaussian") -> Column:
    """Blur radius: a Gaussian decay, or a geometric one, from most to least."""
    if method == "gaussian":
        return (most - least) * F.exp(-(x * x) / (over * over)) + least
    return F.greatest(most * F.pow(F.lit(least / most), x / over), F.lit(least))


def linear_area(x: Column, first: float, last: float, over: float) -> Column:
    return first + (last - first) * F.least(x / over, F.lit(1.0))


def gammas(beta: float, sigma: float = 0.1) -> tuple[float, float]:
    """The difference map's two parameters that are best for noise of sigma."""
    s = min(sigma, 0.5)
    return -(4 + (2 + beta) * s + beta * s * s) / (beta * (4 - s + s * s)), (3 - beta) / (2 * beta)


def sphere_form_factor(q: Column, radius: float) -> Column:
    s = 2 * math.pi * q * radius
    return F.when(s == 0, 0.0).otherwise((F.sin(s) / (s * s) - F.cos(s) / s) * 4 * math.pi * radius**3 / s)
