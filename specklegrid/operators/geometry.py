"""Geometry solving: Levenberg-Marquardt over small systems of control points, many systems in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

VARIABLES = ("dx", "dy", "zoom", "alpha", "theta")


def to_global(p: dict[str, float], x: float, y: float) -> tuple[float, float]:
    u, v = x * math.cos(p["theta"]) - y * math.sin(p["theta"]), x * math.sin(p["theta"]) + y * math.cos(p["theta"])
    w = 1 + u * math.sin(p["alpha"]) / 1024
    return u * math.cos(p["alpha"]) / w / p["zoom"] + p["dx"], v / w / p["zoom"] + p["dy"]


def residuals(frames: dict, points: list, fits: dict) -> np.ndarray:
    """Distances of points (constraint, kind, frame, x, y) to their radial line (an angle) or centred circle (a radius)."""
    out = []
    for c, kind, frame, x, y in points:
        gx, gy = to_global(frames[frame], x, y)
        out.append(-gx * math.sin(fits[c]) + gy * math.cos(fits[c]) if kind == "line" else math.hypot(gx, gy) - fits[c])
    return np.array(out)


def minimise(f, x: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Levenberg-Marquardt with central differences."""
    lam, r = 1e-3, f(x)
    for _ in range(rounds):
        j = np.stack([(f(x + h) - f(x - h)) / 2e-4 for h in np.eye(len(x)) * 1e-4], 1)
        a, g = j.T @ j, j.T @ r
        move = np.linalg.lstsq(a + lam * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        new = f(x + move)
        if new @ new < r @ r:
            gain = r @ r - new @ new
            x, r, lam = x + move, new, lam / 3
            if gain < tolerance * 1e-4:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return x


def solve(frames: dict, points: list, variables: list[tuple]) -> tuple[dict, dict, float]:
    """First the constraints' angles and radii alone, then with them the free variables (frame, name); frames, fits, rms."""
    if len(points) < len(variables) + len({p[0] for p in points}):
        raise ValueError("fewer control points than variables and constraints")
    names = sorted({p[0] for p in points})
    first = {}
    for c, kind, frame, x, y in points:
        gx, gy = to_global(frames[frame], x, y)
        first.setdefault(c, math.atan2(gy, gx) if kind == "line" else math.hypot(gx, gy))
    fit = minimise(lambda v: residuals(frames, points, dict(zip(names, v, strict=True))), np.array([first[c] for c in names]))

    def place(v):
        out = {k: dict(p) for k, p in frames.items()}
        for (frame, name), value in zip(variables, v, strict=True):
            out[frame][name] = max(value, 0.01) if name == "zoom" else value
        return out

    n = len(names)
    both = lambda v: residuals(place(v[n:]), points, dict(zip(names, v[:n], strict=True)))
    v = minimise(both, np.r_[fit, [frames[a][b] for a, b in variables]])
    r = both(v)
    return place(v[n:]), dict(zip(names, v[:n], strict=True)), float(np.sqrt((r * r).mean()))


def solve_systems(rows: DataFrame) -> DataFrame:
    """rows(system, kind 'frame'|'point'|'variable', frame, constraint, shape, x, y, dx, dy, zoom, alpha, theta, name): one solution for each system and frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, p, v = (pdf[pdf.kind == k] for k in ("frame", "point", "variable"))
        frames = {r.frame: {n: getattr(r, n) for n in VARIABLES} for r in f.itertuples()}
        got, _, rms = solve(frames, [(r.constraint, r.shape, r.frame, r.x, r.y) for r in p.itertuples()], [(r.frame, r.name) for r in v.itertuples()])
        return pd.DataFrame([(pdf.system.iloc[0], k, *[q[n] for n in VARIABLES], rms) for k, q in got.items()], columns=["system", "frame", *VARIABLES, "rms"])

    return rows.groupBy("system").applyInPandas(run, "system long, frame long, dx double, dy double, zoom double, alpha double, theta double, rms double")
