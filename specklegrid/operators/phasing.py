"""Iterative phasing: constraint projections on packed images, run in chunks of iterations inside one task each.

A row is one independent reconstruction (an image and a seed); rows run in parallel and never exchange anything, so
a whole chunk of iterations costs no shuffle. With P the projection onto measured amplitudes (phase kept, not measured
frequencies kept), S the support and b the feedback: ER: P in S, else 0. HIO: P in S, else x - b P. RAAR: P in S, else
(1 - 2b) P + b x. HPR: P where S holds and 2P - x is no less than (1 - b)|P|, else x - b P. DM: x + b (S((1 + g2) P - g2 x) -
P(x in S, else -g1 x)). CFLIP: weak densities change sign. ESPRESSO: P where it is far from x and positive, x where it is
near, less b P everywhere; its support becomes the far pixels. HIO_PROJ and RAAR_PROJ project onto a band of
amplitudes. `automatic` is HIO until the support has shrunk, then RAAR. Arrays are unshifted; amplitudes that are not
measured have mask 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schedules import bezier, gammas
from ..sources import frames
from .fourier import align_arrays, blur_array, rescaled

ALGORITHMS = ("er", "hio", "raar", "hpr", "dm", "cflip", "espresso", "haar", "hio_proj", "raar_proj", "automatic")
SUPPORTS = ("threshold", "area", "complex_area", "template", "filtered", "stepped", "real_error_capped", "real_error_adaptative", "static")
#: The real-space error that an adaptative support keeps, where none is given.
AUTO_ERROR = {"hio": 0.55, "raar": 0.20}


@dataclass(frozen=True)
class Settings:
    algorithm: str = "raar"
    beta: float = 0.9
    beta_map: tuple[tuple[float, float], ...] = ()
    gamma1: float | None = None  # difference map; None: from beta
    gamma2: float | None = None
    iterations: int = 100
    positive: bool = False
    real: bool = False
    sigma: float = 0.05  # weak share of densities for charge flipping
    weak: float = 0.0  # share of the reflections above which charge flipping turns none by a quarter
    tau: float = 0.05  # espresso
    noise: float = -1.0  # amplitudes' standard deviation as a share of them; 0: they are their own; below: no band
    central: bool = False  # raar: zero frequency without phase
    support_every: int = 0  # 0: the support stays
    support: str = "threshold"
    level: float = 0.2
    area: float = 0.1
    area_map: tuple[tuple[float, float], ...] = ()
    blur: float = 3.0
    blur_map: tuple[tuple[float, float], ...] = ()
    error: float = -1.0  # for error-driven supports
    template: float = 5.0  # blur of the initial support
    closure: int = 0  # radius of the closing after an update
    centre: bool = False  # the support's centre of mass goes to the origin's opposite
    averaging: int = 1  # images whose mean feeds the support update
    inner_er: int = 0  # error reduction of that mean
    filter: bool = False  # intensities are filtered through the support's autocorrelation
    phases_blur: float = 0.0
    phases_blur_map: tuple[tuple[float, float], ...] = ()
    image_blur_every: int = 0
    image_blur: float = 0.0
    halve_every: int = 0  # breaks centrosymmetry
    tolerance: float = -1.0
    log_every: int = 10
    fixed: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"no such algorithm: {self.algorithm}; there are {', '.join(ALGORITHMS)}")
        if self.support not in SUPPORTS:
            raise ValueError(f"no such support: {self.support}; there are {', '.join(SUPPORTS)}")

    def at(self, name: str, k: int) -> float:
        m = getattr(self, f"{name}_map")
        return bezier(k, [x for x, _ in m], [y for _, y in m]) if m else getattr(self, name)


# ---- projections


def modulus_projection(x: np.ndarray, amplitude: np.ndarray, mask: np.ndarray, width: np.ndarray | None = None, central: bool = False) -> np.ndarray:
    """The nearest image with the measured amplitudes, or with amplitudes no further than `width` from them."""
    f = np.fft.fftn(x)
    size = np.abs(f)
    target = amplitude if width is None else np.clip(size, np.maximum(amplitude - width, 0), amplitude + width)
    out = np.where(mask != 0, np.where(size > 0, f * (target / np.where(size > 0, size, 1)), target), f)
    if central:
        out[(0,) * x.ndim] = np.abs(out[(0,) * x.ndim])
    return np.fft.ifftn(out)


def weak_reflections(amplitude: np.ndarray, mask: np.ndarray, share: float) -> np.ndarray:
    """Measured amplitudes up to the one at place int(n share) from the top."""
    if share <= 0:
        return np.zeros(amplitude.shape, bool)
    level = np.sort(amplitude, axis=None)[::-1][min(int(amplitude.size * share), amplitude.size - 1)]
    return (mask != 0) & (amplitude <= level)


def band_width(amplitude: np.ndarray, o: Settings) -> np.ndarray | None:
    """Half the width of the band of amplitudes: the root of their deviation."""
    if o.noise < 0 and not o.algorithm.endswith("_proj"):
        return None
    return np.sqrt(noise_model(amplitude, max(o.noise, 0.0)))


def noise_model(amplitude: np.ndarray, share: float = 0.0, support: np.ndarray | None = None, given: np.ndarray | None = None) -> np.ndarray:
    """Deviations of the amplitudes: as given; what a known autocorrelation support leaves outside; a share of them; or themselves."""
    if given is not None:
        return given
    if support is not None:
        ac = np.fft.ifftn(amplitude**2 + 0j)
        inside = np.sqrt(np.abs(np.fft.fftn(np.where(support != 0, ac, 0))))
        return np.abs(amplitude - inside)
    return share * amplitude if share > 0 else amplitude.copy()


def folded(v: np.ndarray, s: np.ndarray, o: Settings) -> np.ndarray:
    """Real and positive inside the support, where asked for."""
    if o.real:
        v = np.where(s, v.real, v)
    if o.positive:
        v = np.where(s, np.abs(v.real) + 1j * np.abs(v.imag), v)
    return v


def step(x: np.ndarray, s: np.ndarray, amplitude: np.ndarray, mask: np.ndarray, o: Settings, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The next image and support; s is a boolean support."""
    b, algorithm = o.at("beta", k), o.algorithm
    if algorithm == "cflip":
        f = np.fft.fftn(x)
        size = np.abs(f)
        unit = np.where(size > 0, f / np.where(size > 0, size, 1), 1)
        p = np.fft.ifftn(np.where(mask != 0, np.where(weak_reflections(amplitude, mask, o.weak), 1j, 1) * unit * amplitude, f))
        p = p.real + 0j if o.real else p
        out = np.where(np.abs(p) < o.sigma * np.abs(p).max(), -p, p)
        return (np.abs(out.real) + 1j * np.abs(out.imag) if o.positive else out), s
    p = modulus_projection(x, amplitude, mask, band_width(amplitude, o), o.central and algorithm.startswith("raar"))
    p = folded(p, np.ones_like(s), replace(o, positive=False)) if algorithm in ("espresso", "er") else p
    if algorithm == "espresso":
        far = np.abs(p - x) > o.tau * np.abs(p).max()
        return folded(np.where(far & (p.real > 0), p, 0) + np.where(far, 0, x) - o.beta * p, far, o), far
    if algorithm == "dm":
        g1, g2 = (given if given is not None else auto for given, auto in zip((o.gamma1, o.gamma2), gammas(b), strict=True))
        back = modulus_projection(np.where(s, x, -g1 * x), amplitude, mask)
        return folded(x + b * (np.where(s, (1 + g2) * p - g2 * x, 0) - back), s, o), s
    if algorithm == "hio" and o.positive:  # clamped here, folded elsewhere
        inside = p.real + 0j if o.real else p
        inside = np.maximum(inside.real, 0) + 1j * np.maximum(inside.imag, 0)
    else:
        inside = folded(p, s, o)
    if algorithm == "er":
        return np.where(s, inside, 0), s
    if algorithm in ("hio", "hio_proj", "automatic"):
        return np.where(s, inside, x - b * p), s
    if algorithm in ("raar", "raar_proj", "haar"):
        return np.where(s, inside, (1 - 2 * b) * p + b * x), s
    back = ~s | (np.abs(2 * p - x) < (1 - b) * np.abs(p))
    return np.where(back, (x.real - b * p.real) + 0j if o.real else x - b * p, inside), s


def haugazeau(x0: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The projection of x0 onto the meet of two half-spaces."""
    pi, mu, nu = (float(np.vdot(a, b).real) for a, b in ((x0 - x, x - y), (x0 - x, x0 - x), (x - y, x - y)))
    rho = mu * nu - pi * pi
    if rho <= 1e-14 * max(mu * nu, 1e-300):
        return y if pi >= 0 else x0
    if pi * nu >= rho:
        return x0 + (1 + pi / nu) * (y - x)
    return x + nu / rho * (pi * (x0 - x) + mu * (y - x))


def smooth_phases(x: np.ndarray, sigma: float) -> np.ndarray:
    """Unit phases are blurred, moduli stay; a pixel without modulus stays 0."""
    size = np.abs(x)
    unit = blur_array(np.where(size > 0, x / np.where(size > 0, size, 1), 0), sigma)
    return size * np.exp(1j * np.angle(unit))


# ---- supports


def place_level(v: np.ndarray, share: float) -> float:
    """The value at place int(n share) from the top."""
    return float(np.sort(v, axis=None)[::-1][min(int(v.size * share), v.size - 1)])


def square_blur(v: np.ndarray, radius: float) -> np.ndarray:
    """Periodic mean over the square (or cube) of the whole radius around each pixel."""
    reach = int(radius)
    for k in range(v.ndim):
        v = sum(np.roll(v, d, k) for d in range(-min(reach, v.shape[k] // 2), min(reach, (v.shape[k] - 1) // 2) + 1)) / (min(reach, v.shape[k] // 2) + min(reach, (v.shape[k] - 1) // 2) + 1)
    return v


def filtered_support(x: np.ndarray, level: float, radius: float) -> np.ndarray:
    """Over a share of the largest modulus, or over the local mean by three local deviations."""
    a = np.abs(blur_array(x, radius))
    mean = np.abs(square_blur(a, radius))
    spread = np.abs(square_blur((a - mean) ** 2, radius))
    return (a > level * a.max()) | (a > mean + 3 * np.sqrt(spread))


def template_support(start: np.ndarray, radius: float, area: float) -> np.ndarray:
    """The initial support, blurred and cut at an area; the level is a share of the largest value, and so are the values."""
    t = blur_array((start != 0) + 0j, radius).real
    t = t / t.max() if t.max() > 0 else t
    return t > place_level(t, area)


def patterson_support(amplitude: np.ndarray, level: float, blur: float, area: float | None = None, square: bool = False) -> np.ndarray:
    """Where the blurred autocorrelation reaches a share of its largest value, or the one at an area; square: only within a quarter of the first axis."""
    a = np.abs(np.fft.fftn(amplitude**2))
    if area is not None:
        level = place_level(a, area) / a.max()
    a = np.abs(blur_array(a + 0j, blur))
    s = a >= level * a.max()
    if square:
        d = np.meshgrid(*[np.abs(np.fft.fftfreq(n) * n) for n in s.shape], indexing="ij")
        s &= np.sqrt(sum(k * k for k in d)) <= s.shape[-1] / 4
    return s


def closed(s: np.ndarray, radius: int) -> np.ndarray:
    """Grown and then shrunk by a ball, periodic."""
    d = np.meshgrid(*[np.arange(-radius, radius + 1) if n > 1 else np.zeros(1, int) for n in s.shape], indexing="ij")
    ball = [tuple(int(k.flat[i]) for k in d) for i in range(d[0].size) if sum(int(k.flat[i]) ** 2 for k in d) <= radius * radius]
    grown = np.logical_or.reduce([np.roll(s, t, range(s.ndim)) for t in ball])
    return np.logical_and.reduce([np.roll(grown, t, range(s.ndim)) for t in ball])


def centred(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both shifted so that the support's circular centre of mass stands in the middle."""
    shift = []
    for k, n in enumerate(s.shape):
        line = s.sum(tuple(j for j in range(s.ndim) if j != k))
        at = np.angle((line * np.exp(2j * np.pi * np.arange(n) / n)).sum()) * n / (2 * np.pi)
        shift.append(int(np.round(n // 2 - at)) % n)
    return np.roll(x, shift, range(s.ndim)), np.roll(s, shift, range(s.ndim))


def update_support(x: np.ndarray, o: Settings, k: int, memory: dict | None = None, start: np.ndarray | None = None, ereal: float = 0.0) -> np.ndarray | None:
    """The support of the blurred modulus; None ends the run. memory carries what stepped and adaptative supports remember."""
    memory = {} if memory is None else memory
    radius = o.at("blur", k)
    if o.support == "template":
        s = template_support(start if start is not None else np.ones(x.shape), o.template, o.at("area", k))
    elif o.support == "filtered":
        s = filtered_support(x, o.level, radius)
    else:
        a = np.abs(blur_array(x if o.support == "complex_area" else np.abs(x) + 0j, radius))
        level = o.level * a.max()
        if o.support in ("area", "complex_area"):
            level = place_level(a, o.at("area", k))
        elif o.support == "stepped":
            memory["stepped"] = memory.get("stepped") or (k > 40 and ereal > 0.3)
            level *= 0.75 if memory["stepped"] else 1
        elif o.support == "real_error_capped" and not ereal < o.error:
            return None
        elif o.support == "real_error_adaptative":
            if o.error < 0 and o.algorithm not in AUTO_ERROR:
                raise ValueError("this support needs an error, or hio or raar")
            target = o.error if o.error >= 0 else AUTO_ERROR[o.algorithm]
            size = memory.get("size") or int((a >= level).sum())
            memory["size"] = size = min(max(int(size * (1 - (target - ereal) / 10)), 1), a.size - 1)
            level = np.sort(a, axis=None)[::-1][size]
        s = a >= level
    return s | (o.fixed != 0) if o.fixed is not None else s


def filtered_amplitudes(x: np.ndarray, s: np.ndarray, amplitude: np.ndarray, mask: np.ndarray, blur: float = 3.0) -> np.ndarray:
    """Amplitudes whose autocorrelation fits the support's; those not measured are the image's."""
    intensity = np.where(mask != 0, amplitude**2, np.abs(np.fft.fftn(x)) ** 2)
    fs = np.fft.fftn(s + 0j)
    reach = np.fft.ifftn(np.abs(fs) ** 2).real >= 1 - 1e-9
    ac = np.fft.fftn(intensity) * blur_array(reach + 0j, blur)
    return np.sqrt(np.abs(np.fft.ifftn(ac)))


# ---- runs


def metrics(x: np.ndarray, s: np.ndarray, amplitude: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    f, power = np.abs(np.fft.fftn(x)), np.abs(x) ** 2
    m = mask != 0
    div = lambda p, q: float(p / q) if q else float("nan")
    return {"ereal": div(power[~s].sum(), power[s].sum()), "efourier": div(((f - amplitude)[m] ** 2).sum(), (amplitude[m] ** 2).sum()), "fcfo": div(f.sum(), amplitude.sum()), "sup_size": 100.0 * float(s.mean())}


def initial(amplitude: np.ndarray, seed: int, kind: str = "random phases", support: np.ndarray | None = None, given: np.ndarray | None = None) -> np.ndarray:
    """The first image; a given one is brought to the size and, like densities, to the energy of the amplitudes."""
    rng = np.random.default_rng(seed)
    if given is None and kind == "zero phases":
        return np.fft.ifftn(amplitude + 0j)
    if given is None and kind == "random phases":
        return np.fft.ifftn(amplitude * np.exp(2j * np.pi * rng.random(amplitude.shape)))
    if given is not None:
        x = given if given.shape == amplitude.shape else rescaled(given[None] + 0j, amplitude.shape[-1], amplitude.shape[-2])[0]
    elif kind in ("random density", "starting support"):
        x = rng.random(amplitude.shape) + 0j if kind == "random density" else (support + 0j)
    else:
        raise ValueError(f"no such start: {kind}")
    return x * parseval(x, amplitude)


def parseval(x: np.ndarray, amplitude: np.ndarray) -> float:
    """The factor that gives x the energy of the amplitudes."""
    return float(np.sqrt((amplitude**2).sum() / max((np.abs(np.fft.fftn(x)) ** 2).sum(), 1e-300)))


def on_grid(s: np.ndarray, shape: tuple[int, int], level: float = 0.1) -> np.ndarray:
    """A 2D support on another grid: bilinear, then over a level."""
    at = [np.arange(n) * ((m - 1) / (n - 1) if n > 1 else 0.0) for m, n in zip(s.shape, shape, strict=True)]
    lo = [np.minimum(a.astype(int), m - 1) for a, m in zip(at, s.shape, strict=True)]
    hi = [np.minimum(a + 1, m - 1) for a, m in zip(lo, s.shape, strict=True)]
    u, v = (a - b for a, b in zip(at, lo, strict=True))
    rows = lambda r: s[r][:, lo[1]] * (1 - v) + s[r][:, hi[1]] * v
    return rows(lo[0]) * (1 - u)[:, None] + rows(hi[0]) * u[:, None] > level


def initial_support(amplitude: np.ndarray, given: np.ndarray | None = None, fixed: np.ndarray | None = None, level: float = 0.04, area: float | None = None, blur: float = 0.0) -> np.ndarray:
    """The given support, brought to the amplitudes' grid, or one from their autocorrelation; united with a fixed mask."""
    if given is not None:
        s = given != 0 if given.shape == amplitude.shape else on_grid((given != 0).astype(float), amplitude.shape[-2:])
    else:
        s = patterson_support(amplitude, level, blur, area)
    return s | (fixed != 0) if fixed is not None else s


def chunk(x, s, amplitude, mask, o: Settings, first: int, count: int, memory: dict | None = None, start: np.ndarray | None = None):
    """(x, s, log rows) after `count` iterations from number `first`."""
    memory = {} if memory is None else memory
    log, x0, kept, used = [], x, [], amplitude
    for k in range(first, first + count):
        now = o
        if o.algorithm == "automatic":
            now = replace(o, algorithm="raar" if memory.get("shrunk") else "hio")
        if o.support_every and k and k % o.support_every == 0 and o.support != "static":
            mean = sum(kept) / len(kept) if kept else x
            for _ in range(o.inner_er):
                mean, _ = step(mean, s, used, mask, replace(o, algorithm="er"), k)
            new = update_support(mean, now, k, memory, start, metrics(x, s, used, mask)["ereal"])
            if new is None:
                break
            new = closed(new, o.closure) if o.closure else new
            memory["shrunk"] = memory.get("shrunk") or new.sum() < s.sum()
            s, kept = new, []
            if o.centre:
                x, s = centred(x, s)
            if o.filter:
                used = filtered_amplitudes(x, s, amplitude, mask)
        new, s = step(x, s, used, mask, now, k)
        if o.algorithm == "haar":
            new = haugazeau(x0, x, new)
        if (blur := o.at("phases_blur", k)) > 0:
            new = smooth_phases(new, blur)
        if o.image_blur_every and (k + 1) % o.image_blur_every == 0:
            new = blur_array(new, o.image_blur)
        if o.halve_every and (k + 1) % o.halve_every == 0:
            new = new * 0.5
        if o.averaging > 1:
            kept = [*kept, new][-o.averaging :]
        change, x = float(np.abs(np.abs(x) - np.abs(new)).sum()), new
        if (k + 1) % o.log_every == 0 or k + 1 == first + count:
            log.append({"iteration": k + 1, "beta": o.at("beta", k), "d_rho": change, **metrics(x, s, used, mask)})
            if log[-1]["ereal"] < o.tolerance:
                break
    return x, s, log


RUNS = "image_id long, seed int, nx int, ny int, nz int, amplitude array<double>, mask array<int>, re array<double>, im array<double>, support array<int>, iteration int, state string"
LOG = "image_id long, seed int, iteration int, beta double, d_rho double, ereal double, efourier double, fcfo double, sup_size double"
RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def start(amplitudes: DataFrame, support: DataFrame, seeds: int, kind: str = "random phases") -> DataFrame:
    """A row for each image and seed; amplitudes packed (re), support(image_id, support array<int>)."""
    rows = amplitudes.select("image_id", "nx", "ny", "nz", F.col("re").alias("amplitude"), "mask").join(support, "image_id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                shape = (r.nz, r.ny, r.nx)
                x = initial(np.asarray(r.amplitude).reshape(shape), int(r.image_id) * 1_000_003 + r.seed, kind, np.asarray(r.support).reshape(shape))
                out.append((r.image_id, r.seed, r.nx, r.ny, r.nz, r.amplitude, r.mask, x.real.ravel().copy(), x.imag.ravel().copy(), r.support, 0, "{}"))
            yield pd.DataFrame(out, columns=RUN_NAMES)

    return rows.select("image_id", "seed", "nx", "ny", "nz", "amplitude", "mask", "support").mapInPandas(run, RUNS)


def _each(runs: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Rows of f(row, image, support, amplitude, mask) for each run."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                shape = (r.nz, r.ny, r.nx)
                at = lambda v, shape=shape: np.asarray(v).reshape(shape)
                out += f(r, at(r.re) + 1j * at(r.im), at(r.support) != 0, at(r.amplitude), at(r.mask))
            yield pd.DataFrame(out, columns=names)

    return runs.mapInPandas(run, schema)


def advance(runs: DataFrame, o: Settings, iterations: int | None = None, logs: bool = False) -> DataFrame:
    """runs, `iterations` further; or with logs their metric rows instead. What supports remember goes on in state."""
    import json

    names, count = [c.split()[0] for c in LOG.split(", ")], iterations or o.iterations

    def go(r, x, s, amplitude, mask):
        memory = json.loads(r.state or "{}")
        template = np.asarray(memory.pop("start")).reshape(s.shape) if "start" in memory else s
        x, s, log = chunk(x, s, amplitude, mask, o, r.iteration, count, memory, template)
        if logs:
            return [(r.image_id, r.seed, *[row[n] for n in names[2:]]) for row in log]
        memory = {k: (bool(v) if k != "size" else int(v)) for k, v in memory.items()}
        if o.support == "template":
            memory["start"] = template.astype(int).ravel().tolist()
        return [(r.image_id, r.seed, r.nx, r.ny, r.nz, r.amplitude, r.mask, x.real.ravel().copy(), x.imag.ravel().copy(), s.astype(np.int32).ravel(), r.iteration + count, json.dumps(memory))]

    return _each(runs, go, LOG if logs else RUNS)


def phase(runs: DataFrame, o: Settings, snapshot_every: int, path: str) -> DataFrame:
    """Runs in chunks; each chunk's state is appended to the table of iterations at path and read again, so lineage stays short. A path that holds iterations already goes on from the last whole one; none is written twice."""
    spark = runs.sparkSession
    there = [i for i in frames.iterations(spark, path) if i <= o.iterations]
    read = lambda i: frames.read_iterations(spark, path, i).select(*RUN_NAMES)
    done, runs = (there[-1], read(there[-1])) if there else (0, runs)
    while done < o.iterations:
        n = min(snapshot_every, o.iterations - done)
        done += n
        frames.append_iteration(advance(runs, o, n), path, done)
        runs = read(done)
    return runs


def phase_with_updates(runs: DataFrame, options, updates: Callable[[], DataFrame], snapshot_every: int, path: str) -> DataFrame:
    """phase(), reading updates(seq, option, value, from_iteration) again before each chunk: those that are due and weren't looked at yet change its settings or are refused (functions.updates), which path/audit records. A restart goes on from the last whole chunk with what was taken before it."""
    from ..functions.options import changed
    from ..functions.updates import AUDIT, audited
    from ..sources.text import parse_value

    spark, log = runs.sparkSession, f"{path}/audit"
    last = (frames.iterations(spark, f"{path}/runs") or [0])[-1]
    done = 0
    while done < from_options(options).iterations:
        if done not in frames.iterations(spark, log):
            known = [r["seq"] for i in frames.iterations(spark, log) for r in frames.read_iterations(spark, log, i).select("seq").collect()]
            due = updates().where((F.coalesce("from_iteration", F.lit(0)) <= done) & ~F.col("seq").isin(known or [-1])).withColumn("run", F.lit(0))
            now = spark.createDataFrame([(0, done)], "run int, start long")
            frames.append_iteration(audited(due, now).withColumn("at", F.lit(done).cast("long")).select(*AUDIT).coalesce(1), log, done)
        for r in sorted(frames.read_iterations(spark, log, done).where("taken").collect(), key=lambda r: (r["from_iteration"], r["seq"])):
            options = changed(options, {r["option"]: parse_value(r["value"])})
        o = from_options(options)
        n = min(snapshot_every, o.iterations - done)
        done += n
        if done > last:
            frames.append_iteration(advance(runs, o, n), f"{path}/runs", done)
        runs = frames.read_iterations(spark, f"{path}/runs", done).select(*RUN_NAMES)
    return runs


def output(runs: DataFrame, project: bool = True) -> DataFrame:
    """image_id, seed, re, im of what a run gives out: its image on the measured amplitudes, or as it is."""

    def go(r, x, s, amplitude, mask):
        v = modulus_projection(x, amplitude, mask) if project else x
        return [(r.image_id, r.seed, v.real.ravel().copy(), v.imag.ravel().copy())]

    return _each(runs, go, "image_id long, seed int, re array<double>, im array<double>")


def snapshots(runs: DataFrame) -> DataFrame:
    """What a snapshot shows of each run: image, support and the modulus of the transform, as packed arrays."""

    def go(r, x, s, amplitude, mask):
        return [(r.image_id, r.seed, r.iteration, x.real.ravel().copy(), x.imag.ravel().copy(), s.astype(np.int32).ravel(), np.abs(np.fft.fftn(x)).ravel())]

    return _each(runs, go, "image_id long, seed int, iteration int, re array<double>, im array<double>, support array<int>, fourier array<double>")


def remove_modes(runs: DataFrame, level: float = 0.2, iterations: int = 500) -> DataFrame:
    """Runs whose amplitudes, where not measured, come from error reduction within the support of a share of the largest modulus: then all are measured."""

    def go(r, x, s, amplitude, mask):
        s = np.abs(x) >= level * np.abs(x).max()
        v, _, _ = chunk(x, s, amplitude, mask, Settings(algorithm="er"), 0, iterations)
        full = np.where(mask != 0, amplitude, np.abs(np.fft.fftn(v)))
        return [(r.image_id, r.seed, r.nx, r.ny, r.nz, full.ravel(), np.ones(full.size, np.int32), v.real.ravel().copy(), v.imag.ravel().copy(), s.astype(np.int32).ravel(), r.iteration, r.state)]

    return _each(runs, go, RUNS)


def restore_amplitudes(amplitude: np.ndarray, mask: np.ndarray, s: np.ndarray, iterations: int = 200) -> np.ndarray:
    """Amplitudes of a pattern of known (zero) phase with the masked ones filled in, by error reduction."""
    x = np.fft.ifftn(np.where(mask != 0, amplitude, 0) + 0j)
    for _ in range(iterations):
        f = np.fft.fftn(np.where(s, x, 0))
        x = np.fft.ifftn(np.where(mask != 0, amplitude, np.abs(f)))
    return np.where(mask != 0, amplitude, np.abs(np.fft.fftn(np.where(s, x, 0))))


def aligned_average(runs: DataFrame) -> DataFrame:
    """image_id, n, re, im: the mean over an image's runs, each aligned to the first seed's. One group holds the runs of one image."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seed")
        shape = (pdf.nz.iloc[0], pdf.ny.iloc[0], pdf.nx.iloc[0])
        all_ = [(np.asarray(a) + 1j * np.asarray(b)).reshape(shape) for a, b in zip(pdf.re, pdf.im, strict=True)]
        mean = sum(align_arrays(all_[0], v) for v in all_) / len(all_)
        return pd.DataFrame([(pdf.image_id.iloc[0], len(all_), mean.real.ravel().copy(), mean.imag.ravel().copy())], columns=["image_id", "n", "re", "im"])

    return runs.select("image_id", "seed", "nx", "ny", "nz", "re", "im").groupBy("image_id").applyInPandas(go, "image_id long, n long, re array<double>, im array<double>")


def with_algorithm(o: Settings, name: str) -> Settings:
    return replace(o, algorithm=name)


def from_options(options) -> Settings:
    """The settings that validated options (functions.options) stand for."""
    v = options.values
    method, update = (lambda k: v[f"phasing_method.{k}"]), (lambda k: v[f"support_update_method.{k}"])
    names = {"diff_map": "dm"}
    kinds = {"constant_area": "area", "complex_decreasing_area": "complex_area", "template_area": "template"}
    kind = update("support_update_algorithm")
    if method("algorithm") == "so2d":
        raise ValueError("the saddle-point algorithm isn't built")
    plain = {"phasing_method.enforce_centrosymmetry": False, "phasing_method.enforce_ramp": False, "phasing_method.adapt_thres": False, "support_update_method.square_mask": 0.0}
    if missing := [k for k, none in plain.items() if v[k] != none]:
        raise ValueError(f"{', '.join(missing)}: not built")
    auto = lambda x: None if x == -10000 else x
    return Settings(
        algorithm=names.get(method("algorithm"), method("algorithm")), beta_map=method("beta"), beta=method("beta")[0][1], gamma1=auto(method("gamma1")), gamma2=auto(method("gamma2")), positive=method("enforce_positivity"), real=method("enforce_real"),
        sigma=method("charge_flip_sigma"), weak=method("perturb_weak_reflections"), tau=method("espresso_tau"), central=method("remove_central_pixel_phase"), phases_blur_map=method("phases_blur"), image_blur_every=method("image_blur_period"),
        image_blur=method("image_blur_radius"), tolerance=method("real_error_tolerance"), iterations=v["max_iterations"] or 100, support_every=update("innerloop_iterations"), support=kinds.get(kind, kind), level=update("support_intensity_threshold"),
        area_map=update("template_area" if kind == "template_area" else "object_area"), blur_map=update("blur"), error=update("support_real_error_threshold"), template=update("template_blur_radius"), closure=update("support_closure_radius"),
        centre=update("center_image"), averaging=update("support_image_averaging"), inner_er=update("error_reduction_iterations_in_support_update"), filter=update("filter_intensities"), log_every=v["logging.log_output_period"],
    )
