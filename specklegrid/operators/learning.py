"""Statistical learning over sparse photon counts and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import checkpointed

FLOOR = -50.0


def responsibilities(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """samples(sample_id, idx, n), reference(rot, idx, logp): softmax over rotations of sum n logp; log p under FLOOR counts as FLOOR. Equi-join on idx, two group-bys with partial sums."""
    score = samples.join(reference, "idx").groupBy("sample_id", "rot").agg(F.sum(F.col("n") * F.greatest("logp", F.lit(FLOOR))).alias("s"))
    most = score.groupBy("sample_id").agg(F.max("s").alias("most"))
    e = score.join(most, "sample_id").withColumn("e", F.exp(F.col("s") - F.col("most")))
    return e.join(e.groupBy("sample_id").agg(F.sum("e").alias("z")), "sample_id").select("sample_id", "rot", (F.col("e") / F.col("z")).alias("p"))


def maximise(samples: DataFrame, p: DataFrame, back: DataFrame) -> DataFrame:
    """back(rot, idx, pixel): the new model, the weighted mean count of each pixel."""
    n = p.select("sample_id").distinct().agg(F.count("*").alias("n_samples"))
    weighed = samples.join(p, "sample_id").join(back, ["rot", "idx"]).groupBy("pixel").agg(F.sum(F.col("n") * F.col("p")).alias("w"))
    return weighed.crossJoin(F.broadcast(n)).select("pixel", (F.col("w") / F.col("n_samples")).alias("mean"))  # one row


def quarter_turns(idx: Column, side: int) -> list[Column]:
    """The place of a pixel of a square image after 0 to 3 quarter turns."""
    out = [idx]
    for _ in range(3):
        i = out[-1]
        out.append(((side - 1 - F.floor(i / side)) + side * (i % side)).cast("int"))
    return out


def compress(samples: DataFrame, side: int | None = None) -> DataFrame:
    """Samples with equal counts become one class: a key (pixels in order, with counts) and the number of samples. A sample's pixels are few, so the key is bounded. side: samples that are quarter turns of each other are equal; the key is the least of the four."""
    turns = quarter_turns(F.col("idx"), side) if side else [F.col("idx")]
    rows = samples.select("sample_id", "n", F.posexplode(F.array(*turns)).alias("turn", "at"))
    key = rows.groupBy("sample_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "n"))).cast("array<string>"), ";").alias("key"))
    least = key.groupBy("sample_id").agg(F.min("key").alias("key"))
    return least.groupBy("key").agg(F.count("*").alias("weight"), F.min("sample_id").alias("first"))


def turned_references(model: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Of model(pixel, mean): reference(rot, idx, logp) in the four quarter turns, and back(rot, idx, pixel) from each to the model's pixel."""
    total = model.agg(F.sum("mean").alias("total"))
    p = model.crossJoin(F.broadcast(total)).withColumn("logp", F.when(F.col("mean") > 0, F.log(F.col("mean") / F.col("total"))).otherwise(FLOOR))  # one row
    both = p.select("pixel", "logp", F.posexplode(F.array(*quarter_turns(F.col("pixel"), side))).alias("rot", "idx"))
    return both.select("rot", "idx", "logp"), both.select("rot", "idx", "pixel")


def emc(samples: DataFrame, model: DataFrame, side: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(model, responsibilities) after rounds of expectation and maximisation over the four quarter turns. Each round's model, a row a pixel, is kept by checkpoint."""
    everywhere = model.select("pixel")
    for _ in range(rounds):
        reference, back = turned_references(model, side)
        p = responsibilities(samples, reference)
        mean = maximise(samples, p, back)
        model = everywhere.join(mean, "pixel", "left").select("pixel", F.coalesce("mean", F.lit(0.0)).alias("mean"))
        model = checkpointed(model)
    return model, responsibilities(samples, turned_references(model, side)[0])


def best_rotation(z: DataFrame) -> DataFrame:
    """z(image_id, rot, r): the rotation of the highest correlation, the least one on ties."""
    return z.groupBy("image_id").agg(F.max_by("rot", F.struct("r", -F.col("rot"))).alias("rot"), F.max("r").alias("r"))


class _Components:
    """Candid covariance-free components after the vectors so far."""

    def __init__(self, components: int, amnesia: float):
        self.most, self.amnesia, self.n, self.mean, self.vs = components, amnesia, 0, None, []

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        n, vs = self.n, self.vs
        self.mean = x.copy() if self.mean is None else self.mean + (x - self.mean) / n
        u = x - self.mean
        for k in range(min(self.most, n - 1)):
            if k == len(vs):
                vs.append(u.copy())
                break
            size = np.linalg.norm(vs[k]) or 1.0
            a = min(self.amnesia, n - 2) if n > 2 else 0
            vs[k] = (n - 1 - a) / n * vs[k] + (1 + a) / n * u * float(u @ vs[k]) / size
            d = vs[k] / (np.linalg.norm(vs[k]) or 1.0)
            u = u - float(u @ d) * d


def incremental_pca(frames: DataFrame, by: str, order: str, vector: str, components: int = 2, amnesia: float = 2.0) -> DataFrame:
    """Candid covariance-free incremental PCA of each stream in its order: by, component, value, direction. Streams are sorted within partitions and read batch by batch."""
    import pyarrow as pa

    kind = frames.schema[by].dataType.simpleString()

    def run(batches):
        key, state, out = object(), None, []
        rows = lambda k, c: [(k, i, float(np.linalg.norm(v)), (v / (np.linalg.norm(v) or 1.0)).tolist()) for i, v in enumerate(c.vs)]
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    out += rows(key, state) if state else []
                    key, state = k, _Components(components, amnesia)
                state.add(np.asarray(x, float))
        out += rows(key, state) if state else []
        if key_type is not None:
            yield pa.record_batch([pa.array([r[0] for r in out], key_type), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.float64()), pa.array([r[3] for r in out], pa.list_(pa.float64()))], [by, "component", "value", "direction"])

    return frames.select(by, order, vector).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, f"{by} {kind}, component int, value double, direction array<double>")


def gtm_step(vectors: DataFrame, centres: np.ndarray, beta: float) -> DataFrame:
    """E and M sums of a generative topographic map: for each latent point k the weight and the weighted vector sum. centres (points x dims) is a bounded model."""
    dims = centres.shape[1]

    def run(frames):
        w, v = np.zeros(len(centres)), np.zeros_like(centres)
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                d = ((x[:, None] - centres[None]) ** 2).sum(2)
                r = np.exp(-beta / 2 * (d - d.min(1, keepdims=True)))
                r /= r.sum(1, keepdims=True)
                w += r.sum(0)
                v += r.T @ x
        yield pd.DataFrame({"k": range(len(centres)), "w": w, "v": list(v)})

    part = vectors.select("v").mapInPandas(run, "k int, w double, v array<double>")
    return part.groupBy("k").agg(F.sum("w").alias("w"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dims)])


def radial_basis(points: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    """Gaussian basis functions and a constant, a row for each latent point."""
    d = ((points[:, None] - centres[None]) ** 2).sum(2)
    return np.hstack([np.exp(-d / (2 * width * width)), np.ones((len(points), 1))])


def gtm_fit(vectors: DataFrame, basis: np.ndarray, rounds: int = 20, penalty: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float, list[float]]:
    """(centres, beta, log likelihoods) of a generative topographic map of vectors(v) over the latent points whose basis (points x functions) is given.

    Each round is one pass: tasks sum responsibilities and weighted vectors by latent point, and only these sums, points x
    dims of the bounded model, meet on the driver, which solves for the weights by regularised normal equations.
    """
    points, functions = basis.shape
    first = vectors.select("v").agg(F.count("*").alias("n"), F.first("v").alias("v")).first()
    n, dims = first["n"], len(first["v"])
    mean = np.array(vectors.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dims)]).first(), float)
    spread = float(np.mean(vectors.agg(*[F.var_pop(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]).first()))
    weights = np.random.default_rng(seed).normal(size=(functions, dims)) * np.sqrt(spread) * 0.5
    weights[-1] = mean
    beta, history = 1.0 / max(spread, 1e-12), []
    for _ in range(rounds):
        g, rx, gap, fit = topographic_sums(vectors, basis @ weights, beta)
        weights = np.linalg.solve(basis.T @ (basis * g[:, None]) + penalty / beta * np.eye(functions), basis.T @ rx)
        history.append(fit)
        beta = n * dims / max(gap, 1e-12)
    return basis @ weights, beta, history


def topographic_sums(vectors: DataFrame, centres: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One pass over vectors(v): by latent point the responsibilities and the weighted vectors, summed; the weighted squared distances; the log likelihood. Tasks give these sums of the bounded model, no vectors."""
    points, dims = centres.shape

    def run(frames):
        w, v, gap, fit = np.zeros(points), np.zeros((points, dims)), 0.0, 0.0
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                d = ((x[:, None] - centres[None]) ** 2).sum(2)
                least = d.min(1, keepdims=True)
                e = np.exp(-beta / 2 * (d - least))
                total = e.sum(1, keepdims=True)
                r = e / total
                w, v = w + r.sum(0), v + r.T @ x
                gap += float((r * d).sum())
                fit += float((np.log(total / points) - beta / 2 * least + dims / 2 * np.log(beta / (2 * np.pi))).sum())
        yield pd.DataFrame({"k": range(points), "w": w, "v": list(v), "gap": gap / points, "fit": fit / points})

    part = vectors.select("v").mapInPandas(run, "k int, w double, v array<double>, gap double, fit double")
    sums = part.groupBy("k").agg(F.sum("w").alias("w"), F.sum("gap").alias("gap"), F.sum("fit").alias("fit"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(dims)]).orderBy("k").collect()
    return np.array([r["w"] for r in sums]), np.array([[r[f"v{i}"] for i in range(dims)] for r in sums]), sum(r["gap"] for r in sums), sum(r["fit"] for r in sums)


def branches(empty: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last that holds vectors, last with the empty ones after it) of the runs into which empty latent points cut a chain."""
    held = np.flatnonzero(~empty)
    if not len(held):
        return []
    starts = [0, *[int(k) for k in held[1:] if empty[k - 1]]]
    ends = [*[s - 1 for s in starts[1:]], len(empty) - 1]
    return [(s, int(max(held[(held >= s) & (held <= e)])), e) for s, e in zip(starts, ends, strict=True)]


def rearranged(empty: np.ndarray, means: np.ndarray, near: float = 0.99, seed: int = 0) -> np.ndarray:
    """A new order of the latent points: from the longest branch on, the branch whose end is most like an end of the chain (a random one of those within `near` of the best) joins it there, turned round if need be. means: what each point's own vectors are like."""
    rng, rest = np.random.default_rng(seed), branches(empty)
    if len(rest) < 2:
        return np.arange(len(empty))
    first = max(rest, key=lambda b: b[2] - b[0])
    rest.remove(first)
    chain, head, tail = list(range(first[0], first[2] + 1)), first[0], first[1]
    like = lambda a, b: float(np.nan_to_num(np.corrcoef(means[a], means[b])[0, 1], nan=-1.0))
    while rest:
        options = [(like(end, other), b, end == b[0], at_head) for b in rest for end in (b[0], b[1]) for other, at_head in ((head, True), (tail, False))]
        best = max(o[0] for o in options)
        chosen = [o for o in options if o[0] >= (near * best if best > 0 else best)]
        _, b, by_start, at_head = chosen[rng.integers(len(chosen))]
        run = list(range(b[0], b[2] + 1))
        far = b[1] if by_start else b[0]
        if at_head:
            chain, head = (run[::-1] if by_start else run) + chain, far
        else:
            chain, tail = chain + (run if by_start else run[::-1]), far
        rest.remove(b)
    return np.array(chain)


def own_means(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of the vectors that are nearest to each centre; a centre without any keeps its own place."""

    def run(frames):
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                k = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                yield pd.DataFrame([(int(j), int((k == j).sum()), x[k == j].sum(0).tolist()) for j in np.unique(k)], columns=["k", "n", "v"])

    part = vectors.select("v").mapInPandas(run, "k int, n long, v array<double>")
    out = centres.copy()
    for r in part.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(centres.shape[1])]).collect():  # one row a latent point
        out[r["k"]] = [r[f"v{i}"] / r["n"] for i in range(centres.shape[1])]
    return out


def gtm_screened(vectors: DataFrame, basis: np.ndarray, weights: np.ndarray, trials: int = 10, updates: int = 3, cycles: int = 4, turns_from: int = 1, quiet: int = 4, below: float = -np.inf, stretch: bool = False, seed: int = 0) -> tuple[np.ndarray, float, list[tuple[int, int, float]]]:
    """(centres, beta, (trial, empty points, log likelihood) of each cycle): a map along a chain of latent points, begun anew while points stay empty.

    A trial has `updates` estimates of the precisions of weights and of noise by their evidence, each after `cycles` of
    expectation and maximisation. It ends the search if the last `quiet` cycles had no empty point; else, from trial `turns_from` on, the
    branches between empty points are put in a new order and the weights follow. below: deviations under the mean that
    make a point empty as well. stretch: the empty points don't go along with their branches, but all points are spread over those that hold vectors.
    """
    n, dims, functions = vectors.count(), weights.shape[1], basis.shape[1]
    spread = float(np.mean(vectors.agg(*[F.var_pop(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]).first()))
    alpha, beta, history = 1e-3, 1.0 / max(spread, 1e-12), []
    ridge = np.diag([1.0] * (functions - 1) + [0.0])  # the constant goes free
    empty = np.zeros(len(basis), bool)
    for trial in range(trials):
        for _ in range(updates):
            for _ in range(cycles):
                g, rx, gap, fit = topographic_sums(vectors, basis @ weights, beta)
                empty = empty_points(g, below=below)
                history.append((trial, int(empty.sum()), fit))
                normal = basis.T @ (basis * g[:, None])
                weights = np.linalg.pinv(normal + alpha / beta * ridge) @ (basis.T @ rx)
            known = np.linalg.eigvalsh(normal) * beta
            settled = dims * float((known / (known + alpha)).sum())
            alpha, beta = settled / max(float((weights**2).sum()), 1e-300), (n * dims - settled) / max(gap, 1e-300)
            if alpha <= 0 or beta <= 0:
                raise ValueError("the evidence gives no precision: there are too few vectors for this basis")
        if all(h[1] == 0 for h in history[-quiet:]):
            break
        if trial >= turns_from and empty.any():
            centres = basis @ weights
            order = rearranged(empty, own_means(vectors, centres), seed=seed + trial)
            centres = centres[order]
            if stretch and not empty.all():
                held = centres[~empty[order]]
                at = np.linspace(0, len(held) - 1, len(centres))
                centres = np.stack([np.interp(at, np.arange(len(held)), held[:, i]) for i in range(dims)], 1)
            weights = np.linalg.pinv(basis) @ centres
    return basis @ weights, beta, history


def empty_points(weights: np.ndarray, least: float = 2.0, below: float = -1.0) -> np.ndarray:
    """Latent points that hold fewer than `least` vectors, or fewer than the mean by over one deviation."""
    spread = weights.std()
    return (weights < least) | ((weights - weights.mean()) / (spread if spread else 1.0) < below)
