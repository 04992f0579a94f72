"""Language identification by hierarchical discrimination.

A one-versus-rest linear support vector machine predicts the language family first; within the family,
one-versus-one linear support vector machines separate its languages by votes. Features are hashed byte n-grams
(one to three bytes, A-Z lower-cased) of the whole text, square-rooted and normalised.

The machines learn from every labelled row that isn't held out, each distinct (doc_id, text) once. Rows are dealt by a hash of these into
blocks of some BLOCK_ROWS rows; a block fits all machines on its rows, and a machine is the mean of its blocks' machines, each
weighted by the rows of its rarer side there (mixture of averages). Blocks follow rows and bytes, so tasks stay the same at any size,
and neither the order nor the partitions of the rows matter. Only weights come to the driver. With `per_lang`, machines learn from a
bounded sample instead: that many rows of each language at most. Prediction covers every row in one scan without a shuffle.

Cases: a null text or one without a letter is `und` with score 0; without any labelled row everything is `und`;
a language that `families` doesn't list is a family of its own; a row without doc_id is never learned from and
counts as not held out; repeated rows are predicted alike; an empty table gives no rows. lang, source and doc_id
are no inputs of a prediction, and other columns come along only where asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selection import selected
from .exchange import released, written
from .kernels import LOWER, pieces, utf8

DIMS, PER_LANG, MIN_SCORE, LOST = 4096, 400, 0.25, 0.005
PIECE, ROWS = 512 << 10, 512  # bytes of text and rows whose features (16 KB a row) a task holds at once
SAMPLE_ROWS, MIN_ROWS = 40_000, 8  # bounds of a sample of per_lang rows: fewer of each where all would pass the first, but the second of each
BLOCK_ROWS, BLOCK_BYTES, ROUNDS = 2000, 4 << 20, 15
#: Families of common languages (ISO 639-1).
FAMILIES = {
    **dict.fromkeys("en de nl af sv da no nb nn is fy lb yi".split(), "germanic"), **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk sl hr sr bs mk bg".split(), "slavic"), **dict.fromkeys("hi bn ur pa gu mr ne si".split(), "indic"),
    **dict.fromkeys("fi et hu".split(), "uralic"), **dict.fromkeys("tr az kk uz tk".split(), "turkic"), **dict.fromkeys("ar he mt am".split(), "semitic"),
}
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


def features(text: pa.Array, dims: int = DIMS) -> np.ndarray:
    """One row of features for each text, float32."""
    data, offsets = utf8(text)
    low = LOWER[data].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, dims), np.float32)
    codes = [low * np.uint32(2654435761) >> np.uint32(20)]
    if len(low) > 1:
        codes.append((low[:-1] * np.uint32(65599) + low[1:] * np.uint32(31) + np.uint32(7)) * np.uint32(2654435761) >> np.uint32(20))
    if len(low) > 2:
        codes.append((low[:-2] * np.uint32(16777619) + low[1:-1] * np.uint32(65599) + low[2:] * np.uint32(131) + np.uint32(11)) * np.uint32(2246822519) >> np.uint32(20))
    codes = [(c % np.uint32(dims)).astype(np.int32) for c in codes]
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for k, c in enumerate(codes):
            if b - k > a:
                out[i] += np.bincount(c[a : b - k], minlength=dims)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svms(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int = DIMS, c: float = 4.0, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last row is the biases) of L2-regularised squared-hinge machines, one for each column of y: +1, -1 or 0 (not learned from), by dual coordinate descent over sparse rows (places, values)."""
    a, w, norm = np.zeros(y.shape), np.zeros((dims + 1, y.shape[1]), np.float32), np.array([float(v @ v) for _, v in rows]) + 1 + 0.5 / c
    rng, used = np.random.default_rng(7), y != 0
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            margin = y[i] * (v @ w[at] + w[-1]) - 1 + a[i] * (0.5 / c)
            step = np.where(used[i], np.maximum(a[i] - margin / norm[i], 0.0) - a[i], 0.0)
            if step.any():
                a[i] += step
                change = (step * y[i]).astype(np.float32)
                w[at] += v[:, None] * change
                w[-1] += change
    return w


def sparse(x: np.ndarray) -> bytes:
    """A row of features as its places and values."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def places_and_values(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, np.uint16, n).astype(np.int32), np.frombuffer(data, np.float32, n, 2 * n)


class Model:
    """Machines for the families, and for each pair of languages of one family."""

    def __init__(self, langs: list[str], families: dict[str, str], weights: dict[str, np.ndarray]):
        self.langs = sorted(langs)
        family = {g: families.get(g, g) for g in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [g for g in self.langs if family[g] == f] for f in self.families}
        self.top = [weights[f"family {f}"] for f in self.families] if len(self.families) > 1 else []
        self.pairs = {(g, h): weights[f"pair {g} {h}"] for group in self.members.values() for i, g in enumerate(group) for h in group[i + 1 :]}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score from 0 to 1 of each row: the share of its family times its mean vote in the family."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        squash = lambda m: 1 / (1 + np.exp(-4.0 * m))
        p = squash(np.stack([x @ w for w in self.top], 1)) if self.top else np.ones((len(x), 1))
        p /= p.sum(1, keepdims=True)
        best, lang, score = p.argmax(1), np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.families):
            at, group = np.flatnonzero(best == i), self.members[f]
            votes = np.ones((len(at), len(group))) if len(group) == 1 else np.zeros((len(at), len(group)))
            for a, g in enumerate(group):
                for b in range(a + 1, len(group)):
                    v = squash(x[at] @ self.pairs[g, group[b]])
                    votes[:, a] += v / (len(group) - 1)
                    votes[:, b] += (1 - v) / (len(group) - 1)
            win = votes.argmax(1) if len(at) else np.zeros(0, int)
            lang[at] = np.array(group, object)[win]
            score[at] = p[at, i] * votes[np.arange(len(at)), win]
        return lang, np.clip(score, 0, 1)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    """(lang, h, text) of the rows that machines may learn from; h stands for doc_id and text."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.lit("language id"), "doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[DataFrame, list[str]]:
    """(lang, h, text) of the rows that machines learn from, and the languages: of each language the distinct (doc_id, text) of least hash, rows that are held out aside."""
    rows = labelled(docs)
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()  # one row a language
    langs = sorted(r["lang"] for r in found)
    per_lang = min(per_lang, max(MIN_ROWS, SAMPLE_ROWS // max(1, len(langs))))
    # below a bar of twice the share that is wanted; the least of each language always
    bars = docs.sparkSession.createDataFrame([(r["lang"], r["least"], min(1.0, 2 * per_lang / r["n"])) for r in found], "g string, least long, share double")
    drawn = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("share")
    some = rows.join(F.broadcast(bars), F.col("lang") == F.col("g")).where(drawn | (F.col("h") == F.col("least")))
    each = some.groupBy("lang", "h").agg(F.min("text").alias("text"))  # equal rows become one where they lie
    place = F.row_number().over(Window.partitionBy("lang").orderBy((F.col("h") != F.col("least")).cast("int"), F.pmod("h", F.lit(1 << 30)), "h"))
    least = docs.sparkSession.createDataFrame([(r["lang"], r["least"]) for r in found], "g string, least long")
    each = each.join(F.broadcast(least), F.col("lang") == F.col("g")).withColumn("place", place).where(F.col("place") <= per_lang)
    return each.select("lang", "h", "place", "text"), langs


def machines(langs: list[str], families: dict[str, str]) -> dict[str, dict[str, int]]:
    """The side (+1 or -1) of each language that a machine learns from: of each family against the rest, and of each pair of languages of a family."""
    family = {g: families.get(g, g) for g in langs}
    names = sorted(set(family.values()))
    out = {f"family {f}": {g: 1 if family[g] == f else -1 for g in langs} for f in names} if len(names) > 1 else {}
    for f in names:
        group = sorted(g for g in langs if family[g] == f)
        out |= {f"pair {g} {h}": {g: 1, h: -1} for i, g in enumerate(group) for h in group[i + 1 :]}
    return out


_LEARNED = "fold int, machine string, part int, share double, w binary"
_FOLD = "pmod(xxhash64(h, 'fold'), 2)"


def _fitted(rows: DataFrame, blocks: int, langs: list[str], families: dict[str, str], dims: int, folds: bool) -> dict[int, dict[str, np.ndarray]]:
    """Weights by machine, learned from all rows(lang, h, text) (2), and with folds from those of fold 1 (0) and of fold 0 (1): to judge fold 0 and 1 by."""
    jobs = machines(langs, families)
    if not jobs:
        return {2: {}, 0: {}, 1: {}}
    sides = {g: np.array([side.get(g, 0) for side in jobs.values()], np.int8) for g in langs}
    names = list(jobs)

    def learn(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("h", "ascending")])
        vectors = [places_and_values(sparse(x)) for part in pieces(rows, "text", PIECE, ROWS) for x in features(part["text"], dims)]
        y, fold, out = np.stack([sides[g] for g in rows["lang"].to_pylist()]), rows["fold"].to_numpy(), []
        for kind in (2, 0, 1) if folds else (2,):
            use = np.flatnonzero(fold != kind)
            some = np.flatnonzero((y[use] > 0).any(0) | np.array([n.startswith("pair ") for n in names]) & (y[use] != 0).any(0))
            if not len(some):
                continue
            mine = y[np.ix_(use, some)].astype(float)
            w = fit_svms([vectors[i] for i in use], mine, dims)
            share = np.minimum((mine > 0).sum(0), (mine < 0).sum(0)) + 1e-6  # a block that has one side only counts where no other does
            out += [(kind, names[j], key[0].as_py() % 64, float(share[k]), w[:, k].astype(np.float32).tobytes()) for k, j in enumerate(some)]
        return _rows(out)

    def _rows(out: list) -> pa.Table:
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.binary()))], names=[c.split()[0] for c in _LEARNED.split(", ")])

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows, [("share", "ascending"), ("w", "ascending")]))  # in one order whatever the partitions
        share, total = rows["share"].to_numpy(), np.zeros(dims + 1)
        for k, w in zip(share, rows["w"], strict=True):
            total += k * np.frombuffer(w.as_buffer(), np.float32)
        return _rows([(rows["fold"][0].as_py(), rows["machine"][0].as_py(), rows["part"][0].as_py(), float(share.sum()), (total / share.sum()).astype(np.float32).tobytes())])

    dealt = rows.select(F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), "*").repartition(blocks, "block")
    each = dealt.groupBy("block", "lang", "h").agg(F.min("text").alias("text")).withColumn("fold", F.expr(_FOLD).cast("int"))  # equal rows become one where they lie
    learned = each.groupBy("block").applyInArrow(learn, _LEARNED)
    found = learned.groupBy("fold", "machine", "part").applyInArrow(mean, _LEARNED).groupBy("fold", "machine").applyInArrow(mean, _LEARNED).collect()
    return {kind: {r["machine"]: np.frombuffer(bytes(r["w"]), np.float32) for r in found if r["fold"] == kind} for kind in (2, 0, 1)}


def _learned_limit(rows: DataFrame, models: dict[int, Model], dims: int, share: float = LOST) -> float:
    """The score that all but `share` of the rightly predicted learned rows reach when the machines learn on the other fold of the rows; of all rows."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE, ROWS):
                truth, fold, x = np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy(), features(part.column(2), dims)
                for k, model in models.items():
                    lang, score = model.predict(x[fold == k])
                    yield pa.record_batch([pa.array(score[lang == truth[fold == k]], pa.float64())], ["score"])

    scores = written(rows.select("lang", F.expr(_FOLD).cast("int").alias("fold"), "text").mapInArrow(run, "score double"), "scores")
    found = selected(scores.select(F.lit("all").alias("part"), "score"), "part", "score", lambda n: F.floor((n - 1) * F.lit(share))).collect()
    released(scores)
    return float(found[0]["level"]) if found else 0.0


def fit(docs: DataFrame, per_lang: int | None = None, families: dict[str, str] | None = None, dims: int = DIMS, limit: bool = False) -> Model | None:
    """The model of all rows that are not held out (or with per_lang, of a sample of them), with its learned limit where asked for; None where no row has a label."""
    rows, families = labelled(docs) if per_lang is None else sample(docs, per_lang)[0].select("lang", "h", "text"), FAMILIES if families is None else families
    found = rows.groupBy("lang", F.expr(_FOLD).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # two rows a language
    if not found:
        return None
    langs = sorted({r["lang"] for r in found})
    blocks = max(1, -(-sum(r["n"] for r in found) // BLOCK_ROWS), -(-sum(r["bytes"] for r in found) // BLOCK_BYTES))
    weights = _fitted(rows, blocks, langs, families, dims, limit)
    model = Model(langs, families, weights[2])
    model.limit = MIN_SCORE
    if limit:
        known = {k: sorted({r["lang"] for r in found if r["fold"] != k}) for k in (0, 1)}
        model.limit = _learned_limit(rows, {k: Model(g, families, weights[k]) for k, g in known.items() if g}, dims)
    return model


def identify(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = (), dims: int = DIMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs(doc_id, text), and the columns of `carry` in a struct `rest`."""
    rest = F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"), rest)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE, ROWS):
                data, offsets = utf8(part.column(1))
                near = np.r_[0, np.cumsum(_IS_LETTER[data])]
                has = near[offsets[1:]] > near[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = bool(_LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                lang, score = np.full(len(has), "und", object), np.zeros(len(has))
                if model and has.any():
                    lang, score = model.predict(features(part.column(1), dims))
                    lang[~has], score[~has] = "und", 0.0
                yield pa.record_batch([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score), part.column(3)], ["doc_id", "held_out", "lang_pred", "score", "rest"])

    kind = rows.schema["rest"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rest {kind}")
    return found if carry else found.drop("rest")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
