"""Each stage of the pipeline against plain Python on the rows that it gets, with nulls, repeated doc_ids, ties and an empty table."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from specklegrid.llm import language_id, sentence_pieces, source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"en": "the of and thing wh", "de": "der und sch keit ein", "fr": "les eau que ment oi", "es": "los que cion ado ez"}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    say = lambda g, n: " ".join("".join(rng.choice(STEMS[g].split(), 3)) for _ in range(n))
    out = [(i, say(g, int(rng.integers(20, 80))), g, f"s{i % 5 if i % 3 else 0}") for i in range(240) for g in [list(STEMS)[i % 4]]]
    base = {g: say(g, 120) for g in STEMS}
    for k, g in enumerate(STEMS):
        words = base[g].split()
        out += [(300 + 10 * k + j, " ".join(words[:j] + ["x"] * (j > 0) + words[j + 1 :]), g, "s0") for j in range(6)]
        passage = say(g, 55)
        out += [(400 + 10 * k + j, f"{say(g, 20)}\n{passage}  {say(g, 15)}", g, None) for j in range(3)]
    out += [(3, out[4][1], "en", "s9"), (3, "les oi que ment", "fr", "s9"), (3, "les oi que ment", "fr", "s9"), (None, out[7][1], None, "s1"), (None, out[7][1], None, "s1"), (600, None, "en", "s1"), (601, "", None, None), (602, "12 !?", "en", "s2")]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in out]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """The rows before the first stage and after each."""
    top, docs = tmp_path_factory.mktemp("stages"), spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, "")
        docs.write.parquet(str(top / str(k)))
        docs = spark.read.parquet(str(top / str(k)))
        out.append(docs)
    return out


def _plain(df):
    return [tuple(r[c] for c in C.COLUMNS) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(sorted(d.columns) == sorted(C.COLUMNS) for d in stages[:-1])


def test_language_stage(stages):
    """The family first, by the machine with the largest margin; then the language that wins most votes of its pairs."""
    before, after = _plain(stages[0]), Counter(_plain(stages[1]))
    model = language_id.fit(stages[0], limit=True)
    squash = lambda v: 1 / (1 + np.exp(-4.0 * v))
    want = Counter()
    for i, text, _, source, n in before:
        if not text or not re.search(r"[^\W\d_]", text):
            continue
        import pyarrow as pa

        x = np.r_[language_id.features(pa.array([text]))[0], 1.0]
        margins = [float(x @ w) for w in model.top]
        family = model.families[int(np.argmax(margins))]
        share = squash(max(margins)) / sum(squash(m) for m in margins)
        group = model.members[family]
        votes = {g: 0.0 for g in group}
        for (g, h), w in model.pairs.items():
            if g in votes:
                v = squash(float(x @ w))
                votes[g] += v / (len(group) - 1)
                votes[h] += (1 - v) / (len(group) - 1)
        best = max(group, key=lambda g: votes[g])
        if share * votes[best] >= model.limit - 1e-6:
            want[i, text, best, source, n] += 1
    close = (want - after) + (after - want)
    assert sum(close.values()) <= 1 and sum(after.values()) > 0.9 * len(before)


def _sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def test_join_stage(stages):
    """One row of each group of linked texts stays: of least doc_id. Rows without doc_id stay."""
    before, after = _plain(stages[1]), Counter(_plain(stages[2]))
    texts = sorted({t for i, t, *_ in before if i is not None})
    sets, group = _sets(texts), list(range(len(texts)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    of = {t: top(k) for k, t in enumerate(texts)}
    least = {}
    for i, t, *_ in before:
        if i is not None:
            least[of[t]] = min(least.get(of[t], i), i)
    left = Counter(r for r in after.elements() if r[0] is not None)
    assert Counter(r for r in before if r[0] is None) == Counter(r for r in after.elements() if r[0] is None)
    assert sorted(of[t] for _, t, *_ in left.elements()) == sorted(least) and all(i == least[of[t]] for i, t, *_ in left)
    assert not left - Counter(before) and any(n > 1 for n in Counter(of.values()).values())


def test_passage_stage(stages):
    """Words in windows of 35 that start elsewhere go with the white space after each; other texts are untouched."""
    before, after = _plain(stages[2]), Counter(_plain(stages[3]))
    windows = Counter(tuple(w[k : k + 35]) for _, t, *_ in before for w in [WORD.findall(t or "")] for k in range(len(w) - 34))
    want, cut = Counter(), 0
    for i, t, g, s, n in before:
        spans = [m.span() for m in WORD.finditer(t or "")]
        words = [t[a:b] for a, b in spans]
        gone = set()
        for k in range(len(words) - 34):
            if windows[tuple(words[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        if gone:
            cut += 1
            keep = t[: spans[0][0]]
            for k, (a, _) in enumerate(spans):
                end = spans[k + 1][0] if k + 1 < len(spans) else len(t)
                keep += "" if k in gone else t[a:end]
            t, n = keep, len(keep)
        want[i, t, g, s, n] += 1
    assert want == after and cut


def _mixture(rows, repeats=2.0):
    """How often each row is in the mixture: sources in the order of a hash, epoch after epoch, until the budget is used."""
    size = lambda t: max(1, len(WORD.findall(t or "")))
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    tokens = Counter()
    for _, t, _, s, _ in rows:
        tokens[s] += size(t)
    low, high = min(tokens.values()), max(tokens.values())
    a = max(0.0, 1 - math.log(repeats) / math.log(high / low)) if high > low else 1.0
    out = Counter()
    for s in tokens:
        budget, start, epoch = math.floor(high * (tokens[s] / high) ** a + 1e-3), 0, 0
        while start < budget:
            for _, _, i, t, r in sorted((hashlib.md5(f"{epoch}/{'' if r[0] is None else r[0]}/{digest(r[1])}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1] or "", r) for r in rows if r[3] == s):
                if start < budget:
                    out[i or None if r[0] is None else i, t, s] += 1
                start += size(t)
            epoch += 1
    return out


def test_mixing_stage(stages):
    """Every row as often as the mixture takes it, to the copy; every one at least once, small sources up to twice."""
    before, after = _plain(stages[3]), Counter(_plain(stages[4]))
    assert set(after) == set(before)
    want, got = _mixture(before), Counter()
    for (i, t, _, s, _), n in after.items():
        got[i, t or "", s] += n
    assert got == want
    times = {r: after[r] / n for r, n in Counter(before).items()}
    assert min(times.values()) >= 1 and max(times.values()) == 2


def test_mixing_keeps_rows_apart(spark):
    """One row of a small source with the doc_id, or the missing one, of 300 of a large source leaves these alone; equal rows are counted."""
    big = [(None, f"word{i} " * 40, "en", "big", i) for i in range(300)] + [(7, f"seven{i} " * 40, "en", "big", i) for i in range(300)]
    small = [(None, "a b c", "en", "small", 1), (7, "d e f", "fr", "small", 2), (8, "x y z", "en", "small", 1), (8, "x y z", "de", "small", 1), (8, "x y z", "de", "small", 1)]
    rows = big + small
    after = Counter(_plain(C.mix(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")))
    assert all(after[r] == 1 for r in big) and set(after) == set(rows)
    got = Counter()
    for (i, t, _, s, _), n in after.items():
        got[i, t, s] += n
    assert got == _mixture(rows) and sum(got[i, t, s] for i, t, _, s, _ in set(small)) > len(small)


def test_mixing_realises_the_blocks(spark):
    rows = [(i, f"w{i} " * 20, "en", f"s{i % 2}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    place = {r.doc_id: (r.block, r.place) for r in source_mixing.mix_sources(docs, entropy=None, repeats=2.0, budget=None).where("epoch = 0").collect()}
    for part in C.mix(spark, docs, "").select("doc_id").rdd.glom().collect():
        places = [place[r.doc_id] for r in part]
        assert places == sorted(places)


def test_encoding_stage(stages):
    c = sentence_pieces.codec(sentence_pieces.MODEL)
    before = Counter((i, g, s, tuple(c.sp.encode(t or ""))) for i, t, g, s, _ in _plain(stages[4]))
    assert before == Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in stages[5].collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_reads_a_folder(spark, rows, tmp_path):
    spark.createDataFrame(rows[:40], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    out = C.run(spark, str(tmp_path))
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and left.pop().startswith("stage-") and before <= set(os.listdir(shared))  # what the last stage reads
    assert out.columns == ["doc_id", "lang", "source", "ids", "starts", "ends"] and out.count() >= 30
