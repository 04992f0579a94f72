"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and extra columns, and on an empty table."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from specklegrid.llm import chat_format, components, curve_search, fingerprints, language_id, ngram_join, sentence_pieces, source_mixing, substring_dedup, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket string, rest string, v int"


def _texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = say(120), say(60)
    near = base.split()
    near[7] = "changed"
    out = [None, "", "   \n\t", "one", "one two", base, base, base.upper(), " ".join(near), say(50) + "\n" + passage + ". " + say(40), passage + " " + say(30), "a" * 700, "ab" * 300 + " end", say(3000), say(12), "12345 !!", "éè 中文 \U0001f600", passage + " " + passage]
    return out + [say(int(n)) for n in rng.integers(1, 90, 20)]


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["a", "a", "b", None][i % 4], len(t or ""), i, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(texts, width):
    out = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i * 3 + 1] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def _components(sets, num, den):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_ngram_join(docs, texts, width, num, den):
    sets = _sets(texts, width)
    want = _components(sets, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, width, num, den).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_ngram_join_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "other words that stand here"), (9, "other words that stand here"), (None, None)]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == [(0, 0, 0), (0, 3, 2), (2, 2, 2), (2, 3, 2), (4, 3, 2), (9, 2, 2)]


def _morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_weak_hashes_take_for_equal(spark):
    """Polynomials modulo a power of two can't tell this sequence from its complement."""
    x, y = _morse(2048), _morse(2048).translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs, 4, 85, 100).collect()} == {1: 1, 2: 2}
    around = " ".join(f"v{i}" for i in range(17))
    docs = spark.createDataFrame([(1, f"{around} {x} {around}"), (2, f"{around} {y} {around}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}
    words = [" ".join({"a": "up", "b": "down"}[c] for c in t[:512]) for t in (x, y)]  # the same pattern in words and in bytes
    text = [f"{t[:a]}{t[a:b]}" for t in (x, y) for a, b in ((0, 1024),)]
    for found in (substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")), suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"))):
        got = {r.doc_id: r.n_removed for r in found.collect()}
        assert len(got) == 2
    seen, want = set(), {}
    for i, t in enumerate(text):
        gone = set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(t[k : k + 100])
        want[i] = len(gone)
    assert got == want


def test_ngram_join_common_passages(spark):
    """More classes than MEET share most of their signatures: the rare ends of their sets still link what links."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(120))
    own = [" ".join(rng.choice([f"o{i}" for i in range(3000)], 30)) for _ in range(90)]
    rows = [(i, f"{passage} {t}") for i, t in enumerate(own)] + [(200 + i, f"{passage} {t} tail") for i, t in enumerate(own[::3])]
    texts = {i: t for i, t in rows}
    sets = {i: frozenset(tuple(w[k : k + 4]) for w in [t.split()] for k in range(len(w) - 3)) for i, t in texts.items()}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == _components(sets, 85, 100)


def test_near_duplicate_stage_keeps_other_texts_of_a_doc_id(spark):
    import corpus_pipeline as C

    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (1, say("a")), (2, say("a") + " z"), (3, say("b")), (None, say("a")), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text or "") for r in C.join_near_duplicates(spark, docs, "").collect())
    assert got == [(0, say("a")), (1, say("a")), (1, say("b")), (4, ""), (5, "")]


def test_pigeonhole_never_misses():
    """Any pair of sets that links shares a signature."""
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        for n in [*range(1, 40), 77, 150, 400]:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(3):
                cut = rng.integers(0, max(1, int(n * (1 - num / den))) + 1)
                b = np.unique(np.r_[rng.choice(a, len(a) - min(cut, len(a) - 1), replace=False), rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                sig, of = ngram_join.signatures(np.r_[a, b], np.array([len(a), len(b)]), num, den)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (num, n, len(a), len(b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 3), (7, 8), (8, 7), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(21)}


@pytest.mark.parametrize("joined", [True, False])
def test_substring_dedup(docs, texts, joined):
    words = {i * 3 + 1: WORD.findall(t or "") for i, t in enumerate(texts)}
    count = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, carry=("lang", "block", "rest"), joined=joined).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, r = words[i * 3 + 1], got[i * 3 + 1]
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert (r.n_words, r.n_removed) == (len(w), sum(gone)) and r.block == i and r.rest == "y"
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert sum(s.end - s.start for s in r.spans) == sum(gone)
        if joined:
            assert r.kept == " ".join(left)
        else:
            assert WORD.findall(r.kept or "") == left and (any(gone) or r.kept == t)


def test_cover():
    assert substring_dedup.is_cover(substring_dedup.COVER, substring_dedup.PERIOD)


def test_suffix_dedup(docs, texts):
    seen, got = set(), {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        r = got[i * 3 + 1]
        assert bytes(r.kept) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert [(s.start, s.end) for s in r.spans] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        assert (r.n_bytes, r.n_removed) == (len(b), sum(gone))


def test_suffix_dedup_passages_in_other_surroundings(spark):
    """What lies before and behind a repeated passage decides which of its suffixes other windows pick, but not what is removed."""
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("ab"), n))
    passages = [say(n) for n in rng.integers(95, 260, 40)]
    texts = ["".join(say(rng.integers(0, 60)) + passages[k][rng.integers(0, 30) :] for k in rng.integers(0, 40, rng.integers(0, 5))) for _ in range(500)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(t[k : k + 100])
        assert [(s.start, s.end) for s in got[i].spans] == [m.span() for m in re.finditer(b"\1+", bytes(gone))], i
        assert bytes(got[i].kept).decode() == "".join(x for x, g in zip(t, gone, strict=True) if not g)


def test_identifiers_of_later_offsets_decide():
    """An identifier of depth 2 h is made of those of depth h at 0 and h; a change anywhere in the depth changes it, one behind it doesn't."""
    rng = np.random.default_rng(7)
    data = rng.integers(97, 101, 400).astype(np.uint8)
    eight, at = suffix_dedup.eights(data), np.arange(250)
    for half in (8, 16, 32):
        a, b = (suffix_dedup.identifiers(eight, at + k, half) for k in (0, half))
        assert (suffix_dedup.identifiers(eight, at, 2 * half) == suffix_dedup.join(a, b)).all()
    whole = suffix_dedup.identifiers(eight, at, 100)
    for place in (0, 31, 32, 63, 64, 67, 68, 99, 100):
        changed = data.copy()
        changed[120 + place] = 120
        differs = suffix_dedup.identifiers(suffix_dedup.eights(changed), at, 100) != whole
        assert differs[120] == (place < 100) and differs.sum() == 100
    same = {}
    for i in at.tolist():
        same.setdefault(data[i : i + 100].tobytes(), set()).add(int(whole[i]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(whole.tolist()))


@pytest.mark.parametrize("copies", [1, 40])
def test_suffix_dedup_null_and_repeated_ids(spark, copies):
    """Of equal windows exactly one stays, whatever the doc_ids; overlapping repeats within a text too."""
    rng = np.random.default_rng(11)
    say = lambda n: "".join(rng.choice(list("abcd"), n))
    part = say(150)
    rows = [(None, say(50) + part), (None, part + say(80)), (3, part), (3, part + "x"), (3, say(300)), (1, None), (9, "ab" * 200), (9, part[20:] + say(10))] * copies
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    distinct = {t[k : k + 100] for _, t in rows if t for k in range(len(t) - 99)}
    kept = sum(r.n_bytes - r.n_removed for r in got)
    order = sorted({(i is not None, i or 0, suffix_dedup.xxhash.xxh3_64_intdigest((t or "").encode()) >> suffix_dedup.PLACE_BITS, t or "") for i, t in rows})
    times = Counter((i is not None, i or 0, t or "") for i, t in rows)
    seen, want = set(), 0
    for some, i, _, t in order:
        for _ in range(times[some, i, t]):
            gone = bytearray(len(t))
            for k in range(len(t) - 99):
                if t[k : k + 100] in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(t[k : k + 100])
            want += gone.count(0)
    assert seen == distinct and kept == want


def test_language_id(spark):
    rng = np.random.default_rng(1)
    stems = {"en": "the of and thing wh", "de": "der und sch keit ein", "fr": "les eau que ment oi", "es": "los que cion ado ez"}
    rows = []
    for i in range(400):
        g = list(stems)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(stems[g].split(), 2)) for _ in range(30)), g))
    rows += [(1000, None, "en"), (1001, "123 !?", None), (1002, "", "fr"), (None, "the of and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, per_lang=60)).collect()
    held = [r for r in got if r.held_out]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held if r.doc_id < 1000) > 0.97 * len([r for r in held if r.doc_id < 1000])
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_sample_is_bounded_and_loses_no_language(spark):
    """Thousands of rows of one doc_id, with texts of their own or one text; a language whose rows are all one row."""
    import zlib

    a, b = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(a, f"the thing of {i} words", "en") for i in range(3000)] + [(a, "und der die das", "de")] * 3000 + [(i * 3, f"les oi {i}", "fr") for i in range(3000)] + [(b, "el los que", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found, langs = language_id.sample(docs, 40)
    got = found.collect()
    assert langs == ["de", "en", "es", "fr"] and Counter(r.lang for r in got) == {"de": 1, "en": 40, "fr": 40, "es": 1}
    assert sorted(r.place for r in got if r.lang == "en") == list(range(1, 41)) and len({r.text for r in got}) == len(got)
    assert sorted(map(tuple, language_id.sample(docs.repartition(2), 40)[0].collect())) == sorted(map(tuple, got))
    model = language_id.fit(docs, per_lang=40)
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "und der die das"), (2, "el los que"), (3, "the words of"), (4, "les oi 77")], "doc_id long, text string"), model).collect()} == set(langs)


def test_language_model_learns_from_every_row(spark):
    """A word that one row in a thousand has tells the language of its rows, whatever their hashes; so does the order of rows not matter."""
    from pyspark.sql import functions as F

    rows = [(3 * i, f"thing of {i} words", "en") for i in range(6000)] + [(3 * i + 1, f"thing of {i} words und", "de") for i in range(6000)]
    few = [(40_000 + i, "zqx vjk qqz xzj", "de" if i % 2 else "en") for i in range(0, 60, 2)] + [(50_000 + i, "jjw kkp wwj pkk", "de") for i in range(30)]
    docs = spark.createDataFrame(rows + few, "doc_id long, text string, lang string")
    model = language_id.fit(docs.repartition(3))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "zqx vjk"), (2, "jjw kkp")], "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "de"}
    drawn = [r.h for r in language_id.sample(docs, 400)[0].collect()]
    part = language_id.fit(docs.where(F.xxhash64(F.lit("language id"), "doc_id", "text").isin(drawn)))  # what a sample of 400 rows a language would see
    assert any(not np.allclose(model.pairs[k], part.pairs[k], atol=1e-5) for k in model.pairs)
    other = language_id.fit(docs.repartition(7, "text"))
    assert all(np.allclose(model.pairs[k], other.pairs[k], atol=1e-5) for k in model.pairs)


def test_every_language_is_learned(spark):
    """More languages than any list holds, each a family of its own, with a few rows each."""
    names = [f"l{i:03d}" for i in range(215)]
    rng = np.random.default_rng(6)
    words = {g: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(4)] for g in names}
    rows = [(3 * k, " ".join(rng.choice(words[g], 12)), g) for i, g in enumerate(names) for k in range(4 * i, 4 * i + 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id as string)) % 3 <> 1 or lang < 'l005'")
    model = language_id.fit(docs, dims=1024)
    learned = {r.lang for r in docs.where(~language_id.held_out()).select("lang").distinct().collect()}
    assert len(learned) > 200 and set(model.langs) == learned
    texts = spark.createDataFrame([(1, " ".join(words[g]), g) for g in sorted(learned)], "doc_id long, text string, truth string")
    got = language_id.identify(texts, model, carry=("truth",), dims=1024).collect()
    assert sum(r.lang_pred == r.rest.truth for r in got) > 0.95 * len(got)


def test_language_stage_rejects_junk(spark):
    import corpus_pipeline as C

    rng = np.random.default_rng(1)
    stems = {"en": "the of and thing wh", "de": "der und sch keit ein", "fr": "les eau que ment oi", "es": "los que cion ado ez"}
    say = lambda g: " ".join("".join(rng.choice(stems[g].split(), 2)) for _ in range(30))
    rows = [(i, say(g), g) for i in range(800) for g in [list(stems)[i % 4]]]
    junk = ["".join(chr(c) for c in rng.integers(0x430, 0x450, 200)) for _ in range(20)] + ["xkq zzv jj0x " * 20, "0x7f; q[j] = k >> 3; " * 10, "漢字仮名" * 30]
    rows += [(2000 + i, t, None) for i, t in enumerate(junk)] + [(3000, "12 !?", "en")]
    docs = spark.createDataFrame([(i, t, g, "a", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.lang for r in C.identify_language(spark, docs, "").collect()}
    assert not [i for i in left if i >= 2000]
    assert sum(left.get(i) == g for i, _, g in rows[:800]) >= 0.98 * 800
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in C.identify_language(spark, bare, "").collect()} == {i for i, _, _ in rows} - {3000}


def test_sentence_pieces(docs, texts):
    c = sentence_pieces.codec(sentence_pieces.MODEL)
    for r in sentence_pieces.encode(docs, carry=("block", "rest")).collect():
        t = texts[r.block] or ""
        assert r.ids == c.sp.encode(t) and r.decoded == c.sp.decode(r.ids)
        assert all(a <= b for a, b in zip(r.starts, r.ends, strict=True)) and (not t or r.ends[-1] == len(t.encode()))
        if t:
            assert b"".join(t.encode()[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == t.encode()


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _character_map(pairs):
    """A compiled character map: a double array of the keys, whose leaves point to zero-ended replacements."""
    strings, starts = b"", {}
    for new in pairs.values():
        if new not in starts:
            starts[new] = len(strings)
            strings += new.encode() + b"\0"
    units, taken = {0: 0}, {0}

    def place(node, prefix):
        labels = {}
        for key in pairs:
            k = key.encode()
            if k.startswith(prefix):
                labels.setdefault(k[len(prefix)] if len(k) > len(prefix) else 0, []).append(key)
        offset = next(o for o in range(1, 1 << 20) if all(node ^ o ^ b not in taken for b in labels))
        units[node] |= offset << 10 | (1 << 8 if 0 in labels else 0)
        taken.update(node ^ offset ^ b for b in labels)
        for b in labels:
            child = node ^ offset ^ b
            if b == 0:
                units[child] = 1 << 31 | starts[pairs[prefix.decode()]]
            else:
                units[child] = b
                place(child, prefix + bytes([b]))

    place(0, b"")
    size = 256 * (max(units) // 256 + 1)
    array = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(size))
    return len(array).to_bytes(4, "little") + array + strings


@pytest.mark.parametrize("prefix,squeeze", [(1, 1), (0, 0), (1, 0), (0, 1)])
def test_sentence_pieces_through_a_character_map(tmp_path, prefix, squeeze):
    """The dealt model's pieces under a normalisation with a compiled map: ids and text as the library's, and spans by the longest prefix."""
    import public_tokenizers
    import sentencepiece

    pairs = {"\uff21": "A", "\ufb01": "fi", "e\u0301": "\u00e9", "\u2460": "1", "\u3000": " ", "\t": " ", "\u00ad": "", "ab": "ba", "abc": "x", "\U0001f600": ":) "}
    with open(public_tokenizers.path(sentence_pieces.MODEL), "rb") as f:
        parts = [(k, v) for k, v in sentence_pieces.fields(f.read()) if k != 3]
    spec = _field(1, b"own") + _field(2, _character_map(pairs)) + _field(3, prefix) + _field(4, squeeze) + _field(5, 1)
    path = tmp_path / "own.model"
    path.write_bytes(b"".join(_field(k, v) for k, v in parts) + _field(3, spec))
    c = sentence_pieces.Codec(str(path))
    assert c.normalizer.units is not None
    assert [c.normalizer.longest(t.encode(), 0) for t in ("abc", "abd", "e\u0301", "e", "zz")] == [(3, b"x"), (2, b"ba"), (3, "\u00e9".encode()), (0, b""), (0, b"")]
    rng = np.random.default_rng(prefix * 2 + squeeze)
    letters = [*pairs, "e", "a", "b", "c", " ", "  ", "word", "\u00e9", "\u4e2d", ".", "z"]
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for k in range(300):
        text = "".join(rng.choice(letters, int(rng.integers(0, 12)))) if k else "  "
        ids = library.encode(text)
        normal, source = c.normalizer.normalize(text.encode())
        assert normal.decode() == library.normalize(text), (text, normal.decode(), library.normalize(text))
        starts, ends = c.spans(text, np.array(ids, np.int32))
        assert c.sp.encode(text) == ids and len(starts) == len(ids)
        assert (np.diff(source) >= 0).all() and all(a <= b for a, b in zip(starts, ends, strict=True))
        assert not len(ids) or (ends[:-1] == starts[1:]).all()


def test_normalizer_squeezes_white_space():
    n = sentence_pieces.Normalizer(b"")
    out, source = n.normalize(b"  a  b ")
    assert out.decode() == "▁a▁b" and len(source) == len(out) + 1


def test_token_counts(docs, texts):
    e = token_counts._encoding(token_counts.RANKS, None)
    n = sorted(len(e.encode_ordinary(t or "")) for t in texts)
    got = {r.n_tokens: r for r in token_counts.length_totals(token_counts.encoded_lengths(docs), span=64).collect()}
    assert sorted(got) == sorted(set(n))
    for k, r in got.items():
        assert r.truncated_total == sum(min(x, k) for x in n) and r.docs_at_least == sum(x >= k for x in n) and r.tokens_up_to == sum(x for x in n if x <= k)
        assert abs(r.cum_share - sum(x <= k for x in n) / len(n)) < 1e-12


def test_curve_search(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 12))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0]), (2020, [None] * 12)]
    from pyspark.sql import functions as F

    got = curve_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 900, 20):
        s = v @ v[q]
        s[q] = -np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(x - s[i]) < 1e-9 for _, i, x in mine)
        hit += len(set(np.argsort(-s)[:20]) & {i for _, i, _ in mine})
    assert hit / 900 >= 0.9 and {r.query_id for r in got} == set(range(0, 900, 20))


def _true_best(v, q, k=20):
    s = v @ v[q]
    s[q] = -np.inf
    return set(np.lexsort((np.arange(len(v)), -s))[:k].tolist())


def _found(spark, v, step, **how):
    from pyspark.sql import functions as F

    out = {}
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    for r in curve_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % step == 0, **how).collect():
        out.setdefault(r.query_id, set()).add(r.vec_id)
    return out


def test_curve_search_reaches_as_far_as_the_table_needs(spark):
    """Few curves over many blocks: windows of a constant number of rows would miss a third of the neighbours."""
    v = np.random.default_rng(6).normal(size=(6000, 24))
    got = _found(spark, v, 100, curves=4, block=64)
    assert sum(len(_true_best(v, q) & got[q]) for q in range(0, 6000, 100)) / (60 * 20) >= 0.9


def test_curve_search_exact(spark):
    v = np.random.default_rng(16).normal(size=(1500, 16))
    got = _found(spark, v, 50, block=64, exact=True)
    assert all(got[q] == _true_best(v, q) for q in range(0, 1500, 50))


def test_curve_search_copies_and_ties(spark):
    """Thousands of copies: the smallest vec_ids are the neighbours, and what stands behind the copies is found too."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(5000, 12))
    v[rng.permutation(5000)[:3500]] = v[0]
    got = _found(spark, v, 50)
    copies = [q for q in range(0, 5000, 50) if (v[q] == v[0]).all()]
    others = sorted(set(range(0, 5000, 50)) - set(copies))
    assert len(copies) > 40 and all(got[q] == _true_best(v, q) for q in copies)
    assert sum(len(_true_best(v, q) & got[q]) for q in others) / (len(others) * 20) >= 0.9
    tied = np.zeros((300, 8))
    tied[:, 0], tied[np.arange(300), 1 + np.arange(300) % 7] = 1, np.arange(300)
    tied[::20, 1:] = 0  # these see all rows at the same score
    got = _found(spark, tied, 20)
    assert all(got[q] == _true_best(tied, q) for q in range(0, 300, 20))


@pytest.mark.parametrize("lengths", ["one long", "six orders"])
def test_curve_search_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(6000, 24))
    if lengths == "one long":
        v[7] *= 100
    else:
        v *= 10 ** rng.uniform(-3, 3, (6000, 1))
    got = _found(spark, v, 100, curves=16, block=64)
    assert sum(len(_true_best(v, q) & got[q]) for q in range(0, 6000, 100)) / (60 * 20) >= 0.9


def test_hilbert_is_a_curve():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = curve_search.hilbert(g, 3)
    assert len(np.unique(k)) == 512 and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_fingerprints(docs, texts):
    parts = lambda t: {p for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, t in enumerate(texts):
        t, following, r = t or "", texts[(i + 1) % len(texts)] or "", got[i * 3 + 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(parts(t), parts(edited))) < 1e-9 and abs(r.near_next - like(parts(t), parts(following))) < 1e-9
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_next_of_repeated_and_missing_ids(spark):
    rows = [(None, "a. b"), (None, "a. b"), (None, "a. b"), (7, "x. y"), (7, "z"), (7, "z"), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, i int, h string")
    got = fingerprints.fingerprints(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    pairs = [(r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(docs).collect() for _ in range(r.times)]
    # one cycle over all rows, in the order of doc_id
    assert Counter((i, t) for i, t, _ in pairs) == Counter((i, t or "") for i, t in rows) and Counter(n for *_, n in pairs) == Counter(t or "" for _, t in rows)
    assert [n for i, t, n in pairs if i is None].count("a. b") == 2 and {n for i, t, n in pairs if i is None} == {"a. b", ""}


def test_differences_are_peeled(spark):
    """Differences come out of the sketches of the least size, or of larger ones where these fail."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        n, other = (5, 1) if k < 20 else (60, 45) if k < 40 else (900, 400)
        a = rng.integers(-(2**62), 2**62, n).tolist()
        b = a[: n - 2 * other] + rng.integers(-(2**62), 2**62, other).tolist()
        rows.append((k, a, b))
    x = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    from pyspark.sql import functions as F

    x = x.withColumns({f"c{c}": F.expr(fingerprints.table(c, fingerprints.SIZES[0])) for c in "ab"}).withColumn("d", fingerprints.differences("a", "b", "ca", "cb"))
    got = x.collect()
    assert all(r.d.solved for r in got) and {r.d.size for r in got if r.k < 40} == {64} and {r.d.size for r in got if r.k >= 40} == {4096}
    assert all({(f.x, f.n) for f in r.d.found} == {(v, 1) for v in set(r.a) - set(r.b)} | {(v, -1) for v in set(r.b) - set(r.a)} for r in got)


def _cells(text):
    """The cells of a fingerprint: (count, digest, check) by cell."""
    out = {}
    for e in text.split(".") if text else []:
        cell, n, x, c = (int(v, 16) for v in e.split("-"))
        out[cell] = (n - (1 << 64) if n >= 1 << 63 else n, x, c)
    return out


def _likeness_of(a, b, size=64):
    """What two fingerprints alone say: their cells subtract, digests that stand alone are taken out of their three cells; None where cells are left."""
    import struct

    import xxhash

    check = lambda x: xxhash.xxh64(struct.pack("<i", 77), seed=xxhash.xxh64(struct.pack("<Q", x), seed=42).intdigest()).intdigest()
    a, b = _cells(a), _cells(b)
    total, cells, found = sum(n for n, *_ in [*a.values(), *b.values()]) // 3, dict(a), 0
    for k, (n, x, c) in b.items():
        m, y, d = cells.get(k, (0, 0, 0))
        cells[k] = (m - n, y ^ x, d ^ c)
    while alone := {(x, n, c) for n, x, c in cells.values() if abs(n) == 1 and c == check(x)}:
        for x, n, c in alone:
            found += 1
            for j in range(3):
                k = j * size + ((x >> (20 * j)) & (size - 1))
                m, y, d = cells[k]
                cells[k] = (m - n, y ^ x, d ^ c)
    return (total - found) / (total + found) if total and all(v == (0, 0, 0) for v in cells.values()) else None


def test_two_fingerprints_alone_give_their_likeness(spark):
    rng = np.random.default_rng(8)
    say = lambda n: "\n".join(f"line {rng.integers(1e9)}" for _ in range(n))
    base = say(30)
    texts = [base, base + "\n" + say(2), base, say(40), say(25), "\n".join(base.split("\n")[5:]), "", say(300), say(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    alone = [_likeness_of(r.fingerprint, n.fingerprint) for r, n in zip(got, [*got[1:], got[0]], strict=True)]
    edited = [_likeness_of(r.fingerprint, r.edited_fingerprint) for r in got]
    for r, v in zip(got[:6], alone[:6], strict=True):
        assert v is not None and abs(v - r.near_next) < 1e-12
    for r, v in zip(got[:6], edited[:6], strict=True):
        assert v is not None and abs(v - r.near_edited) < 1e-12
    assert alone[7] is None and got[7].near_next == 0.0  # too many differences for the least size


def test_mixing(docs, spark, empty):
    copies = source_mixing.mix_sources(docs, entropy=None, repeats=2.0, budget=None).collect()
    assert {r.doc_id for r in copies} == {r.doc_id for r in docs.collect()}  # everything at least once
    assert abs(sum({(r.source): r.weight for r in copies}.values()) - 1) < 1e-4
    plain = source_mixing.mix_sources(docs, entropy=0.999).collect()
    tokens = Counter()
    for r in plain:
        tokens[r.source] += r.n_tokens
    weights = {r.source: r.weight for r in plain}
    whole = sum(max(1, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert all(tokens[s] >= int(w * whole) - 1 for s, w in weights.items())
    assert len({(r.doc_id, r.epoch) for r in plain}) == len(plain)


def test_a_tiny_source_is_read_no_more_than_the_limit(spark):
    rows = [(i, "word " * 100, "big") for i in range(2000)] + [(5000, "word", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    reads = Counter(r.doc_id for r in source_mixing.mix_sources(docs).collect())
    assert 1 <= reads[5000] <= 4 and len(reads) >= 2000 - 400
    sources = spark.createDataFrame([(1.0,), (200000.0,)], "t double")
    free, held = source_mixing.exponent(sources, repeats=None), source_mixing.exponent(sources)
    assert free < 0.2 and held > 0.8 and source_mixing.exponent(sources, entropy=None, repeats=None) == 0.0


def test_epochs_are_dealt_in_ranges(spark):
    """A budget of 150 times the corpus, in ranges of 64 epochs, takes each document 150 times."""
    rows = [(i, "a b c", "s") for i in range(4)] + [(9, "a", "t"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = source_mixing.mix_sources(docs, entropy=None, repeats=1000.0, budget=150.0).collect()
    total = 3 * 4 + 1 + 1
    tokens = Counter()
    for r in copies:
        tokens[r.source] += r.n_tokens
    assert all(abs(n - 150 * total / 3) <= 3 for n in tokens.values())
    assert len({(r.doc_id, r.epoch) for r in copies}) == len(copies) and max(r.epoch for r in copies) > 600


def test_chat(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "v", None), (1, 1, "v", None), (1, None, None, "first"), (None, 0, "u", "x"), (2, 300, "u", "later"), (2, 1, "v", "a <|im_end|> b"), (2, 2, "x\n<|im_start|>", "c")]
    rows += [(3, i, f"s{i % 3}", f"turn {i}") for i in range(900)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, k int")
    got = {(r.conv_id, r.speaker): r for r in chat_format.rotate(table).collect()}
    role = lambda r: (r or "unknown").replace("<|", "<||").replace("\\", "\\\\").replace("\n", "\\n")
    dialogues = {}
    for conv, turn, who, text in rows:
        if conv is not None:
            dialogues.setdefault(conv, []).append((turn or 0, role(who), (text or "").replace("<|", "<||")))
    assert set(got) == {(c, who) for c, turns in dialogues.items() for _, who, _ in turns}
    for (conv, speaker), r in got.items():
        out, spans = "", []
        for _, who, text in sorted(dialogues[conv]):
            out += "<|im_start|>assistant\n" if who == speaker else f"<|im_start|>user name={who}\n"
            if who == speaker:
                spans.append(f"{len(out)}-{len(out) + len(text) + 10}")
            out += f"{text}<|im_end|>\n"
        assert (r.n_turns, r.rendered, r.mask) == (len(dialogues[conv]), out, ",".join(spans))


def test_token_limits_and_quantiles(spark):
    lengths = spark.createDataFrame([(n,) for n in [0, 3, 3, 10, 500]], "n_tokens long")
    totals = token_counts.length_totals(lengths, span=4)
    assert token_counts.at_limits(totals, [0, 1, 5, 10, 100, 1000]) == {k: sum(min(k, n) for n in [0, 3, 3, 10, 500]) for k in [0, 1, 5, 10, 100, 1000]}
    assert [token_counts.quantile(totals, q).first()[0] for q in (0.1, 0.5, 0.6, 0.61, 1.0)] == [0, 3, 3, 10, 500]


def test_empty_tables(spark, empty):
    assert ngram_join.ngram_join(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0
    assert language_id.fit(empty) is None and language_id.identify(empty, None).count() == 0
    assert sentence_pieces.encode(empty).count() == 0 and token_counts.length_totals(token_counts.encoded_lengths(empty)).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0 and source_mixing.mix_sources(empty).count() == 0
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    from pyspark.sql import functions as F

    assert curve_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


