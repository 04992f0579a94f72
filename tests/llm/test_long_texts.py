"""Texts longer than a piece and than a block: they are worked on whole, and the answers are known beforehand."""

import hashlib

import numpy as np
import pytest

from specklegrid.llm import chat_format, fingerprints, language_id, ngram_join, sentence_pieces, source_mixing, substring_dedup, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(21)
    words = np.array(["".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(60_000)])
    text = " ".join(rng.choice(words, 800_000))
    at = 6 * 400_000  # the first letter of a word
    changed = text[:at] + ("A" if text[at] != "A" else "B") + text[at + 1 :]
    assert len(text) > 4_500_000
    return [text, changed, "short text", None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", "s", 1) for i, t in enumerate(texts)]
    rows += [(10 + 3 * k, f"some words {k} stand here for each of two languages", "en", "s", 1) for k in range(6)] + [(40 + k, f"les mots {k} que voila pour chaque langue", "fr", "t", 1) for k in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_join(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, 4, 85, 100).collect()}
    assert got[0][1] == got[1][1] == 0 and got[2] == (1, 2) and got[3] == (0, 3) and got[0][0] > 799_000


def test_repeats(docs, texts):
    """All but the changed word, or byte, is covered by repeats."""
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert (got[0].n_words, got[0].n_removed, got[1].n_removed) == (800_000, 799_999, 799_999)
    assert got[1].kept == texts[1].split()[400_000]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == len(texts[1]) - 1 and bytes(got[1].kept).decode() == texts[1][6 * 400_000]


def test_scans(docs, texts):
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert found[0].lang_pred in ("en", "fr") and found[3].lang_pred == "und"
    c = sentence_pieces.codec(sentence_pieces.MODEL)
    got = {r.doc_id: r for r in sentence_pieces.encode(docs.where("doc_id < 4")).collect()}
    assert got[0].ids == c.sp.encode(texts[0]) and got[0].decoded == texts[0] and got[0].ends[-1] == len(texts[0])
    n = [r.n_tokens for r in token_counts.encoded_lengths(docs.where("doc_id = 0")).collect()]
    assert n == [len(token_counts._encoding(token_counts.RANKS, None).encode_ordinary(texts[0]))]


def test_native_operators(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs.where("doc_id < 3")).collect()}
    half = len(texts[0]) // 2
    assert got[0].n_chars == len(texts[0]) and got[0].edited_sha256 == hashlib.sha256((texts[0][: len(texts[0]) - half] + texts[1][:half]).encode()).hexdigest()
    assert got[0].near_next == 0.0 and got[0].fingerprint != got[1].fingerprint
    copies = source_mixing.mix_sources(docs).collect()
    assert {r.n_tokens for r in copies if r.doc_id == 0} <= {800_000} and copies
    turns = spark.createDataFrame([(1, 0, "a", texts[0]), (1, 1, "b", "x")], "conv_id long, turn long, role string, text string")
    r = next(r for r in chat_format.rotate(turns).collect() if r.speaker == "a")
    a, b = map(int, r.mask.split("-"))
    assert r.rendered[a:b] == texts[0] + "<|im_end|>"
