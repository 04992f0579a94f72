"""SentencePiece encoding of texts in parts, against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from specklegrid.llm import sentence_pieces

SIGNS = [" ", "  ", "       ", "\n", "\t", "\r\n", "\x00", "\x01", "\x7f", "\u0080", "é", "é", "ß", "中", "文", "😀", "　", "a", "b", "A", "the", "ing", ".", ",", "1", "23", "--", "====", "()", "//", "<s>", "<unk>", "<0x41>"]


def _whole(c, texts):
    """(ids, starts, ends) of each text, encoded whole."""
    return [(ids, *(x.tolist() for x in c.spans(t, np.array(ids, np.int32)))) for t in texts for ids in [c.sp.encode(t)]]


def _parts(c, texts):
    ends, *lists = c.encode(pa.array(texts, pa.string()))
    return [tuple(x[i:j].tolist() for x in lists) for i, j in zip([0, *ends[:-1]], ends, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_parts_give_the_ids_of_whole_texts(seed):
    rng, c = random.Random(seed), sentence_pieces.codec(sentence_pieces.MODEL)
    assert c.parted
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(30))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([32, rng.randrange(1, 0x250), rng.randrange(0x370, 0x600), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(1000)]
    texts += ["", " ", "  ", "a ", " a", "wordword" * 3000]
    assert _parts(c, texts) == _whole(c, texts)
    texts += ["▁", "a▁b c", " ▁"]  # the escape mark itself
    assert _parts(c, texts) == _whole(c, texts)
    assert _parts(c, [None, ""]) == [([], [], [])] * 2 and len(c.encode(pa.array([], pa.string()))[1]) == 0


def test_the_library_sees_a_repeated_word_once(monkeypatch):
    """The time of the pipeline's last stage went to merging the same words again and again."""
    c = sentence_pieces.codec(sentence_pieces.MODEL)
    seen, encode = [], c.sp.encode

    class Counting:
        def encode(self, texts, **more):
            seen.extend(texts)
            return encode(texts, **more)

        def __getattr__(self, name):
            return getattr(c_sp, name)

    c_sp = c.sp
    monkeypatch.setattr(c, "sp", Counting())
    texts = [" ".join(f"word{'abcdefghij'[(k * j) % 10]}" for k in range(200)) for j in range(50)]
    docs = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.nulls(len(texts), pa.int32())], ["doc_id", "text", "rest"])
    found = [r for out in sentence_pieces.encoded([docs], c) for r in out.to_pylist()]
    assert [r["decoded"] for r in found] == texts and [r["ids"] for r in found] == [encode(t) for t in texts]
    assert sum(map(len, seen)) < 0.1 * sum(map(len, texts))
