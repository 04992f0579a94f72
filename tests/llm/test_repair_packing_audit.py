"""Conversation repair, packing and the filter audit against brute force, with nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from specklegrid.llm import dialogue_repair, filter_audit, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, rest string, present boolean, step int"


def _faults(rows):
    """(role, text, must go, extra cost, blank, duplicate, truncated) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        blank, again = not WORD.search(text), (role, text) in seen
        cut = not blank and not again and re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?"
        seen.add((role, text))
        out.append((role, text, blank or again, 5 * cut, blank, again and not blank, cut))
    return out


def _by_states(faults):
    """Least (cost, audit): how the dialogue ends so far is the state."""
    best = lambda *x: min((v for v in x if v), default=None)
    add = lambda v, c, e: v and (v[0] + c, v[1] + e)

    def inserted(z, s, u, a):
        u = best(u, add(z, 5, "I"), add(s, 5, "I"), add(a, 5, "I"))
        return z, s, u, best(a, add(u, 5, "I"))

    z, s, u, a = inserted((0, ""), None, None, None)
    for role, _, must, extra, *_ in faults:
        i, cut = role[:1], [add(v, 2, "D") for v in (z, s, u, a)]
        if not must:
            take = lambda want, *froms: [x for v in froms for x in ((add(v, extra, "K") if i == want else None), (add(v, 1 + extra, "R") if want != "s" else None))]  # noqa: B023, E731
            cut = [cut[0], best(cut[1], *take("s", z)), best(cut[2], *take("u", z, s, a)), best(cut[3], *take("a", u))]
        z, s, u, a = inserted(*cut)
    return best(z, a)


def _exhaustive(faults):
    """Least (cost, audit) over all edits with two inserts at most between rows."""
    found = []
    gaps = [range(3)] * (len(faults) + 1)
    for edits in itertools.product("DKR", repeat=len(faults)):
        if any(f[2] and e != "D" for f, e in zip(faults, edits, strict=True)):
            continue
        for inserts in itertools.product(*gaps):
            audit, roles, cost = "I" * inserts[0], "*" * inserts[0], 5 * sum(inserts)
            for f, e, n in zip(faults, edits, inserts[1:], strict=True):
                cost += {"D": 2, "K": f[3], "R": 1 + f[3]}[e]
                audit += e + "I" * n
                roles += {"D": "", "K": f[0][:1] or "?", "R": "*"}[e] + "*" * n
            body = roles[1:] if roles[:1] == "s" else roles
            right = len(body) % 2 == 0 and all(r in ("*", "ua"[k % 2]) for k, r in enumerate(body)) and (body or not roles)
            if right:
                found.append((cost, audit))
    return min(found)


def _repaired(faults, audit):
    lines, k, system = [], 0, False
    for e in audit:
        role, text = ("", "") if e == "I" else faults[k][:2]
        k += e != "I"
        if e == "D":
            continue
        if e == "K":
            system = system or (not lines and role[:1] == "s")
        else:
            role = ("user", "assistant")[(len(lines) - system) % 2]
        lines.append(f"{role}:{text}")
    return lines


def _expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = _faults(rows)
    cost, audit = _by_states(faults)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") or not a[0] or not b[0] for a, b in itertools.pairwise(faults))
    counts = [sum(f[k] for f in faults) for k in (4, 5, 6)]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(_repaired(faults, audit)).encode()).hexdigest()


def _conversations():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", " ", "u2", "user", "assistant", "user", "assistant"]
    texts = ["Hi.", "Yes!", "So what?", "cut off", "", " \n", "end. \t", "é.", "Hi.", "a" * 5000 + "."]
    small = {c: [(rng.choice([None, 0, 1, 1, 2, 5, 9]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{k}{rng.choice('.x')}") for k in range(rng.randint(1, 4))] for c in range(150)}
    long = {}
    for c, kinds in enumerate([roles, ["system", "user"], ["tool", "assistant"], ["user"], ["system"]]):
        long[1000 + c] = [(k, rng.choice(kinds), rng.choice(["", f"{k}.", f"{k}.", f"{k}"])) for k in range(1500)]
    return small, long


def test_repair_against_brute_force(spark):
    small, long = _conversations()
    for rows in small.values():
        faults = _faults(rows)
        assert _by_states(faults) == _exhaustive(faults)
    cases = small | long | {None: [(0, "user", "Q."), (1, "assistant", "A.")]}
    rows = [(c, t, r, x, "rest", True, 7) for c, of in cases.items() for t, r, x in of] + [(7777, 3, "user", "gone", "", False, 1)]
    random.Random(1).shuffle(rows)
    got = {r["conv_id"]: r for r in dialogue_repair.repairs(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == set(cases) | {7777}
    for c, of in cases.items():
        assert tuple(got[c])[1:] == _expected(of), c
    assert tuple(got[7777])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    small, long = _conversations()
    cases = small | {1000: long[1000], 1004: long[1004]}
    rows = [(c, t, r, x, "rest", True, 7) for c, of in cases.items() for t, r, x in of]
    got = defaultdict(list)
    for r in dialogue_repair.repaired(spark.createDataFrame(rows, TURNS)).collect():
        got[r["conv_id"]].append((r["step"], r["edit"], f"{r['role']}:{r['text']}"))
    for c, of in cases.items():
        faults = _faults(sorted(of, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())))
        steps = sorted(got[c])
        assert [s for s, *_ in steps] == list(range(len(steps)))
        audit = "".join(e for _, e, _ in steps)
        assert audit == _by_states(faults)[1]
        assert [line for _, e, line in steps if e != "D"] == _repaired(faults, audit)


def test_repair_holds_little_of_a_long_dialogue():
    held = []
    parse = dialogue_repair.Parse(lambda letter, row: None)
    for k in range(100_000):
        parse.read("ua"[k % 2] if k % 7 else "A", k)
        held.append(len(parse.rows))
    assert max(held) <= 2 * dialogue_repair.CHECK_ROWS and len(dialogue_repair._sets) < 5000


def test_repair_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, None, "user", "Q."), (1, 4, "assistant", "A."), (2, None, None, None), (None, None, "user", None)]
    got = {r["conv_id"]: r for r in dialogue_repair.repairs(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["audit"], got[1]["blank"], got[1]["gaps"], got[1]["cost"]) == ("DKK", 1, 0, 2)
    assert got[2]["audit"] == "D" and got[None]["audit"] == "D"
    assert dialogue_repair.repairs(spark.createDataFrame([], schema)).count() == 0
    assert dialogue_repair.repaired(spark.createDataFrame([], schema)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text {t}. End!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = Counter(map(tuple, dialogue_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        want[c, t, "user" if d == 4 else r, x, d != 0] += 2 if d == 3 else 1
    assert got == want


DOCS = "doc_id long, text string, lang string, source string, ids string, part string, key string"


def _texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Éa", "ß", "中文", "don't", "I'll", "\U0001f600", "A$B"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", "", " \n\t", "a<|endoftext|>b", "<|endoftext|>", say(3000), "x" * 9000, say(150), say(150).upper(), "same text", "same text", "same text", "UP " * 300]
    return out + [say(rng.choice([1, 4, 30, 200, 700, 1500])) for _ in range(120)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i % 40 == 39 else i // 2 if i in (10, 11) else i, t, ["en", "fr", None, ""][i % 4], "s", "x", "y", "z") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def _check_packing(rows, want, limit):
    """Rows tile the documents (want: ids of each row of documents by doc_id) and the sequences, whose lengths need no padding; ids are right."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for d, of in pieces.items():
        ids = [np.array(w, "<u4") for w in want[d]]
        made = Counter((r["start"], r["doc_tokens"], bytes(r["ids"])) for r in of)
        if len(ids) == 1:
            assert b"".join(bytes(r["ids"]) for r in sorted(of, key=lambda r: r["start"])) == ids[0].tobytes()
            assert [r["start"] for r in sorted(of, key=lambda r: r["start"])] == np.r_[0, np.cumsum([r["length"] for r in sorted(of, key=lambda r: r["start"])])][:-1].tolist()
            assert {r["doc_tokens"] for r in of} == {len(ids[0])}
        else:
            assert sum(r["length"] for r in of) == sum(map(len, ids)) and all(any(x.tobytes()[4 * s :].startswith(b) and len(x) == n for x in ids) for s, n, b in made)
    lengths = []
    for of in sequences.values():
        at = 0
        for r in sorted(of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
    assert all(n <= limit and n & (n - 1) == 0 for n in lengths)
    return lengths


@pytest.mark.parametrize("limit", [2048, 64])
def test_packing_against_the_tokenizers_library(docs, limit):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, limit=limit).collect()
    lengths = _check_packing(rows, want, limit)
    assert sum(n < limit for n in lengths) <= 3 * limit.bit_length()
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, limit=1000)


def test_long_text_in_parts():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "é ", "  ", "\n", "a", "1 ", "it's ", "end. "]) for _ in range(800_000)) + "y" * 100_000
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert len(text) > 2 * packing.PART and packing.encoder("byte_bpe_50k.json").encode(text).tolist() == want


def test_cost_is_balanced_and_little_is_cut():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(5, 0.8, 4000).astype(int), 1, 2047).tolist()
    found = packing.balanced(lengths, 2048)
    by_piece, cost, used = Counter(), Counter(), Counter()
    for i, at, n, to, offset in found:
        assert offset == used[to]
        used[to] += n
        by_piece[i] += n
        cost[to] += packing.LINEAR * n + n * n
    assert [by_piece[i] for i in range(len(lengths))] == lengths
    full = [to for to, n in used.items() if n == 2048]
    assert len(used) - len(full) <= 11 and len(found) - len(lengths) <= len(used)
    room, first_fit = [2048] * len(used), Counter()
    for n in sorted(lengths, reverse=True):  # the same order, to the first sequence with room
        to = next((t for t, r in enumerate(room) if r >= n), 0)
        room[to] -= n
        first_fit[to] += packing.LINEAR * n + n * n
    pairs = lambda c: np.array([c[t] for t in full]) - packing.LINEAR * 2048
    middle = lambda c: np.subtract(*np.percentile(pairs(c), [90, 10]))  # noqa: E731  # a document near 2,048 ids is a sequence's cost by itself
    assert middle(cost) < 0.5 * middle(first_fit) and np.std(pairs(cost)) < 0.7 * np.std(pairs(first_fit))
    assert packing.balanced([], 2048) == [] and packing.balanced([5], 8) == [(0, 0, 4, 0, 0), (0, 4, 1, 1, 0)]


LABELS = "doc_id long, quality int, toxic int, n int, part string"


def _masks(rows, labels):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, *_ in labels if d is not None and q == 1}
    toxic = {d for d, _, x, *_ in labels if d is not None and x == 1}
    for d, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        tests = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > first[t]
        yield lang or "", tests, d in good, d in toxic


def test_filter_audit_against_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.collect()]
    labels = [(i, i % 2, int(i % 5 == 0), 1, "p") for i in range(0, 130, 3)] + [(3, 1, 1, 2, "p"), (3, None, None, 2, "p"), (None, 1, 1, 0, "p"), (9999, 1, 1, 0, "p")]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.cells(docs, spark.createDataFrame(labels, LABELS))).collect()}
    marked = defaultdict(list)
    for part, *rest in _masks(rows, labels):
        marked[part].append(rest)
    want, sums = {}, Counter()
    for part, of in marked.items():
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(of)))
            for k, f in enumerate(order):
                x = "ABCDE".index(f)
                gone = [i for i in left if of[i][0][x]]
                redundant = sum(m[x] for m, *_ in of) - len(gone)
                left = [i for i in left if not of[i][0][x]]
                sums[part, f] += len(gone)
                want[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(m[x] and sum(m) == 1 for m, *_ in of), sum(of[i][1] for i in gone), sum(of[i][2] for i in gone))
    assert got == {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), spark.createDataFrame([], LABELS))).count() == 0


def test_orders_differ_by_one_swap():
    for n in range(6):
        orders = filter_audit.plain_changes(n)
        assert sorted(map(tuple, orders)) == sorted(itertools.permutations(range(n)))
        for a, b in itertools.pairwise(orders):
            (i, j) = [k for k in range(n) if a[k] != b[k]]
            assert j == i + 1 and a[i] == b[j] and a[j] == b[i]


def test_many_copies_without_ids(spark):
    rows = [(None, "x", "en")] * 30 + [(5, "x", "en")] * 3 + [(7, "x", "fr"), (9, "x", None), (5, "y", "en")]
    found = filter_audit.cells(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["mask"]): (r["n"], r["good"]) for r in found.collect()} == {("en", 1): (34, 4), ("fr", 17): (1, 0), ("", 17): (1, 0)}


def test_labels_are_never_broadcast(spark, docs):
    """Labels are few bytes a row in a file and many in a driver's table, eight times over: the join merges, even where they seem small."""
    found = filter_audit.cells(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
