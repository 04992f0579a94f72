"""Repair of conversation structure by error-correcting Earley parsing.

A grammar of roles says which sequences of turns are a dialogue: an optional system turn, then user and assistant in
turn. Beside reading a row as the terminal it is (keep, 0), error productions read any row as a user's or an
assistant's (rerole, 1), read nothing as one of these (insert, 5) and skip a row (delete, 2). A truncated row costs 5
where it isn't deleted; blank rows and rows seen earlier in the conversation must be deleted. Every item of the chart
retains its least (cost, audit), the audit being the letters D, I, K, R of its edits; the completed chart yields the repair.

The grammar is left-linear, so every item begins before the first row and a set of the chart has a few items however
long the dialogue is. Audits are compared by the rank of what they were at the last row and the inserts since then, so
none is copied: of two different audits that read the same rows neither begins the other. A set depends on the set before
it, relative to its least cost, and on the kind of the row; items that cost over PRUNE more than the least can't win,
as ten repair the best item, and five more bring it where the other is. So there are few sets, and each is built once a worker.

Rows are shuffled once, by conversation, sorted on disk and read batch by batch. A row is held until all
items agree on its edit, so a conversation of any length needs memory for the undecided stretch at its end only.

Cases: a null role or text is one space; a role whose first letter isn't s, u or a (or an empty one) fits nowhere; null
turns come first; rows of equal turn stand in the order of role and text; rows without conv_id are one conversation;
repeated rows are duplicates; very long texts pass through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (what, of which symbols); lower-case letters are terminals, the first rule's left side is the whole.
GRAMMAR = (("Dialogue", ()), ("Dialogue", ("Turns",)), ("Turns", ("Turns", "u", "a")), ("Turns", ("u", "a")), ("Turns", ("s", "u", "a")))
NAMES = {"u": "user", "a": "assistant"}  # what rerole and insert can give
REROLE, DELETE, INSERT, TRUNCATED, PRUNE = 1, 2, 5, 5, 15
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
CHECK_ROWS = 512

#: A set of the chart: a tuple of (item, cost above the least, rank of the audit at the last row, inserts since then), item = (rule, dot).
_sets: dict = {}


def _closed(found: dict) -> dict:
    """found {item: (cost, rank, inserts, back)} with all that completion and insertion add."""
    heap = [(v[:3], item, v[3]) for item, v in found.items()]
    heapq.heapify(heap)
    done = {}
    while heap:
        (cost, rank, k), item, back = heapq.heappop(heap)
        if item in done:
            continue
        done[item] = (cost, rank, k, back)
        what, symbols = GRAMMAR[item[0]]
        if item[1] == len(symbols):
            for r, (_, rhs) in enumerate(GRAMMAR):
                if rhs[:1] == (what,):
                    heapq.heappush(heap, ((cost, rank, k), (r, 1), back))
        elif symbols[item[1]] in NAMES:
            heapq.heappush(heap, ((cost + INSERT, rank, k + 1), (item[0], item[1] + 1), back))
    return done


def _settled(done: dict) -> tuple[tuple, int, tuple]:
    """The set, its least cost, and for each item where it came from: (item of the set before, letter, inserts after it)."""
    least = min(v[0] for v in done.values())
    kept = sorted((item, v) for item, v in done.items() if v[0] <= least + PRUNE)
    return tuple((item, v[0] - least, v[1], v[2]) for item, v in kept), least, tuple((*v[3], v[2]) for _, v in kept)


def first_set() -> tuple[tuple, int, tuple]:
    return _settled(_closed({(r, 0): (0, 0, 0, (-1, "")) for r in range(len(GRAMMAR))}))


def next_set(chart: tuple, kind: str) -> tuple[tuple, int, tuple]:
    """What a row of a kind makes of a set. kind: the initial of its role, in upper case if truncated; `x`: another role; `d`: must be deleted."""
    got = _sets.get((chart, kind))
    if got:
        return got
    extra, role = TRUNCATED if kind.isupper() else 0, kind.lower()
    moves: dict = {}

    def move(item, cost, key, back):
        if item not in moves or (cost, key) < moves[item][:2]:
            moves[item] = (cost, key, back)

    for i, (item, cost, rank, k) in enumerate(chart):
        inserts = "I" * k
        move(item, cost + DELETE, (rank, inserts + "D"), (i, "D"))
        wanted = GRAMMAR[item[0]][1][item[1] : item[1] + 1]
        if role != "d" and wanted and wanted[0].islower():
            on = (item[0], item[1] + 1)
            if role == wanted[0]:
                move(on, cost + extra, (rank, inserts + "K"), (i, "K"))
            if wanted[0] in NAMES:
                move(on, cost + REROLE + extra, (rank, inserts + "R"), (i, "R"))
    ranks = {key: n for n, key in enumerate(sorted({m[1] for m in moves.values()}))}
    _sets[chart, kind] = got = _settled(_closed({item: (cost, ranks[key], 0, back) for item, (cost, key, back) in moves.items()}))
    return got


class Parse:
    """Reads rows one by one; edit(letter, row) is called in order as soon as an edit is sure (row is None for an insert)."""

    def __init__(self, edit):
        self.edit, self.cost, self.rows = edit, 0, []
        self.chart, _, backs = first_set()
        self.backs, self.check = [backs], CHECK_ROWS

    def read(self, kind: str, row) -> None:
        self.chart, least, backs = next_set(self.chart, kind)
        self.cost += least
        self.backs.append(backs)
        self.rows.append(row)
        if len(self.rows) >= self.check:
            self._agree()
            self.check = max(CHECK_ROWS, 2 * len(self.rows))

    def _agree(self) -> None:
        """Settles what all items of the last set have in common."""
        live, at = set(range(len(self.chart))), len(self.backs) - 1
        while at and len(live) > 1:
            live = {self.backs[at][i][0] for i in live}
            at -= 1
        if at:
            self._settle(at, live.pop())

    def _settle(self, at: int, i: int) -> None:
        """The path to item i of set `at` is right; the item itself, with its inserts, becomes the first one."""
        path = []
        for j in range(at, -1, -1):
            before, letter, inserts = self.backs[j][i]
            path.append((letter, inserts))
            i, last = before, i
            if not j:
                break
        for j, (letter, inserts) in enumerate(reversed(path)):
            if letter:
                self.edit(letter, self.rows[j - 1])
            for _ in range(inserts):
                self.edit("I", None)
        del last
        keep = self.backs[at]
        self.backs = [tuple((-1, "", 0) for _ in keep), *self.backs[at + 1 :]]
        self.rows = self.rows[at:]

    def end(self) -> int:
        """The least cost; all edits are given by then."""
        whole = GRAMMAR[0][0]
        ends = [(c, rank, k, i) for i, ((r, dot), c, rank, k) in enumerate(self.chart) if GRAMMAR[r][0] == whole and dot == len(GRAMMAR[r][1])]
        cost, _, _, i = min(ends)
        self._settle(len(self.backs) - 1, i)
        return self.cost + cost


class Summary:
    """Counts, audit and hash of one conversation."""

    def __init__(self):
        self.audit, self.sha, self.any, self.out = bytearray(), hashlib.sha256(), False, []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.parse, self.place, self.system = Parse(self._edit), 0, False

    def _edit(self, letter: str, row) -> None:
        self.audit += letter.encode()
        role, text = row or ("", "")
        if letter == "D":
            self.out.append((len(self.audit) - 1, letter, role, text))
            return
        if letter == "K":
            self.system = self.system or (not self.place and role[:1] == "s")
        else:
            role = NAMES["ua"[(self.place - self.system) % 2]]
        self.sha.update(("\n" * (self.place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.out.append((len(self.audit) - 1, letter, role, text))
        self.place += 1

    def read(self, turn, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not blank and not again
        self.truncated += cut
        self.parse.read("d" if blank or again else initial.upper() if cut else initial, (role, text))

    def result(self) -> tuple:
        cost = self.parse.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.sha.hexdigest()


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "step long, edit string, role string, text string"
BATCH_BYTES = 4 << 20


def _scan(turns: DataFrame, edits: bool) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.coalesce(present, F.lit(True)).alias("present")).repartition("conv_id")
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    # the rows lie by conversation already: sorts only, no further exchange
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    t = t.select("*", (bare == "").alias("blank"), seen.alias("again"), (~F.substring(bare, -1, 1).isin(*STOPS)).alias("cut"))
    t = t.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    conv = t.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, {EDITS if edits else COUNTS}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}

    def batch_of(convs, rows):
        columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
        return pa.record_batch([convs, *[pa.array(c, kinds[s.split()[1]]) for c, s in zip(columns, schema.split(", ")[1:], strict=True)]], names)

    def run(batches):
        now, kind, key = None, None, object()
        keys, rows, size = [], [], 0

        def flush():
            nonlocal keys, rows, size
            out = batch_of(pa.array(keys, kind), rows)
            keys, rows, size = [], [], 0
            return out

        def take(last: bool):
            nonlocal size
            if last:
                result = now.result()
                if not edits:
                    keys.append(key)
                    rows.append(result)
                    size += len(result[6])
            if edits:
                keys.extend([key] * len(now.out))
                rows.extend(now.out)
                size += sum(len(r[3]) + 16 for r in now.out)
            now.out.clear()

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, here, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != key:
                    if now:
                        take(True)
                    now, key = Summary(), conv
                if here:
                    now.read(turn, role, text, blank, again, cut)
                    if len(now.out) >= CHECK_ROWS:
                        take(False)
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield flush()
        if now:
            take(True)
        if rows:
            yield flush()

    return t.mapInArrow(run, schema)


def repairs(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns(conv_id, turn, role, text): conv_id, gaps (turn numbers that are missing between its first and its last), blank, duplicate, truncated, illegal (neighbours of roles that can't follow), cost, audit, repaired_sha256 (of the repaired `role:text` lines).

    A column `present`, where there is one, says which rows are there; the others only name their conversation.
    """
    return _scan(turns, False)


def repaired(turns: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, step (from 0), edit (D, I, K or R), role and text after it (of a deleted row, before). Rows that aren't D, in order, are the repaired dialogue."""
    return _scan(turns, True)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows hurt by a hash of `conv_id:turn`, one in twenty each: gone (present is false), emptied, without stops, doubled, made a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    t = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), d.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    out = t.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") != 0).alias("present"), "d")
    return out.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("d", "copy")


def op11_dialogue_repair(spark, sf_dir: str) -> DataFrame:
    return repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _op11_sql() -> str:
    """The same by states instead of items: z (nothing yet), s, u, a say how the dialogue ends so far; each is `cost` in nine digits followed by its audit, so the least string is the least (cost, audit)."""
    add = lambda x, cost, letter: f"lpad((substr({x}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}'"
    read = lambda role, *before: ", ".join(f"CASE WHEN NOT must AND initial = '{role}' THEN {add(x, 'extra', 'K')} END" + (f", CASE WHEN NOT must THEN {add(x, '1 + extra', 'R')} END" if role != "s" else "") for x in before)
    insert = lambda old, *before: f"least({old}, {', '.join(add(x, 5, 'I') for x in before)})"
    return f"""
WITH RECURSIVE
b AS (SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda crc, c:
    list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 20 AS d FROM b),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, (SELECT unnest([1, 2]) AS copy) c WHERE d <> 0 AND (copy = 1 OR d = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM r),
f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM o),
n AS (SELECT *, bare = '' AS blank, bare = '' OR again AS must, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM f),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank)::BIGINT AS blank,
  count(*) FILTER (WHERE again AND NOT blank)::BIGINT AS duplicate, count(*) FILTER (WHERE extra > 0)::BIGINT AS truncated,
  count(*) FILTER (WHERE k > 1 AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(k) AS n FROM n GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, '000000000' AS z, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a FROM facts
  UNION ALL
  SELECT conv_id, k, z, s, u, {insert('a', 'u')} AS a FROM (
    SELECT conv_id, k, z, s, a, {insert('u', 'z', 's', 'a')} AS u FROM (
      SELECT w.conv_id, n.k, {add('z', 2, 'D')} AS z,
        least({add('s', 2, 'D')}, {read('s', 'z')}) AS s,
        least({add('u', 2, 'D')}, {read('u', 'z', 's', 'a')}) AS u,
        least({add('a', 2, 'D')}, {read('a', 'u')}) AS a
      FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.k = w.k + 1))),
best AS (SELECT f.conv_id, least(w.z, w.a) AS v FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.k = f.n),
letters AS (SELECT conv_id, unnest(string_split(substr(v, 10), '')) AS e, unnest(range(length(v) - 9)) AS i FROM best WHERE length(v) > 9),
steps AS (SELECT *, sum((e <> 'I')::INT) OVER w AS k, sum((e <> 'D')::INT) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
lines AS (SELECT t.*, n.role, n.text, max((t.e = 'K' AND t.place = 1 AND n.initial = 's')::INT) OVER (PARTITION BY t.conv_id) AS system
  FROM steps t LEFT JOIN n ON t.e <> 'I' AND n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.k = t.k WHERE t.e <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(substr(b.v, 1, 9)::BIGINT, 0)::BIGINT AS cost, coalesce(substr(b.v, 10), '') AS audit, sha256(coalesce(x.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _op11_sql()
