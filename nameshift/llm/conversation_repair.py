"""Cheapest repair of damaged conversations by weighted interval parsing.

Method: a repair grammar in Chomsky normal form over spans of rows. A nonterminal ``(p, q)`` is a span whose repaired rows lead
from state ``p`` to state ``q``: nothing yet, after a system row, after a user row, after an assistant row. A row alone gives
the terminals: kept, given another role, deleted. The insertion closure puts the cheapest inserted rows to the left of the
first row and to the right of every row. A binary rule ``(p, q) -> (p, r) (r, q)`` exists for all states, so a span's best cell
is found at any one split of it: cells are combined bottom-up by span length, 1, 2, 4, ... rows, and hold the minimum
of (cost, audit). Two audits of a cell with one cost never begin one with the other (they have a letter for every row and
equally many insertions), so the least of joined audits is the join of the least ones.

Scale: faults are found on rows without text (a digest instead), grouped by content before any shuffle, so a conversation with
a third of all rows is spread. Rows are then dealt by ranges of (conversation, turn), also inside a conversation; each task
parses its stretch, and only conversations at the edge of a task hand on all cells. The hash of a repaired conversation needs
its texts in order: they go to one task sorted on disk and are hashed as they stream by, with one batch in memory.

Defined results: null keys are a conversation of their own. Rows of equal turn are ordered by role and a digest of the text;
null turns come first. A null role or text is one blank. A role that begins with none of ``s u a`` (or an empty one) cannot be
kept. A conversation without rows has zeros, an empty audit and the hash of the empty text. Very long texts are hashed
as they are. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from nameshift.llm.frames import small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a row must have after a state, if it is not a system row.
ROLE_AFTER = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_BLANKS = " \t\n\x0b\f\r"
_LEGAL = {"su", "ua", "au"}

#: A cell holds the cheapest (cost, audit) for each pair of states that a span can have.
Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans together."""
    out: Cell = {}
    by: dict[int, list[tuple[int, tuple[int, str]]]] = {}
    for (r, q), value in right.items():
        by.setdefault(r, []).append((q, value))
    for (p, r), (cost, audit) in left.items():
        for q, (more, rest) in by.get(r, ()):
            found = (cost + more, audit + rest)
            if (best := out.get((p, q))) is None or found < best:
                out[p, q] = found
    return out


def _insertions() -> Cell:
    once: Cell = {(p, p): (0, "") for p in STATES}
    for p in STATES:
        once[p, NEXT[p, ROLE_AFTER[p][0]]] = (INSERT_COST, INSERT)
    closed = combine(once, once)
    while closed != (more := combine(closed, once)):
        closed = more
    return closed


#: The insertion closure: the cell of an empty span.
EMPTY = _insertions()


def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row, without the insertions around it."""
    out: Cell = {(p, p): (DELETE_COST, DELETE) for p in STATES}
    if must_go:
        return out
    extra = TRUNCATED_COST if truncated else 0
    for p in STATES:
        for q, found in ((NEXT.get((p, initial)), (extra, KEEP)), (NEXT[p, ROLE_AFTER[p][0]], (REROLE_COST + extra, REROLE))):
            if q is not None and ((p, q) not in out or found < out[p, q]):
                out[p, q] = found
    return out


_ROWS: dict[tuple[str, bool, bool], Cell] = {(i, g, t): combine(row_cell(i, g, t), EMPTY) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}


def parse(rows: list[tuple[str, bool, bool]]) -> Cell:
    """The cell of a stretch of rows (initial, must go, truncated), insertions to the right of each row included."""
    cells = [_ROWS[initial if initial in ("s", "u", "a") else "", go, cut] for initial, go, cut in rows]
    while len(cells) > 1:
        pairs = [combine(cells[k], cells[k + 1]) for k in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) & ~1 :]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """The best repair of a whole conversation from the cell of its rows."""
    whole = combine(EMPTY, cell)
    return min(whole[START, q] for q in ENDS if (START, q) in whole)


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` after the damage that the hash of key and turn decides on; 0 copies is a dropped row."""
    col = lambda c: F.col(f"`{c}`")
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(col(key).cast("string"), blank), F.lit(":"), F.coalesce(col(turn).cast("string"), blank)).cast("binary")) % 20
    whole, said = F.coalesce(col(text), blank), F.coalesce(col(role), blank)
    return conversations.select(
        col(key).alias("conv_id"),
        col(turn).cast("long").alias("turn"),
        F.when(h == 4, F.lit("user")).otherwise(said).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(whole, ".!?", "")).otherwise(whole).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as they are, in the form of ``damaged``."""
    col = lambda c: F.col(f"`{c}`")
    return conversations.select(col(key).alias("conv_id"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g")


_ORDER = ["known", "turn", "role", "digest"]


def _keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"known": F.col("turn").isNotNull(), "digest": F.unhex(F.sha2("text", 256))})


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation: how often (``n``), whether blank or truncated, and whether the first was ``seen`` before."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(_BLANKS)), F.lit(1))
    light = _keys(rows.where("copies > 0")).select(_group(), *_ORDER, "copies", (tail == "").alias("blank"), (~tail.isin("", ".", "!", "?")).alias("cut"))
    kinds = light.groupBy("g", *_ORDER, "blank", "cut").agg(F.sum("copies").alias("n"))
    first = kinds.groupBy("g", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("first"))
    return kinds.join(first, ["g", "role", "digest"]).withColumn("seen", ~F.struct("known", "turn").eqNullSafe(F.col("first"))).drop("first")


_COUNTS = ["turns", "low", "high", "blank", "duplicate", "truncated", "illegal"]
_SEGMENT = "g string, known boolean, turn long, role string, digest binary, first_initial string, last_initial string, first_turn long, last_turn long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", p array<int>, q array<int>, cost array<long>, audit array<string>"


def _segment(g: str, cols: dict[str, list], a: int, b: int, whole: bool) -> dict:
    """Figures and cells of rows ``a`` to ``b``; of a conversation that lies in them as a whole, only its best repair."""
    rows: list[tuple[str, bool, bool]] = []
    blank = duplicate = truncated = 0
    for k in range(a, b):
        n, initial = cols["n"][k], cols["role"][k][:1]
        if cols["blank"][k]:
            blank += n
            rows += [(initial, True, False)] * n
            continue
        again = n if cols["seen"][k] else n - 1
        if again < n:
            truncated += cols["cut"][k]
            rows.append((initial, False, cols["cut"][k]))
        duplicate += again
        rows += [(initial, True, False)] * again
    initials = [r[0] for r in rows]
    turns = [t for t in cols["turn"][a:b] if t is not None]
    cell = parse(rows)
    items = [((START, START), cheapest(cell))] if whole else list(cell.items())
    return {
        "g": g,
        **{c: cols[c][a] for c in _ORDER},
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "blank": blank,
        "duplicate": duplicate,
        "truncated": truncated,
        "illegal": sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False)),
        "p": [p for (p, _), _ in items],
        "q": [q for (_, q), _ in items],
        "cost": [c for _, (c, _) in items],
        "audit": [s for _, (_, s) in items],
    }


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


#: A task parses a long conversation in stretches of so many distinct rows.
STRETCH = 1 << 16


def segments(kinds: DataFrame) -> DataFrame:
    """Stretches of conversations, each parsed. One that is a whole conversation has a single cell with p = q = 0 and no more to come."""
    dealt = kinds.repartitionByRange("g", *_ORDER).sortWithinPartitions("g", *_ORDER)
    schema = _arrow(_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] | None = None
        first = True

        def pieces(cols: dict[str, list], last: bool) -> Iterator[dict]:
            nonlocal first
            g = cols["g"]
            bounds = [0, *[k for k in range(1, len(g)) if g[k] != g[k - 1]], len(g)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b == len(g) and not last and b - a < STRETCH:
                    break
                yield _segment(g[a], cols, a, b, whole=not first and b < len(g))
                first = b == len(g) and not last  # the rest of this conversation is no whole one either
                done[0] = b

        for batch in batches:
            new = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            held = {c: held[c] + new[c] for c in new} if held else new
            if not held["g"]:
                continue
            done = [0]
            out = list(pieces(held, False))
            held = {c: v[done[0] :] for c, v in held.items()}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held and held["g"]:
            done = [0]
            yield pa.RecordBatch.from_pylist(list(pieces(held, True)), schema=schema)

    return small_batches(dealt.select("g", *_ORDER, "n", "blank", "cut", "seen")).mapInArrow(run, _SEGMENT)


_VERDICT = "g string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _verdict(parts: list[dict]) -> dict:
    """One conversation's figures from its stretches in order."""
    spans = [p for p in parts if p["low"] is not None]
    turns = sum(p["turns"] for p in spans) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(spans, spans[1:], strict=False))
    cells = [dict(zip(zip(p["p"], p["q"], strict=True), zip(p["cost"], p["audit"], strict=True), strict=True)) for p in parts]
    if len(cells) == 1 and len(cells[0]) == 1:
        cost, audit = cells[0][START, START]
    else:
        while len(cells) > 1:
            cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
        cost, audit = cheapest(cells[0])
    return {
        "g": parts[0]["g"],
        "gaps": spans[-1]["high"] - spans[0]["low"] + 1 - turns if spans else 0,
        **{c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")},
        "illegal": sum(p["illegal"] for p in parts) + sum(x["last_initial"] + y["first_initial"] not in _LEGAL for x, y in zip(parts, parts[1:], strict=False)),
        "cost": cost,
        "audit": audit,
    }


def verdicts(parsed: DataFrame) -> DataFrame:
    """Cost, audit and counts of every conversation with rows; a conversation has at most a few stretches per task."""
    dealt = parsed.repartition("g").sortWithinPartitions("g", *_ORDER)
    schema = _arrow(_VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if parts and parts[0]["g"] != row["g"]:
                    out.append(_verdict(parts))
                    parts = []
                parts.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if parts:
            yield pa.RecordBatch.from_pylist([_verdict(parts)], schema=schema)

    return small_batches(dealt).mapInArrow(run, _VERDICT)


class Repair:
    """Follows an audit row by row and yields the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            yield self._out(ROLE_AFTER[self.state]), ""
            self.at += 1

    def _out(self, role: str) -> str:
        self.state = NEXT[self.state, role[:1]]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP:
            yield self._out(role), text
        elif letter == REROLE:
            yield self._out(ROLE_AFTER[self.state]), text


def repaired_rows(rows: DataFrame, found: DataFrame, make, schema: str) -> DataFrame:
    """Streams every conversation's rows in order behind its verdict through ``make()``: ``begin(head, key)``, ``row``, ``end``."""
    heads = found.select("g", F.lit(0).alias("o"), F.struct(*[c for c in found.columns if c != "g"]).alias("head"))
    lines = _keys(rows).select(_group(), F.lit(1).alias("o"), *_ORDER, "conv_id", "copies", F.when(F.col("copies") > 0, F.col("text")).alias("text"))
    dealt = heads.unionByName(lines, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", "o", *_ORDER)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, g, started = make(), None, False
        for batch in batches:
            out: list[dict] = []
            for group, o, head, role, text, copies, key in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if not started or group != g:
                    if started:
                        out += sink.end()
                    sink.begin(head)
                    g, started = group, True
                if o:
                    out += sink.row(key, role, text, copies)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if started and (out := list(sink.end())):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return small_batches(dealt.select("g", "o", "head", "role", "text", "copies", "conv_id")).mapInArrow(run, schema)


class _Digests:
    """Verdict and running hash of a conversation."""

    def begin(self, head: dict | None) -> None:
        self.head = head or {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
        self.repair, self.sum, self.any, self.key = Repair(self.head["audit"]), hashlib.sha256(), False, None

    def _add(self, lines: Iterator[tuple[str, str]]) -> None:
        for role, text in lines:
            if self.any:
                self.sum.update(b"\n")
            self.any = True
            self.sum.update(role.encode())
            self.sum.update(b":")
            self.sum.update(text.encode())

    def row(self, key, role: str, text: str | None, copies: int) -> Iterator[dict]:
        self.key = key
        for _ in range(copies):
            self._add(self.repair.row(role, text))
        return iter(())

    def end(self) -> Iterator[dict]:
        self._add(self.repair.inserted())
        yield {"conv_id": self.key, **self.head, "repaired_sha256": self.sum.hexdigest()}


class _Rows:
    """The repaired rows themselves, numbered from 0."""

    def begin(self, head: dict | None) -> None:
        self.repair, self.n, self.key = Repair(head["audit"] if head else ""), 0, None

    def _rows(self, lines: Iterator[tuple[str, str]]) -> Iterator[dict]:
        for role, text in lines:
            yield {"conv_id": self.key, "turn": self.n, "role": role, "text": text}
            self.n += 1

    def row(self, key, role: str, text: str | None, copies: int) -> Iterator[dict]:
        self.key = key
        for _ in range(copies):
            yield from self._rows(self.repair.row(role, text))

    def end(self) -> Iterator[dict]:
        yield from self._rows(self.repair.inserted())


def _key_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def repair_report(rows: DataFrame) -> DataFrame:
    """``conv_id``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` of every conversation of ``damaged`` or ``undamaged`` rows."""
    schema = f"conv_id {_key_type(rows)}, " + _VERDICT.removeprefix("g string, ") + ", repaired_sha256 string"
    return repaired_rows(rows, verdicts(segments(faults(rows))), _Digests, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of every conversation as repaired, turns from 0 on."""
    return repaired_rows(rows, verdicts(segments(faults(rows))), _Rows, f"conv_id {_key_type(rows)}, turn long, role string, text string")


#: The report over damaged ``conversations``: rows from left to right, a cell for each state that the rows so far can lead to.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in string_split(k, '')]), lambda c, b: xor(crc[xor(c, b) % 256 + 1], c // 256))) % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations), t),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(2) c(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
n AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM d),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, said = '' AS blank, said <> '' AND seen AS duplicate, said <> '' AND NOT seen AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
         i > 1 AND lag(role[1]) OVER w || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
e(p, q, cost, audit, made) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', 'u'), (1, 2, 3, 'I', 'u'), (2, 3, 3, 'I', 'a'), (3, 2, 3, 'I', 'u'),
         (0, 3, 6, 'II', 'ua'), (1, 3, 6, 'II', 'ua'), (2, 2, 6, 'II', 'au'), (3, 3, 6, 'II', 'ua')),
k(p, q, role) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
g AS (
  SELECT conv_id, i, p, q, 3 * truncated::INT AS cost, 'K' AS letter, k.role AS made FROM f JOIN k ON f.role[1] = k.role WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, i, p, q, 3 + 3 * truncated::INT, 'R', k.role FROM f, k WHERE k.role <> 's' AND NOT blank AND NOT duplicate
  UNION ALL SELECT conv_id, i, p, p, 4, 'D', '-' FROM f, range(4) r(p)),
c AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT c.conv_id, c.i + 1, g.q, min({'cost': c.best.cost + e.cost + g.cost, 'audit': c.best.audit || e.audit || g.letter, 'made': c.best.made || e.made || g.made})
  FROM c JOIN e ON e.p = c.q JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = c.i + 1 AND g.p = e.q
  GROUP BY c.conv_id, c.i, g.q),
s AS (
  SELECT x.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(i) AS rows, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id GROUP BY x.conv_id),
b AS (
  SELECT s.*, (SELECT min({'cost': c.best.cost + e.cost, 'audit': c.best.audit || e.audit, 'made': c.best.made || e.made})
               FROM c JOIN e ON e.p = c.q WHERE c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.i = s.rows AND e.q IN (0, 3)) AS best
  FROM s),
l AS (
  SELECT conv_id, j, best.audit[j] AS letter, best.made[j] AS made, length(replace(left(best.audit, j), 'I', '')) AS i
  FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS j FROM b)),
r AS (
  SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN l.made = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j) AS whole
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND letter <> 'I' WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id
"""
