"""Conversation repair against the enumeration of all repairs, and over awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

from nameshift.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """The cheapest repair of (role, must go, truncated) rows among all edits, with up to three insertions in a row."""
    best = None
    gaps = [[(), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "a", "u")]] * (len(rows) + 1)
    choices = [["D"] if go else ["D", "K", "u", "a"] for _, go, _ in rows]
    for edits in itertools.product(*choices):
        for gap in itertools.product(*gaps):
            cost, audit, made = 0, "", ""
            for k in range(len(rows) + 1):
                cost += 3 * len(gap[k])
                audit += "I" * len(gap[k])
                made += "".join(gap[k])
                if k < len(rows):
                    role, _, cut = rows[k]
                    edit = edits[k]
                    cost += {"D": 4, "K": 0}.get(edit, 3) + (3 if cut and edit != "D" else 0)
                    audit += {"D": "D", "K": "K"}.get(edit, "R")
                    made += {"D": "", "K": role[:1]}.get(edit, edit)
            if LEGAL.fullmatch(made) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_parsing_finds_the_cheapest_repair():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(1, 3))]
        assert cr.cheapest(cr.parse([(r[:1], g, c) for r, g, c in rows])) == enumerated(rows)


def test_any_split_gives_the_same_cell():
    rng = random.Random(4)
    rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(40)]
    whole = cr.parse(rows)
    for k in (1, 13, 39):
        assert cr.combine(cr.parse(rows[:k]), cr.parse(rows[k:])) == whole


def plain(rows, conv):
    """The report of one conversation, row by row; the cheapest repair from left to right."""
    lines = []
    for c, turn, role, text in rows:
        if c != conv:
            continue
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        lines += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
    seen, flags, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in lines:
        said = text.rstrip(" \t\n\x0b\f\r")
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if kind:
            count[kind] += 1
        flags.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
    turns = {t for t, _, _ in lines if t is not None}
    illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(flags, flags[1:]))
    states = {0: (0, "", [])}
    close = lambda s: {q: min([(c + k, a + "I" * (k // 3), o + ["user:" if p != 2 else "assistant:", "user:" if p == 2 else "assistant:"][: k // 3]) for p, (c, a, o) in s.items() for (pp, q2), (k, _) in cr.EMPTY.items() if pp == p and q2 == q], key=lambda x: x[:2]) for q in {q2 for (p, q2) in cr.EMPTY if p in s}}
    states = close(states)
    for (_, role, text), (initial, go, cut) in zip(lines, flags):
        new = {}
        for p, (c, a, o) in states.items():
            options = [(p, c + 4, a + "D", o)]
            if not go:
                if (p, initial) in cr.NEXT:
                    options.append((cr.NEXT[p, initial], c + 3 * cut, a + "K", [*o, f"{role}:{text}"]))
                other = cr.ROLE_AFTER[p]
                options.append((cr.NEXT[p, other[0]], c + 3 + 3 * cut, a + "R", [*o, f"{other}:{text}"]))
            for q, *found in options:
                if q not in new or tuple(found[:2]) < new[q][:2]:
                    new[q] = tuple(found)
        states = close(new)
    cost, audit, out = min((states[q] for q in (0, 3) if q in states), key=lambda x: x[:2])
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


def rows_of(rng, convs, most):
    out = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No", "", " \t", None, "A question?", f"Said {turn}!", "x" * 3000 + "."])
            out.append((conv, rng.choice([None, turn, turn, turn, turn + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), text))
    return out


def test_report_equals_row_by_row_repair(spark, monkeypatch):
    rng = random.Random(5)
    rows = rows_of(rng, 40, 9) + [(77, k, rng.choice(["user", "assistant"]), f"turn {k % 150}.") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted((plain(rows, c) for c in {r[0] for r in rows}), key=str)
    monkeypatch.setattr(cr, "STRETCH", 16)
    got = cr.repair_report(cr.damaged(df.withColumn("g", cr.F.lit(1)).withColumn("copies", cr.F.lit(9)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_repaired_rows_are_legal_and_undamaged_ones_stay(spark):
    rng = random.Random(6)
    df = spark.createDataFrame(rows_of(rng, 20, 6), SCHEMA)
    found = {}
    for r in cr.repaired(cr.damaged(df)).collect():
        found.setdefault(r.conv_id, []).append((r.turn, r.role[0]))
    assert found and all(LEGAL.fullmatch("".join(i for _, i in sorted(v))) for v in found.values())
    good = spark.createDataFrame([(1, 0, "user", "Hello?"), (1, 1, "assistant", "Hello.")], SCHEMA)
    assert sorted(map(tuple, cr.repaired(cr.undamaged(good)).collect())) == sorted(map(tuple, good.collect()))


def test_empty_table(spark):
    assert cr.repair_report(cr.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
