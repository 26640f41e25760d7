"""Repairs against a search over all audits, and against the same rules in a plain loop."""

import itertools
import random
import zlib

from pyspark.sql import functions as F

from plumbline.llm import conversation_repair as cr
from tests.llm import fixtures as fx

SCHEMA = "conv_id long, turn long, role string, text string, conv string, fault string, present string, kind int"
BLANKS = " \t\n\x0b\x0c\r"


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(BLANKS)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def _legal(initials):
    rest = initials[1:] if initials[:1] == "s" and len(initials) > 1 else initials
    return rest == "ua" * (len(rest) // 2)


def _cheapest(rows, faults, most=None):
    """All repairs of a short conversation: (cost, audit, turns), the least."""
    best = None
    most = len(rows) + 2 if most is None else most

    def go(i, cost, audit, turns):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            made = "".join(t[0][:1] or "?" for t in turns)
            if _legal(made) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
        if len(turns) < 2 * most and audit[-2:] != "II":
            for name in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*turns, (name, "")])
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", turns)
            if faults[i] in (0, 3):
                more = int(faults[i] == 3)
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)])
                for name in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*turns, (name, text)])

    # an upper bound to cut the search: delete everything
    best = (3 * len(rows), "D" * len(rows), [])
    go(0, 0, "", [])
    return best


def _plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = _damage([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = _faults(mine)
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip((r[2][:1] for r in mine), (r[2][:1] for r in mine[1:]))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, kept = _cheapest(mine, faults)
        digest = fx.sha("\n".join(f"{a}:{b}" for a, b in kept).encode())
        out.append((conv, gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, digest))
    return fx.order(out)


def _rows(seed, n, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "uploader"]
    texts = ["Yes.", "No!", "cut off", "Why?  \n", " \t", "", None, "ü.", "Yes. "]
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 9]), role, draw.choice(texts)))
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (None, 1, "user", "Hm.")]
    rows += [(-5, 2, "assistant", "So."), (-5, 2, "assistant", "So."), (-5, 2, "user", "So.")]
    return rows


def _run(spark, rows, tmp_path):
    wide = [(*r, "c", "f", "p", 1) for r in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(r) for r in cr.op13_conversation_repair(spark, str(tmp_path)).collect()]


def test_against_all_repairs(spark, tmp_path):
    rows = _rows(1, 60, 5)
    got = fx.order(_run(spark, rows, tmp_path))
    assert got == _plain(rows)


def test_empty_table_and_dropped_conversations(spark, tmp_path):
    assert _run(spark, [], tmp_path / "a") == []
    gone = [(c, 0, "user", "Gone.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    for row in _run(spark, gone, tmp_path / "b"):
        assert row[1:] == (0, 0, 0, 0, 0, 0, "", fx.sha(b""))


def test_a_very_long_conversation_in_small_batches(spark):
    """Costs and audits of 6,000 turns equal those of a table of all tops with whole audits."""
    draw = random.Random(9)
    roles = ["user", "assistant", "system"]
    rows = [(1, t, draw.choice(roles[:2]) if draw.random() < 0.98 else "system", f"t{t}" + draw.choice([".", ""])) for t in range(6000)]
    found = cr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).first()
    assert (found.cost, found.audit) == _all_tops(rows, _faults(rows))
    assert found.gaps == 0 and found.truncated == sum(not r[3].endswith(".") for r in rows)


def _all_tops(rows, faults):
    """The same grammar as a plain automaton: nothing, system, user, assistant."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def open_(tops):
        out = dict(tops)
        for _ in range(2):
            for at, (cost, told) in list(out.items()):
                for i in "ua":
                    if (at, i) in step:
                        to, way = step[at, i], (cost + 2, told + "I")
                        out[to] = min(out.get(to, way), way)
        return out

    tops = {0: (0, "")}
    for row, fault in zip(rows, faults):
        made = {}
        for at, (cost, told) in open_(tops).items():
            ways = [(at, cost + 3, told + "D")]
            if fault in (0, 3):
                more = int(fault == 3)
                ways += [(step[at, i], cost + 2 + more, told + "R") for i in "ua" if (at, i) in step]
                ways += [(step[at, row[2][:1]], cost + more, told + "K")] if (at, row[2][:1]) in step else []
            for to, c, t in ways:
                made[to] = min(made.get(to, (c, t)), (c, t))
        tops = made
    return min(way for at, way in open_(tops).items() if at in (0, 3))


def test_grammar():
    for n in range(6):
        for initials in itertools.product("sua", repeat=n):
            stack = (cr.START,)
            for i in initials:
                stack = stack and cr.advance(stack, i)
            made = "".join(initials)
            assert bool(stack and stack[-1] in cr.ACCEPT) == _legal(made), made


def test_present_keeps_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "A."), (2, 0, "user", "B.")], "conv_id int, turn long, role string, text string")
    found = cr.repair_conversations(df, present=F.col("conv_id") == 1).orderBy("conv_id").collect()
    assert [(r.conv_id, r.cost, r.audit) for r in found] == [(1, 2, "KI"), (2, 0, "")]
