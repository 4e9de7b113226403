import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from pagelens.llm import conversation_repair as cr

GOOD = re.compile(r"(s?(ua)+)?")


def brute_edits(initials, faults):
    """All scripts of up to two insertions between rows, tried one by one."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["D"] if f in (1, 2) else ["D", "K", "Ru", "Ra"] for f in faults]
    for gaps in product(inserts, repeat=len(initials) + 1):
        if sum(map(len, gaps)) > 3:
            continue
        for edits in product(*choices):
            roles, script, cost = "", "", 0
            for i, edit in enumerate([*edits, ""]):
                roles, script, cost = roles + gaps[i], script + "I" * len(gaps[i]), cost + 2 * len(gaps[i])
                if edit:
                    roles += {"D": "", "K": initials[i] if edit == "K" else ""}.get(edit, edit[1:])
                    script, cost = script + edit[0], cost + {"D": 3, "K": 0, "R": 2}[edit[0]] + (edit != "D" and faults[i] == 3)
            if GOOD.fullmatch(roles) and (best is None or (cost, script) < best):
                best = cost, script
    return best


def test_edits_equal_all_scripts():
    rng = random.Random(4)
    for n in range(5):
        for _ in range(40 if n else 1):
            initials, faults = [rng.choice("suax") for _ in range(n)], [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
            codes = bytes("xsua".index(x) + 4 * f for x, f in zip(initials, faults, strict=True))
            cost, edits = cr.cheapest_edits(codes)
            assert (cost, re.sub("[ua]", "", "".join(edits))) == brute_edits(initials, faults), (initials, faults)


def report(rows, ids):
    """A plain solution: costs from the end, all of them kept."""
    nxt = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    out = {}
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        faults, seen = [], set()
        for _, _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        n, inf = len(own), 10**9
        best = [{} for _ in range(n + 1)]
        for i in range(n, -1, -1):
            here = {s: (0, "", []) if i == n and s in ("", "a") else (inf, "", []) for s in nxt}
            for s in nxt:
                if i < n:
                    c, a, lines = best[i + 1][s]
                    options = [(3 + c, "D" + a, lines)]
                    _, _, role, text = own[i]
                    if faults[i] in ("", "truncated"):
                        for t, letter, name in [(role[:1], "K", role), ("u", "R", "user"), ("a", "R", "assistant")]:
                            if t in nxt[s] and t:
                                c, a, lines = best[i + 1][nxt[s][t]]
                                options.append((c + 2 * (letter == "R") + (faults[i] == "truncated"), letter + a, [f"{name}:{text}", *lines]))
                    here[s] = min(options, key=lambda x: x[:2])
            for _ in range(3):
                for s in nxt:
                    for t, name in (("u", "user:"), ("a", "assistant:")):
                        if t in nxt[s]:
                            c, a, lines = here[nxt[s][t]]
                            here[s] = min(here[s], (c + 2, "I" + a, [name, *lines]), key=lambda x: x[:2])
            best[i] = here
        cost, audit, lines = best[0][""]
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, min(gaps, 2**63 - 1), *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 12)):
            role = rng.choice(["system"] if turn == 0 and rng.random() < 0.4 else ["user", "assistant"] * 4 + ["tool", "", None, "Sys", "system"])
            text = rng.choice(["Yes.", "No!", "open", "", " \x0b\n", None, "Ends. \n", f"{turn} é日?", "'\"\\:", f"more {turn}."])
            rows.append((rng.choice((conv, conv, None, -conv)), rng.choice((turn, turn, turn, turn, None, turn * 3)), role, text))
    rows += [(500, i, ("user", "assistant")[rng.random() < 0.5], rng.choice((f"line {i}.", "same.", "cut"))) for i in range(9000)]  # several pieces
    rows += [(501, 2**63 - 1, "user", "x" * 100_000 + "."), (501, -(2**63), "assistant", "y."), (502, 1, "assistant", "a."), *[(503, 4, "user", "again.")] * 50]
    return rows


def test_report_equals_brute_force(spark, turns):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    for c in ("place", "block", "code", "conv", "a.b", "digest"):
        frame = frame.withColumn(c, F.lit("x"))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    want = report(plain, {r[0] for r in turns})
    got = {r.conv_id: tuple(r) for r in cr.repair_report(frame, frame).collect()}
    assert got == want
    assert any(w[6] > 100 for w in want.values()) and got[502][7] == "IK" and got[503][2:4] == (0, 49)
    lines = {}
    for r in sorted(cr.repair_turns(frame).collect(), key=lambda r: (r.place, r.nth)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert (r.edit == "I") == (r.text == "" and r.turn is None and r.role in ("user", "assistant")) or r.turn is None
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: w[8] for c, w in want.items() if c in lines}


def test_damage(spark, turns):
    given = turns[:400] + [(9, None, None, None), (None, 3, "user", "A. B? C!")] * 2
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(3)
    want = []
    for conv, turn, role, text in given:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(tuple, cr.damaged(frame).collect()), key=str) == sorted(want, key=str)


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_report(none, none).count() == 0
    only = spark.createDataFrame([(4, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in cr.repair_report(none, only).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
