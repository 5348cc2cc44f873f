"""Conversation repair against exhaustive search and against a plain reading of its rules."""

import functools
import hashlib
import random
import re
import zlib

from cytoloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, size int, alive string, fault int, step int"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def cheapest(rows):
    """(cost, audit) by trying every edit; ``rows`` are (initial, fault)."""

    @functools.lru_cache(None)
    def go(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        needed = "a" if last == "u" else "u"
        step = lambda cost, edit, rest: found.append((rest[0] + cost, edit + rest[1])) if rest else None
        if inserted < 4:
            step(2, "I", go(i, needed, inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            step(3, "D", go(i + 1, last, 0))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                if initial == needed or (last == "" and initial == "s"):
                    step(extra, "K", go(i + 1, initial, 0))
                step(2 + extra, "R", go(i + 1, needed, 0))
        return min(found) if found else None

    return go(0, "", 0)


def script(rows):
    work, out = conversations.Repair(), []
    for i, (initial, fault) in enumerate(rows):
        out += work.read((i, initial, "text", fault), initial, fault)
    return out + list(work.finish())


def test_scripts_are_cheapest_and_least():
    rng = random.Random(11)
    for _ in range(3000):
        rows = tuple(
            (rng.choice(["s", "u", "a", "u", "a", "", "x"]), rng.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for _ in range(rng.randint(0, 9))
        )
        edits = script(rows)
        audit = "".join(e[0] for e in edits)
        cost = sum(COST[e[0]] + (e[0] in "KR" and e[3][3] == "truncated") for e in edits)
        assert (cost, audit) == cheapest(rows), rows
        assert LEGAL.match("".join(e[1][:1] for e in edits if e[0] != "D"))
        assert [e[3][0] for e in edits if e[3]] == list(range(len(rows)))


def test_edits_leave_memory_while_reading():
    rng = random.Random(2)
    for pattern, most in (("ua", 1), ("uau", 4), ("noise", 60)):
        work, done = conversations.Repair(), 0
        for i in range(20_000):
            initial = rng.choice("uas") if pattern == "noise" else pattern[i % len(pattern)]
            done += sum(1 for e in work.read((i, initial, "t", None), initial, None) if e[0] != "I")
            assert i + 1 - done <= most


def plain(rows):
    """The whole contract in plain Python: rows are (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in rows:
        at = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind in (0, 1) else re.sub("[.!?]", "", text) if kind == 2 else text
        at += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = set()
    for conv, at in kept.items():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in at:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            again = (role, text) in seen
            seen.add((role, text))
            faults.append("blank" if not solid else "duplicate" if again else None if solid[-1] in ".!?" else "truncated")
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(at, faults)))
        left, body, last = iter(at), [], ""
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(left)[1:]
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            body.append(f"{role}:{text}")
        turns = [r[0] for r in at if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(at, at[1:]))
        counts = [faults.count(name) for name in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()))
    return out


def awkward():
    rng = random.Random(7)
    texts = [None, "", " \t\n", "Yes.", "No!", "cut off", "end. ", "end.\n", "x" * 9000 + ".", "ünïcode…", "Hm?"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    rows = []
    for conv in range(60):
        rows += [(conv, t, rng.choice(roles[:5]), rng.choice(texts[3:]) + f" {t}." * rng.randint(0, 1)) for t in range(rng.randint(1, 9))]
    rows += [(100 + i % 7, rng.choice([None, 1, 2, 2, 9]), rng.choice(roles), rng.choice(texts)) for i in range(80)]
    rows += [(None, i % 5, rng.choice(roles), rng.choice(texts)) for i in range(20)]
    rows += [(200, 3, "user", "Same.")] * 30
    rows += [(300, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(2500)]
    return rows


def test_whole_contract(spark):
    # The exhaustive search recurses once per row: the long conversation is checked by its own properties below.
    rows = [r for r in awkward() if r[0] != 300]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    got = conversations.summaries(conversations.repair(conversations.damage(docs)))
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert got.count() == len({r[0] for r in rows})


def test_long_conversation_and_order(spark):
    rows = [r for r in awkward() if r[0] == 300]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    steps = conversations.repair(docs.drop("alive")).orderBy("step").collect()
    assert [r["turn"] for r in steps if r["edit"] != "I"] == list(range(2500))
    assert LEGAL.match("".join(r["role"][:1] for r in steps if r["edit"] != "D"))
    assert [r["step"] for r in steps] == list(range(len(steps)))


def test_empty_table(spark):
    empty = conversations.summaries(conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))))
    assert empty.collect() == []
