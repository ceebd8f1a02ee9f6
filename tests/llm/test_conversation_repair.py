import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def fault(role, text, seen):
    chars = re.findall(r"[^\x20\x09-\x0D]", text)
    return "b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else ""


def cheapest(turns):
    """All edits by a plain table over places and roles: the least (cost, audit) with the turns it makes."""
    table = {"": (0, "", [])}  # the initials made so far, as their last role and whether a system turn leads

    def offer(new, key, cost, audit, made):
        if key not in new or (cost, audit) < new[key][:2]:
            new[key] = (cost, audit, made)

    def following(key):
        return "a" if key.endswith("u") else "u"

    def insert(now):
        for _ in range(2):
            new = dict(now)
            for key, (c, a, m) in now.items():
                x = following(key)
                offer(new, x, c + 5, a + "I", [*m, (R.ROLES[x], "")])
            now = new
        return now

    for role, text, bad in turns:
        new = {}
        extra = 5 if bad == "t" else 0
        for key, (c, a, m) in insert(table).items():
            offer(new, key, c + 2, a + "D", m)
            if bad in ("b", "d"):
                continue
            x = following(key)
            offer(new, x, c + 1 + extra, a + "R", [*m, (R.ROLES[x], text)])
            if role[:1] == x or (key == "" and role[:1] == "s"):
                offer(new, role[:1], c + extra, a + "K", [*m, (role, text)])
        table = new
    return min(v for k, v in insert(table).items() if k in ("", "a"))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in damaged(rows) if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        marked, seen = [], set()
        for _, role, text in turns:
            marked.append((role, text, fault(role, text, seen)))
            seen.add((role, text))
        cost, audit, made = cheapest(marked)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        count = [sum(b == x for _, _, b in marked) for x in "bdt"]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (conv, gaps, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


def conversations(rng, n, longest):
    texts = ["Yes.", "no", "", "  \n", "What?", "It is!  ", "cut off", "Fine.", "é", "a.b"]
    rows = []
    for c in range(n):
        turn = 0
        for k in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 0, 3])
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            rows.append((c, None if rng.random() < 0.05 else turn, role, None if rng.random() < 0.05 else rng.choice(texts) + rng.choice(["", f" {k}."])))
    return rows


def test_equals_brute_force(spark):
    rows = conversations(random.Random(1), 150, 9)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (None, None, None, None)]
    rows += rows[:40]  # repeated rows
    assert got(R.report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


@pytest.mark.parametrize("chunk", [2, 3])
def test_long_conversations_are_joined_from_chunks(spark, chunk):
    """Chunks, and chunks of chunks, give what one agenda gives."""
    rows = conversations(random.Random(2), 12, 40)
    assert got(R.report(spark.createDataFrame(rows, SCHEMA), chunk=chunk)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C."), (2, 0, "system", "S."), (3, 0, "user", "U.")]
    summary, turns = R.repair(spark.createDataFrame(rows, SCHEMA))
    made = {}
    for r in turns.orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append((r.place, r.turn, r.role, r.text, r.edit))
    audit = {r.conv_id: (r.cost, r.audit) for r in summary.collect()}
    assert audit == {1: (3, "DKR"), 2: (2, "D"), 3: (2, "D")}
    assert made == {1: [(0, 1, "user", "B.", "K"), (1, 2, "assistant", "C.", "R")]}


def test_agenda_equals_every_edit():
    """The lightest derivation among all edit sequences of short conversations."""
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice("suax "), rng.choice(["", "", "b", "d", "t"])) for _ in range(rng.randrange(0, 5))]
        found = R.lightest([R.edits(x, f) for x, f in turns], "0", R.complete)
        (weight,) = found.values()
        best = []
        for n in range(len(turns) + 1 + 2 + 1):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in audit) != len(turns):
                    continue
                k, cost, states = 0, 0, {"0"}
                for e in audit:
                    if e == "I":
                        cost, states = cost + 5, {R.NEXT[s] for s in states}
                        continue
                    x, f = turns[k]
                    k += 1
                    if e == "D":
                        cost += 2
                        continue
                    cost += (1 if e == "R" else 0) + (5 if f == "t" else 0)
                    after = set()
                    for s in states:
                        if f in ("b", "d"):
                            continue
                        if e == "R" or x == R.NEXT[s]:
                            after.add(R.NEXT[s])
                        if e == "K" and s == "0" and x == "s":
                            after.add("s")
                    states = after
                if states & {"0", "a"}:
                    best.append((cost, "".join(audit)))
        assert weight == min(best), turns


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(R.report(none)) == {}
    rows = conversations(random.Random(5), 5, 6) + [(9, 1, "user", "w " * 50_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("at", "chunk", "fault", "key", "audit", "place", "cost", "n", "first"):
        df = df.withColumn(c, F.lit("extra"))
    assert got(R.report(df)) == brute(rows)
