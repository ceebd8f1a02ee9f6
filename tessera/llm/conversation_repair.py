"""Operator 11: conversation structure repair by Knuth's lightest derivations.

A repaired conversation is empty or has an optional system turn and then pairs of a
user and an assistant turn.  The edits that lead there are deductions of a weighted
hypergraph: an item (i, k, p, q) says that turns i to k can be edited so that the
grammar goes from state p to state q; an item and an edit of the turn behind it (or
an item and the items of the chunk behind it) yield a longer item.  Its weight is
(cost, audit), the audit being the initials of the edits in order.  An agenda pops
items by (cost, turns read, audit): a deduction adds cost or reads a turn, so what is
popped is final, and the goal's weight is final when the goal is popped.  Derivations
of an item that cost the same never begin one another (an inserted turn costs, and
all else reads a turn), so the least audit of a whole is made of least parts.

A conversation of any length is cut into chunks of ``CHUNK`` turns, whose items are
found by many tasks; the items of up to ``CHUNK`` chunks are then the edits of the
next round, until one remains.  The audit of the whole goes back to the chunks, which
write the repaired turns.

Turns are read in the order of turn (nulls first), role and text.  A turn's first
fault counts: blank (white space alone), duplicate (an earlier turn has its role and
text), truncated (its last character but white space is not one of ``.!?``).  Null
roles and texts count as one space; a null conversation id is a conversation.  A conversation
without turns left gives zeros and an empty audit.  Texts of any length are compared
by 128 bits.  Rows that repeat are duplicates.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dense_position, materialise

#: Turns of a chunk, and chunks that are joined at a time.
CHUNK = 256
#: What the edits cost, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, and the initial of the last role.
STATES = "0sua"
#: The role that may follow: state -> (role's initial, state behind it).
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}

Arc = tuple[str, int, str]  # state behind, cost, audit
Arcs = dict[str, list[Arc]]


def edits(initial: str, fault: str) -> Arcs:
    """What may be done with one turn, by the state before it."""
    extra = TRUNCATED if fault == "t" else 0
    arcs: Arcs = {}
    for p in STATES:
        arcs[p] = [(p, DELETE, "D")]
        if fault in ("b", "d"):
            continue
        q = NEXT[p]
        arcs[p].append((q, REROLE + extra, "R"))
        if initial == q or (p == "0" and initial == "s"):
            arcs[p].append((initial, KEEP + extra, "K"))
    return arcs


def lightest(steps: list[Arcs], start: str, goals: Callable[[str], bool] | None = None, insert: bool = True) -> dict[str, tuple[int, str]]:
    """The final weights of the items that read all ``steps`` from ``start``, by end
    state; with ``goals`` the agenda ends at the first that is one."""
    n, done, out = len(steps), set(), {}
    agenda = [(0, 0, "", start)]
    while agenda:
        cost, i, audit, p = heappop(agenda)
        if (i, p) in done:
            continue
        done.add((i, p))
        if i == n:
            if goals is None or goals(p):
                out[p] = (cost, audit)
                if goals is not None or len(out) == len(STATES):
                    break
        else:
            for q, c, a in steps[i].get(p, ()):
                if (i + 1, q) not in done:
                    heappush(agenda, (cost + c, i + 1, audit + a, q))
        if insert and (i, NEXT[p]) not in done:
            heappush(agenda, (cost + INSERT, i, audit + "I", NEXT[p]))
    return out


def complete(state: str) -> bool:
    return state in "0a"


def damage(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text) with every row's damage by crc32(``conv_id:turn``) % 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn))) % 20
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("__kind")).filter("__kind <> 0")
    text_ = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"),
                        F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
            .drop("__copy"))


def faults(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``at`` (place in the conversation),
    ``chunk`` and ``fault`` (b, d, t or empty), as a written table."""
    placed = dense_position(turns, ["conv_id"], ["turn", "role", "text"], "at", "repair-order")
    rows = materialise(placed.withColumn("chunk", F.floor(F.col("at") / chunk)).withColumn("key", F.md5(F.concat_ws(":", F.length("role"), "role", "text"))), "repair-turns")
    first = rows.groupBy("conv_id", "key").agg(F.min("at").alias("__at")).select(F.col("conv_id").alias("__c"), "__at", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(bare == "", "b").when(F.col("first").isNull(), "d")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise(""))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("at") == F.col("__at")), "left")
    return materialise(joined.select("conv_id", "turn", "at", "chunk", "role", "text", fault.alias("fault")), "repair-faults")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterable[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns, as lists."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            key = row[:keys]
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row[keys:])
    if rows:
        yield now, rows


SPANS = "conv_id long, chunk long, whole boolean, arcs array<struct<p:string,q:string,cost:long,audit:string>>, first string, last string, blank long, duplicate long, truncated long, illegal long"
_ARCS = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("arcs", _ARCS), ("first", pa.string()), ("last", pa.string()),
                     *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]])


def _written(rows: Iterable[tuple], schema: pa.Schema, step: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == step:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _span(steps: list[Arcs], alone: bool, starts: str, insert: bool) -> list[dict]:
    """The items of some steps as arcs; of a whole conversation the goal alone."""
    arcs = []
    for p in starts:
        found = lightest(steps, p, complete if alone else None, insert)
        arcs += [{"p": p, "q": q, "cost": c, "audit": a} for q, (c, a) in found.items()]
    return arcs


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _chunk_spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(conv_id, chunk, at, n, initial, fault) sorted to a row for each chunk."""
    def rows() -> Iterator[tuple]:
        for (conv, chunk), turns in _groups(batches, 2):
            alone = turns[0][1] <= size
            initials, bad = [t[2] for t in turns], [t[3] for t in turns]
            arcs = _span([edits(x, f) for x, f in zip(initials, bad, strict=True)], alone, "0" if alone or chunk == 0 else STATES, True)
            yield (conv, chunk, alone, arcs, initials[0], initials[-1], bad.count("b"), bad.count("d"), bad.count("t"),
                   sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False)))
    return _written(rows(), _SCHEMA)


def _join_spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(conv_id, group, chunk, of, spans...) sorted to a row for each group of chunks."""
    def rows() -> Iterator[tuple]:
        for (conv, group), spans in _groups(batches, 2):
            if len(spans) == 1 and spans[0][2]:
                yield (conv, group, *spans[0][2:])
                continue
            steps: list[Arcs] = []
            for s in spans:
                by: Arcs = {}
                for x in s[3]:
                    by.setdefault(x["p"], []).append((x["q"], x["cost"], x["audit"]))
                steps.append(by)
            alone = spans[0][1] <= size
            starts = "0" if group == 0 else STATES
            between = sum(not _legal(a[5], b[4]) for a, b in zip(spans, spans[1:], strict=False))
            yield (conv, group, alone, _span(steps, alone, starts, False), spans[0][4], spans[-1][5],
                   *[sum(s[k] for s in spans) for k in (6, 7, 8)], sum(s[9] for s in spans) + between)
    return _written(rows(), _SCHEMA)


def derivations(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, cost, audit, blank, duplicate, truncated, illegal) of every
    conversation in ``marked``, the table of ``faults``."""
    sizes = marked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("__c"), "n")
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    turns = (marked.select("conv_id", "chunk", "at", F.substring("role", 1, 1).alias("initial"), "fault").join(sizes, same)
             .select("conv_id", "chunk", "at", "n", "initial", "fault"))
    spans = materialise(turns.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(lambda b: _chunk_spans(b, chunk), SPANS), "repair-spans")
    while not spans.filter("not whole").isEmpty():
        of = spans.groupBy("conv_id").agg(F.count(F.lit(1)).alias("of")).select(F.col("conv_id").alias("__c"), "of")
        grouped = (spans.join(of, same).withColumn("group", F.floor(F.col("chunk") / chunk))
                   .select("conv_id", "group", "chunk", "of", "whole", "arcs", "first", "last", "blank", "duplicate", "truncated", "illegal"))
        spans = materialise(grouped.repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "chunk").mapInArrow(lambda b: _join_spans(b, chunk), SPANS), "repair-spans")
    # the goal alone is left of each
    goal = F.element_at("arcs", 1)
    return spans.select("conv_id", goal["cost"].alias("cost"), goal["audit"].alias("audit"), "blank", "duplicate", "truncated", "illegal")


_PIECES = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audit", pa.string()), ("made", pa.int64()), ("system", pa.bool_())])


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit) to the audit of each chunk, the turns made before it and
    whether the conversation has a system turn."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for conv, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system = (len(audit) - audit.count("D")) % 2 == 1
                a = chunk = made = 0
                while a < len(audit):
                    b, read = a, 0
                    while b < len(audit) and read < size:
                        read += audit[b] != "I"
                        b += 1
                    if not audit[b:].strip("I"):
                        b = len(audit)  # turns inserted behind the last belong to its chunk
                    yield conv, chunk, audit[a:b], made, system
                    made += b - a - audit.count("D", a, b)
                    a, chunk = b, chunk + 1
    return _written(rows(), _PIECES)


TURNS = "conv_id long, place long, turn long, role string, text string, edit string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, chunk, at, audit, made, system, turn, role, text) sorted, a chunk's
    audit before its turns, to the repaired turns."""
    def rows() -> Iterator[tuple]:
        letters, k, made, system, key = "", 0, 0, False, None

        def role() -> str:
            return ROLES["ua"[(made - system) % 2]]

        def inserted(conv: int | None) -> Iterator[tuple]:
            nonlocal k, made
            while k < len(letters) and letters[k] == "I":
                yield conv, made, None, role(), "", "I"
                k, made = k + 1, made + 1

        for batch in batches:
            for part in by_rows(batch):
                for conv, chunk, _, audit, before, has, turn, own, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if audit is not None:
                        if key is not None:
                            yield from inserted(key[0])
                        letters, k, made, system, key = audit, 0, before, has, (conv, chunk)
                        continue
                    yield from inserted(conv)
                    edit, k = letters[k], k + 1
                    if edit != "D":
                        yield conv, made, turn, own if edit == "K" else role(), text, edit
                        made += 1
        if key is not None:
            yield from inserted(key[0])
    return _written(rows(), _TURNS, 500)


def by_rows(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def repaired(marked: DataFrame, derived: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), turn (null: inserted), role, text, edit (K, R or I)."""
    pieces = (derived.filter("audit <> ''").select("conv_id", "audit").mapInArrow(lambda b: _pieces(b, chunk), "conv_id long, chunk long, audit string, made long, system boolean")
              .select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), "audit", "made", "system", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]))
    turns = marked.select("conv_id", "chunk", "at", *[F.lit(None).cast(t).alias(c) for c, t in (("audit", "string"), ("made", "long"), ("system", "boolean"))], "turn", "role", "text")
    return (pieces.unionByName(turns).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(_apply, TURNS))


def facts(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps) of (conv_id, turn): turn numbers missing between the first and the last."""
    seen = turns.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return seen.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation with its faults, cost and audit; the repaired
    turns) of ``turns`` (conv_id, turn, role, text)."""
    marked = faults(turns, chunk)
    derived = materialise(derivations(marked, chunk), "repair-derived")
    gaps = facts(marked.select("conv_id", "turn")).withColumnRenamed("conv_id", "__c")
    summary = derived.join(gaps, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    return summary, repaired(marked, derived, chunk)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns: ``role:text`` of each, joined
    by line ends.  A digest is a chain: the lines of one conversation pass through one
    task in order, a slice at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, state = None, None
            for batch in batches:
                for part in by_rows(batch):
                    for conv, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        if state is None or conv != now:
                            if state is not None:
                                yield now, state.hexdigest()
                            now, state = conv, hashlib.sha256(line.encode())
                        else:
                            state.update(b"\n" + line.encode())
            if state is not None:
                yield now, state.hexdigest()
        return _written(rows(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return (turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "place").repartition("conv_id")
            .sortWithinPartitions("conv_id", "place").select("conv_id", "line").mapInArrow(run, "conv_id long, repaired_sha256 string"))


def report(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """Every conversation's faults, repair and digest after ``damage``."""
    summary, turns = repair(damage(conversations, conv_id, turn, role, text), chunk)
    every = conversations.select(F.col(conv_id).cast("long").alias("conv_id")).distinct()
    same: Callable[[str], Column] = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (every.join(summary.withColumnRenamed("conv_id", "__c"), same("__c"), "left")
            .join(digests(turns).withColumnRenamed("conv_id", "__d"), same("__d"), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
