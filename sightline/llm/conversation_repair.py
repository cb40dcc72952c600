"""Repair of conversation structure: lightest derivations over a hypergraph, found with Knuth's agenda.

An item ``(place, state)`` says that the turns before ``place`` are repaired and the turns kept so far
leave the grammar ``(s?(ua)+)?`` in ``state``.  Edits are deductions from one item to another; a stretch
of turns solved on its own is an item too, and following one stretch by another is a deduction from two
items.  A derivation weighs (cost, audit), the audit being the initials of its edits in order, and the
lighter one is the cheaper, then the smaller in ASCII.  Deductions add to the cost and append to the
audit, so they are superior functions: none makes a weight smaller, and, as two audits over the same
turns with equal costs are never one the beginning of the other, a smaller premise never gives a larger
result.  So the lightest item on the agenda is final when it is popped, the goal included.

Conversations of up to ``LONG`` turns are solved in one task each.  A longer one is cut into parts,
which tasks solve for every state they may start from; the parts are then followed by one another, and
each is repaired by the task that holds its texts, so no task holds a long conversation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SPACES, settle
from sightline.plans.ordering import with_position
from sightline.plans.skew import lookup

LONG = 4_096  # turns solved in one task; longer conversations go by parts of so many
STRETCH = 256  # turns on one agenda
OUT = 1_024  # conversations in one Arrow batch

# What edits cost, and which adjacent initials are legal.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
ENDS = ".!?"

# States: 0 before any turn, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ADDED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
GOALS = (0, 3)

COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
TURNS = pa.list_(pa.struct([
    ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())
]))
TURNS_SQL = "array<struct<turn:bigint,role:string,text:string,edit:string>>"


class Turn(NamedTuple):
    """A turn and the copies that follow it; ``repeated`` if said in an earlier turn already."""

    initial: str
    blank: bool
    repeated: bool
    cut: bool
    copies: int


def _is_blank(text: str | None) -> bool:
    return not (text or "").strip(SPACES)


def _is_cut(text: str | None) -> bool:
    return (text or "").strip(SPACES)[-1:] not in ENDS


def derive(turns: list[Turn], start: int, goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) of each state after ``turns``; of the lightest goal alone, if given."""
    agenda = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(turns):
            if state in goals:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
        added = ADDED[state][1]
        heapq.heappush(agenda, (cost + INSERT, audit + "I", at, added))
        if at == len(turns):
            continue
        turn = turns[at]
        # The copies after the first are deleted with it or behind it.
        behind = "D" * (turn.copies - 1)
        more = cost + DELETE * (turn.copies - 1)
        heapq.heappush(agenda, (more + DELETE, audit + "D" + behind, at + 1, state))
        if turn.blank or turn.repeated:
            continue
        more += TRUNCATED if turn.cut else 0
        kept = KEPT.get(turn.initial, {}).get(state)
        if kept is not None:
            heapq.heappush(agenda, (more, audit + "K" + behind, at + 1, kept))
        heapq.heappush(agenda, (more + REROLE, audit + "R" + behind, at + 1, added))
    return found


def follow(before: dict[int, tuple[int, str]], stretch: dict[int, dict]) -> dict[int, tuple[int, str]]:
    """Deductions from two items: what lies before, and the stretch from the state it ends in."""
    found: dict[int, tuple[int, str]] = {}
    for middle, (cost, audit) in before.items():
        for end, (more, rest) in stretch[middle].items():
            weight = (cost + more, audit + rest)
            if end not in found or weight < found[end]:
                found[end] = weight
    return found


def solve(turns: list[Turn], start: int, goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """``derive`` for any number of turns, by stretches."""
    if len(turns) <= STRETCH:
        return derive(turns, start, goals)
    before = {start: (0, "")}
    for i in range(0, len(turns), STRETCH):
        stretch = turns[i : i + STRETCH]
        before = follow(before, {state: derive(stretch, state) for state in before})
    if goals:
        best = min((q for q in goals if q in before), key=before.get)
        return {best: before[best]}
    return before


def edited(rows: list[tuple], turns: list[Turn], start: int, audit: str) -> list[dict]:
    """The turns that the audit's edits leave, from rows (turn, role, text)."""
    found, at, state = [], 0, start
    letters = iter(audit)
    for letter in letters:
        if letter == "I":
            role, state = ADDED[state]
            found.append({"turn": None, "role": role, "text": "", "edit": "insert"})
            continue
        (number, role, text), turn = rows[at], turns[at]
        for _ in range(turn.copies - 1):
            next(letters)
        at += 1
        if letter == "K":
            state = KEPT[turn.initial][state]
            found.append({"turn": number, "role": role, "text": text, "edit": "keep"})
        elif letter == "R":
            role, state = ADDED[state]
            found.append({"turn": number, "role": role, "text": text, "edit": "rerole"})
    return found


class Faults:
    """Counts over turns in order, from the last initial and turn number of what lies before."""

    def __init__(self, initial: str | None = None, number: int | None = None):
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial, self.number = initial, number

    def add(self, number: int | None, turn: Turn) -> None:
        if turn.blank:
            self.blank += turn.copies
        else:
            self.duplicate += turn.copies - (not turn.repeated)
            self.truncated += turn.cut and not turn.repeated
        if self.initial is not None:
            self.illegal += self.initial + turn.initial not in LEGAL
        self.illegal += turn.copies - 1
        self.initial = turn.initial
        if number is not None:
            if self.number is not None and number > self.number:
                self.gaps += number - self.number - 1
            self.number = number

    def values(self) -> list[int]:
        return [self.gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = OUT) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, OUT):
            part = batch.slice(start, OUT)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def _part_schema(id_type: pa.DataType) -> pa.Schema:
    counts = [(c.split()[0], pa.int64()) for c in COUNTS.split(", ")]
    return pa.schema([
        ("conv_id", id_type), ("part", pa.int64()), *counts, ("audit", pa.string()), ("turns", TURNS)
    ])


def _short(batches):
    """Whole conversations, one after the other."""

    def repaired():
        for conv, rows in groupby(chain_rows, key=lambda r: r[0]):
            said, turns, told, faults = set(), [], [], Faults()
            for _, number, role, text in rows:
                blank = _is_blank(text)
                turn = Turn((role or "")[:1], blank, (role, text) in said, not blank and _is_cut(text), 1)
                said.add((role, text))
                turns.append(turn)
                told.append((number, role, text))
                faults.add(number, turn)
            ((cost, audit),) = solve(turns, 0, GOALS).values()
            yield conv, 0, *faults.values(), cost, audit, edited(told, turns, 0, audit)

    first = next(batches, None)
    if first is None:
        return
    schema = _part_schema(first.schema.field(0).type)

    def again():
        yield first
        yield from batches

    chain_rows = _rows(again())
    yield from _flushed(repaired(), schema)


def _pieces(batches):
    """For each part its facts at both ends, its counts, and the lightest way between any two states."""
    way = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([
        ("conv", pa.string()), ("part", pa.int64()), ("first", pa.string()), ("last", pa.string()),
        ("low", pa.int64()), ("high", pa.int64()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], ("ways", way),
    ])

    def solved():
        for (conv, part), rows in groupby(_rows(batches), key=lambda r: r[:2]):
            turns, faults, low = [], Faults(), None
            for _, _, number, initial, blank, repeated, cut, copies in rows:
                turns.append(Turn(initial, blank, repeated, cut, copies))
                faults.add(number, turns[-1])
                low = number if low is None else low
            ways = [
                {"p": p, "q": q, "cost": cost, "audit": audit}
                for p in ADDED for q, (cost, audit) in solve(turns, p).items()
            ]
            yield conv, part, turns[0].initial, faults.initial, low, faults.number, *faults.values(), ways

    yield from _flushed(solved(), schema, 64)


PIECES = (
    "conv string, part bigint, first string, last string, low bigint, high bigint, gaps bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, ways array<struct<p:int,q:int,cost:bigint,audit:string>>"
)
CHOSEN = f"conv string, part bigint, start int, {COUNTS}, audit string"


def _choose(batches):
    """Follows the parts of a conversation by one another; only undecided parts are held."""
    schema = pa.schema([
        ("conv", pa.string()), ("part", pa.int64()), ("start", pa.int32()),
        *[(c.split()[0], pa.int64()) for c in COUNTS.split(", ")], ("audit", pa.string()),
    ])

    def weight(way):
        return way[0], "".join(step[-1] for step in way[1])

    def chosen():
        for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
            live: dict[int, tuple[int, list]] = {0: (0, [])}
            initial = number = None
            for _, part, first, last, low, high, gaps, blank, duplicate, truncated, illegal, ways in parts:
                if initial is not None:
                    illegal += initial + first not in LEGAL
                if number is not None and low is not None and low > number:
                    gaps += low - number - 1
                initial, number = last, number if high is None else high
                counts = (gaps, blank, duplicate, truncated, illegal)
                new: dict[int, tuple[int, list]] = {}
                for w in ways:
                    if w["p"] in live:
                        cost, steps = live[w["p"]]
                        way = (cost + w["cost"], [*steps, (part, w["p"], counts, w["cost"], w["audit"])])
                        if w["q"] not in new or weight(way) < weight(new[w["q"]]):
                            new[w["q"]] = way
                live = new
                # What all live ways share is decided.
                while all(steps for _, steps in live.values()) and len({s[0] for _, s in live.values()}) == 1:
                    done = next(iter(live.values()))[1][0]
                    yield conv, done[0], done[1], *done[2], done[3], done[4]
                    live = {q: (cost - done[3], steps[1:]) for q, (cost, steps) in live.items()}
            best = min((live[q] for q in GOALS if q in live), key=weight)
            for part, start, counts, cost, audit in best[1]:
                yield conv, part, start, *counts, cost, audit

    yield from _flushed(chosen(), schema, 64)


def _finish(batches):
    """Repairs the texts of a part by the edits chosen for it, which come first."""
    first = next(batches, None)
    if first is None:
        return
    schema = _part_schema(first.schema.field("conv_id").type)

    def again():
        yield first
        yield from batches

    def repaired():
        for (_, part), rows in groupby(_rows(again()), key=lambda r: r[:2]):
            _, _, _, start, *counts, audit, _, _, _, _, _, _ = next(rows)
            turns, told, conv_id = [], [], None
            for r in rows:
                conv_id, number, role, text, initial, copies = r[-6:]
                turns.append(Turn(initial, False, False, False, copies))
                told.append((number, role, text))
            yield conv_id, part, *counts, audit, edited(told, turns, start, audit)

    yield from _flushed(repaired(), schema, 1)


def _conv() -> Column:
    return F.to_json(F.struct("conv_id"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds what orders the turns of a conversation: number, null first, then role and text."""
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.left(F.coalesce("role", F.lit("")), F.lit(32)).alias("_r"),
        F.left(F.coalesce("text", F.lit("")), F.lit(32)).alias("_t"),
        F.md5(F.to_json(F.struct("conv_id", "role", "text"))).alias("said"),
    )


def _split(conversations: DataFrame, long_from: int) -> tuple[DataFrame, DataFrame | None]:
    rows = conversations.select("conv_id", "turn", "role", "text")
    # At most one in ``long_from`` rows has a conversation here.
    long = settle(rows.groupBy("conv_id").count().where(F.col("count") > long_from).select(
        F.col("conv_id").alias("_long")), "long")
    if long.isEmpty():
        return rows, None
    match = rows["conv_id"].eqNullSafe(long["_long"])
    return rows.join(long, match, "left_anti"), rows.join(long, match, "left_semi")


def _out_schema(conversations: DataFrame) -> str:
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return f"conv_id {kind}, part bigint, {COUNTS}, audit string, turns {TURNS_SQL}"


def _repair_short(rows: DataFrame) -> DataFrame:
    dealt = _ordered(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "_r", "_t", "said")
    return dealt.select("conv_id", "turn", "role", "text").mapInArrow(_short, _out_schema(rows))


def _repair_long(rows: DataFrame, part_turns: int) -> DataFrame:
    told = _ordered(rows).withColumn("conv", _conv())
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    narrow = told.groupBy(
        "conv", "turn", "_r", "_t", "said", F.left(F.coalesce("role", F.lit("")), F.lit(1)).alias("initial"),
        (text == "").alias("blank"), ((text != "") & ~F.right(text, F.lit(1)).isin(*ENDS)).alias("cut"),
    ).agg(F.count("*").alias("copies"))
    narrow = settle(narrow, "turns")
    # Equal turns are one row by now, so what is left are those said in several turns.
    first = narrow.groupBy("said").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n")
    ).where("n > 1")
    marked = lookup(narrow, first, ["said"], "n", "turn", how="left")
    repeated = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    marked = marked.withColumn("repeated", repeated).drop("first", "n")
    placed = with_position(marked, ["conv"], ["turn", "_r", "_t", "said"], "pos")
    placed = settle(placed.withColumn("part", F.floor(F.col("pos") / part_turns).cast("bigint")), "placed")

    def dealt(df: DataFrame, *keys: str, order: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, order)

    pieces = dealt(placed, "conv", "part", order="pos").select(
        "conv", "part", "turn", "initial", "blank", "repeated", "cut", "copies"
    ).mapInArrow(_pieces, PIECES)
    chosen = settle(dealt(pieces, "conv", order="part").mapInArrow(_choose, CHOSEN), "chosen")

    texts = told.select("said", F.col("turn").alias("_turn"), "conv_id", "role", "text").dropDuplicates(["said", "_turn"])
    places = placed.select("conv", "part", "pos", "turn", F.col("said").alias("_said"), "initial", "copies")
    match = (texts["said"] == places["_said"]) & texts["_turn"].eqNullSafe(places["turn"])
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    own = texts.join(places, match).select(
        "conv", "part", "pos", F.lit(None).cast("int").alias("start"),
        *[F.lit(None).cast("bigint").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"),
        "conv_id", "turn", "role", "text", "initial", "copies",
    )
    sent = chosen.select(
        "conv", "part", F.lit(-1).cast("bigint").alias("pos"), "start", *counts, "audit",
        F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(None).cast("bigint").alias("turn"),
        *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "initial")],
        F.lit(None).cast("bigint").alias("copies"),
    )
    return dealt(own.union(sent), "conv", "part", order="pos").mapInArrow(_finish, _out_schema(rows))


def repair(conversations: DataFrame, long_from: int = LONG) -> DataFrame:
    """(conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    One row per conversation, or per part of ``long_from`` turns of a longer one: the counts of its
    parts add up, and their audits and repaired ``turns`` (turn, role, text, edit) follow one another.
    Turns go by number, null first, then by role and text; equal rows are copies of one turn.  A null
    text is blank, a null role has no initial, a null ``conv_id`` is a conversation of its own; an
    empty table gives none.  Columns beyond conv_id, turn, role and text are left out.
    """
    short, long = _split(conversations, long_from)
    found = _repair_short(short)
    return found if long is None else found.union(_repair_long(long, long_from))


SUMMARY = f"{COUNTS}, audit string, repaired_sha256 string"


def _told(batches):
    """Adds up the parts of a conversation and hashes their turns one after another."""
    first = next(batches, None)
    if first is None:
        return
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    schema = pa.schema([
        ("conv_id", first.schema.field(0).type), *[(c, pa.int64()) for c in counts],
        ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ])

    def again():
        yield first
        yield from batches

    def rows():
        for batch in again():
            for i in range(batch.num_rows):  # one part at a time
                yield tuple(c[i].as_py() for c in batch.columns)

    def summed():
        for conv, parts in groupby(rows(), key=lambda r: r[0]):
            sums, audits, digest, between = [0] * len(counts), [], sha256(), b""
            for _, _, *told, audit, turns in parts:
                sums = [a + b for a, b in zip(sums, told, strict=True)]
                audits.append(audit)
                for t in turns:
                    digest.update(between + f"{t['role'] or ''}:{t['text'] or ''}".encode())
                    between = b"\n"
            yield conv, *sums, "".join(audits), digest.hexdigest()

    yield from _flushed(summed(), schema, 1)


def summaries(conversations: DataFrame, long_from: int = LONG) -> DataFrame:
    """(conv_id, counts, audit, repaired_sha256): one row per conversation of any length.

    The digest is that of the repaired ``role:text``, joined by newlines.  SHA-256 takes its input in
    order, so one task passes the parts of a long conversation, one at a time.
    """
    short, long = _split(conversations, long_from)
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    lines = F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit(":"), F.coalesce(t["text"], F.lit(""))
    ))
    found = _repair_short(short).select(
        "conv_id", *counts, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )
    if long is None:
        return found
    kind = conversations.schema["conv_id"].dataType.simpleString()
    parts = _repair_long(long, long_from).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return found.union(parts.mapInArrow(_told, f"conv_id {kind}, {SUMMARY}"))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by a hash of ``conv_id:turn``.

    A null counts as one space, in the hash and in role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), key.alias("_k")
    ).where("_k <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def checked(conversations: DataFrame, long_from: int = LONG) -> DataFrame:
    """The summary of every original conversation after damage; zeros where no turn is left."""
    found = summaries(damaged(conversations), long_from)
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    told = ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left")
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return told.select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
