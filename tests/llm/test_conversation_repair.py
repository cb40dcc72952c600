import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from sightline.llm import conversation_repair as cr

SPACES = " \t\n\x0b\x0c\r"
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = ("user", "assistant")


def damage(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        groups[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return groups


def brute_repair(turns, faults):
    """Every state's best (cost, audit, lines) by relaxing all edits, one turn after the other."""

    def put(found, state, way):
        if state is not None and (state not in found or way[:2] < found[state][:2]):
            found[state] = way

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, lines) in list(found.items()):
                for role in ROLES:
                    put(found, STEPS.get((state, role[0])), (cost + 5, audit + "I", [*lines, f"{role}:"]))
        return found

    now = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in inserted(now).items():
            put(new, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (5 if fault == "truncated" else 0)
            put(new, STEPS.get((state, role[:1])), (more, audit + "K", [*lines, f"{role}:{text}"]))
            for other in ROLES:
                put(new, STEPS.get((state, other[0])), (more + 1, audit + "R", [*lines, f"{other}:{text}"]))
        now = new
    now = inserted(now)
    return min((now[q] for q in ("", "a") if q in now), key=lambda w: w[:2])


def faults_of(turns):
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(SPACES)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else ""
        faults.append(kind or ("truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return faults


def brute(rows):
    found = {}
    for conv, turns in damage(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = faults_of(turns)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = brute_repair(turns, faults)
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return found


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "a\nb.", "Ünï.", "Yes. "]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    rows = []
    for conv in [*range(60), None]:
        order = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 5)
        for i, role in enumerate(order):
            wrong = rng.random() < 0.3
            turn = None if rng.random() < 0.05 else i + 2 * (rng.random() < 0.1)
            text = rng.choice(texts) if wrong else f"Text {rng.randint(0, 60)}."
            rows.append((conv, turn, rng.choice(roles) if wrong else role, text))
    rows += [(900, t, ("user", "assistant")[t % 2], "Same." if t % 5 == 0 else f"T {t}.") for t in range(40)]
    rows += [(901, 3, "user", "Copied.")] * 9 + [(902, None, None, None)] * 2
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    return rows, df.selectExpr("*", "'x' as part", "1 as pos", "'y' as said", "0 as cost", "'z' as turns")


@pytest.mark.parametrize("long_from", [4096, 3])
def test_damaged_conversations_against_brute_force(conversations, long_from):
    rows, df = conversations
    got = {r[0]: tuple(r[1:]) for r in cr.checked(df, long_from).collect()}
    assert got == brute(rows)


def test_parts_of_a_long_conversation_follow_one_another(conversations):
    _, df = conversations
    own = df.where("conv_id = 900")
    (whole,) = cr.repair(own).collect()
    parts = sorted(cr.repair(own, 7).collect(), key=lambda r: r["part"])
    assert len(parts) == 6 and "".join(p["audit"] for p in parts) == whole["audit"]
    assert [t for p in parts for t in p["turns"]] == whole["turns"]
    for name in ("gaps", "duplicate", "illegal", "cost"):
        assert sum(p[name] for p in parts) == whole[name]
    roles = "".join(t["role"][0] for t in whole["turns"])
    assert re.fullmatch("(s?(ua)+)?", roles) and whole["duplicate"] == 6


def test_stretches_give_what_one_agenda_gives(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        turns = [
            cr.Turn(rng.choice("suaat"), blank := rng.random() < 0.1, rng.random() < 0.1,
                    not blank and rng.random() < 0.2, rng.choice([1, 1, 2]))
            for _ in range(rng.randint(0, 9))
        ]
        monkeypatch.setattr(cr, "STRETCH", 100)
        whole = [cr.solve(turns, p) for p in range(4)], cr.solve(turns, 0, cr.GOALS)
        monkeypatch.setattr(cr, "STRETCH", 2)
        assert whole == ([cr.solve(turns, p) for p in range(4)], cr.solve(turns, 0, cr.GOALS))


def test_audits_grow_by_superior_deductions():
    """A deduction never gives less than its premise, and keeps the order of premises."""
    turns = [cr.Turn("a", False, False, True, 1), cr.Turn("u", False, True, False, 2), cr.Turn("s", False, False, False, 1)]
    ways = defaultdict(list)
    for start in range(4):
        for end, weight in cr.derive(turns, start).items():
            ways[start, end].append(weight)
            assert weight >= (0, "") and len(weight[1].replace("I", "")) == 4
    assert all(len(w) == 1 for w in ways.values())


def test_empty_table(spark, conversations):
    _, df = conversations
    assert cr.checked(df.where("false")).count() == 0
    assert cr.repair(df.where("false")).count() == 0
    alone = spark.createDataFrame([("k", None, "tool", "x")], "conv_id string, turn int, role string, text string")
    (row,) = cr.repair(alone).collect()
    assert (row["conv_id"], row["audit"], row["cost"], row["turns"]) == ("k", "D", 2, [])
