import os

from sightline.llm import line_dedup
from sightline.llm.common import collecting


def brute(rows):
    first, out = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").encode().split(b"\n") if text else []
        kept = []
        for i, (a, b) in enumerate(line_dedup.chunks(lines)):
            chunk = b"\n".join(lines[a:b])
            several = sum(bool(x.strip()) for x in lines[a:b]) > 1
            if not several or first.setdefault(chunk, (doc_id, text, i)) == (doc_id, text, i):
                kept += lines[a:b]
        out[(doc_id, text)] = (len(lines), len(lines) - len(kept), b"\n".join(kept).decode())
    return out


def test_matches_brute_force(documents, text):
    passage = text(120, per_line=6)
    texts = [text(60, 5) + "\n" + passage + "\n" + text(40, 5) for _ in range(6)]
    texts += [passage, passage + "\n" + passage, None, "", "one line", "\n\n\n\n\n\n", "\n\n\n\n\n\n", text(20_000)]
    docs = documents([*texts, texts[0]], [*range(len(texts) - 1), None, 0])
    got = line_dedup.dedup(docs).collect()
    rows = [(r["row"]["doc_id"], r["row"]["text"]) for r in got]
    want = brute(rows)
    assert len(got) == len(texts) + 1 and sum(r["removed_lines"] for r in got) > 40
    for r, key in zip(got, rows, strict=True):
        assert (r["n_lines"], r["removed_lines"], r["cleaned"]) == want[key]


def test_boundaries_resist_shifts(text):
    lines = text(3000, 6).encode().split(b"\n")
    whole = {b"\n".join(lines[a:b]) for a, b in line_dedup.chunks(lines)}
    moved = [b"new first line", *lines]
    again = {b"\n".join(moved[a:b]) for a, b in line_dedup.chunks(moved)}
    assert len(whole - again) <= 2


def test_empty(documents):
    assert line_dedup.dedup(documents(["a"]).where("false")).count() == 0


def repeated_runs(rows, over):
    """Places of lines in a run of more than ``over`` words that stands earlier too; told without chunks()."""
    docs = sorted(set(rows))
    lines = [t.split("\n") for _, t in docs]
    gone = set()
    for d, mine in enumerate(lines):
        for e in range(d + 1):
            for i in range(len(mine)):
                for j in range(len(lines[e]) if e < d else i):
                    n = 0
                    while i + n < len(mine) and j + n < len(lines[e]) and mine[i + n] == lines[e][j + n]:
                        n += 1
                    if e == d:
                        n = min(n, i - j)
                    if len(" ".join(mine[i : i + n]).split()) > over:
                        gone |= {(d, i + k) for k in range(n)}
    return {docs[d] + (i,) for d, i in gone}


def test_repeated_passages_go_whole_wherever_they_stand(documents, text):
    one_line, short, edge = text(60, 60), text(56, 14), text(50, 10)
    uneven = "\n".join([text(51, 60), "", text(20, 20), text(3, 3)])
    texts = [
        "\n".join([text(30, 7), p, text(26, 9)]) for p in (one_line, short, uneven, edge) for _ in range(4)
    ] + [one_line + "\n" + one_line, short, text(400, 11)]
    got = line_dedup.dedup(documents(texts), over=50).collect()
    want = repeated_runs(list(enumerate(texts)), 50)
    assert len(want) == 4 + 1 + 4 * 4 + 3 * 4
    for r in got:
        i, lines = r["row"]["doc_id"], texts[r["row"]["doc_id"]].split("\n")
        gone = {k for d, _, k in want if d == i}
        if edge not in texts[i]:  # only chunks can go of a passage that is not over the bound
            assert r["cleaned"].split("\n") == [x for k, x in enumerate(lines) if k not in gone] or (
                r["cleaned"] == "" and len(gone) == len(lines)
            )
            assert r["removed_lines"] == len(gone)
        else:
            assert not gone and r["removed_lines"] <= 5


def test_the_query_removes_every_repeated_passage(spark):
    from sightline.llm.queries import QUERIES

    rows = QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {}
    for d, _, i in repeated_runs([(k, v) for k, v in docs.items() if k is not None], 50):
        want.setdefault(d, set()).add(i)
    assert all(r["removed_lines"] >= len(want.get(r["doc_id"], ())) for r in rows)


def test_runs_are_linear_in_blank_lines():
    import time

    lines = [b""] * 100_000 + [b" ".join([b"w"] * 60)] + [b""] * 100_000
    began = time.monotonic()
    assert line_dedup.runs(lines, 50) == {(100_000, 100_001)}
    assert time.monotonic() - began < 1


def test_what_nothing_reads_any_more_is_removed(documents):
    passage = "\n".join(f"{i} a line of the passage that occurs again" for i in range(12))
    with collecting() as made:
        got = line_dedup.dedup(documents([f"one\n{passage}", f"{passage}\ntwo", None]), over=50)
    told, shown = made
    assert not os.path.exists(told.settled_at.removeprefix("file:")) and shown.count() > 0
    assert sorted(r.cleaned for r in got.collect()) == ["", f"one\n{passage}", "two"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("as binary) AS text") == 0
