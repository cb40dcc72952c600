import random
import re
from collections import Counter
from hashlib import sha256

import xxhash

from sightline.llm import imatch

SPLIT = re.compile("[ \t\n\x0b\x0c\r]+")


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed % 2**64)


def terms(text):
    return {signed(xx(w.encode())) for w in SPLIT.split((text or "").lower()) if w}


def chained(values, seed=42):
    for v, size in values:
        seed = xx((v % 2 ** (8 * size)).to_bytes(size, "little"), seed)
    return seed


def prints(found, lexicon):
    level = max(0, (len(found).bit_length() or 1) - 2)
    kept = sorted(found & lexicon)
    made = set()
    for at in range(level, level + imatch.LEVELS):
        mask = (1 << at) - 1
        for seed in imatch.SEED_BITS:
            inside = [h for h in kept if (h ^ seed) & mask == 0]
            if inside:
                made.add(chained([(at, 4), (seed & mask, 8), *[(h, 8) for h in inside]]))
    made = made or {chained([(h, 8) for h in sorted(found)])}
    return sorted({f"{h & 0xFFFFFFFF:08x}" for h in made})


def brute(rows, rare=imatch.RARE, common=imatch.COMMON):
    rows = sorted(
        ((i, t or "") for i, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, signed(xx(r[1].encode()))),
    )
    counts = Counter(h for _, t in rows for h in terms(t))
    lexicon = {h for h, n in counts.items() if rare * len(rows) <= n <= common * len(rows)}
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (prints(terms(t), lexicon) for t in (text, edited, after))
        like = [len({*a} & {*x}) / len({*a} | {*x}) for x in (b, c)]
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), *like))
    return out


def made(documents, text):
    rng = random.Random(2)
    texts = [text(rng.choice([1, 3, 9, 40, 200])) for _ in range(70)]
    texts += [texts[4]] * 5 + ["", None, " \n", "É é ÉÉ 日本 語", "A", "the the the"]
    ids = [*rng.sample(range(-50, 1000), len(texts) - 3), None, 7_000_000_000, 7_000_000_000]
    return documents(texts, ids), list(zip(ids, texts, strict=True))


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_fingerprints_and_edits_against_brute_force(documents, text):
    docs, rows = made(documents, text)
    want = sorted(brute(rows), key=key)
    for per_range in (imatch.ROWS_PER_RANGE, 7):
        got = sorted(map(tuple, imatch.compared(docs, per_range).collect()), key=key)
        assert got == want


def test_likeness_tells_edits_from_other_texts(documents, text):
    rng = random.Random(9)
    texts = ["\n".join(text(60) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    got = imatch.compared(documents(texts)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 110
    assert all(0 <= r["near_next"] <= r["near_edited"] + 0.5 <= 1.5 for r in got)


def test_equal_texts_share_a_fingerprint_and_rows_stay(documents, text):
    docs, _ = made(documents, text)
    twice = docs.union(docs)
    got = imatch.compared(twice, 11).collect()
    assert len(got) == 2 * docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for r in got:
        if r["doc_id"] != 7_000_000_000:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_few_and_no_rows(documents):
    assert imatch.compared(documents([]).where("false")).count() == 0
    (one,) = imatch.compared(documents(["a b c d"])).collect()
    assert one["edited_sha256"] == sha256(b"a b c a").hexdigest() and one["near_next"] == 1.0
    assert [tuple(r) for r in imatch.compared(documents([None, ""])).collect()] == [
        tuple(r) for r in brute([(0, None), (1, "")])
    ]


def test_plan_has_no_python_and_moves_texts_once(documents, text):
    docs, _ = made(documents, text)
    plan = imatch.compared(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
