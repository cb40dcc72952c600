import random
import zlib
from hashlib import sha256
from itertools import groupby

import pytest

from sightline.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        start = i // 8 * 8
        run = nodes[start : start + 8]
        yield run[: i - start], run[i - start + 1 :]
        i //= 8


def brute(rows):
    lang = lambda r: (r[2] is not None, (r[2] or "").encode())
    rows = sorted(rows, key=lambda r: (lang(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(rows, key=lang)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    found = []
    for j, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            proof = [*siblings(t, i), *siblings(top, j)]
            read = r
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[4] is not None:
                read = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            end = leaf(read)
            for left, right in proof:
                end = digest(*left, end, *right)
            told = digest(*["".join(left + right) for left, right in proof])
            found.append((r[0], t[0][i], t[-1][0], top[-1][0], told, end, end == top[-1][0]))
    return found


def rows_of(n, langs, seed=4):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["s", None]), rng.choice(langs), i, rng.choice(["A b", "c", "", None, "É\n"]) )
        for i in rng.sample(range(-20, 5000), n)
    ]
    return rows


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize(
    ("rows", "fan_levels"),
    [
        (rows_of(700, ["en"] * 30 + ["de", "", None, "zz", "日"]) + [(None, None, None, None, None)] * 3, 1),
        (rows_of(700, ["en"] * 30 + ["de", "", None, "zz", "日"]) + [(5000, "s", "en", 1, "Q")] * 20, 2),
        (rows_of(150, [f"l{i}" for i in range(90)]), 1),
        (rows_of(75, ["en"]), 4),
    ],
)
def test_manifest_against_brute_force(spark, rows, fan_levels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, merkle.checked(docs, fan_levels).collect()), key=key)
    want = sorted(brute(rows), key=key)
    # Repeated rows are leaves of their own with proofs of their own.
    assert got == want


def test_block_proofs_lead_to_its_root():
    for n in (1, 2, 8, 9, 64, 65, 513):
        for levels in (None, 1, 3, 4):
            if levels and n > 8**levels:  # more than a block holds
                continue
            digests = [digest(str(i)) for i in range(n)]
            block = merkle.Block(digests, levels)
            for at, proof in zip(digests, block.proofs((("x", "y"), None)), strict=True):
                assert proof[-1] == ("x", "y") and len(proof) == len(block.sizes)
                for left, right in proof[:-1]:
                    at = digest(left, at, right)
                assert at == block.root


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "Abc")], SCHEMA)
    (row,) = merkle.checked(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf((1, "s", "en", 3, "Abc"))
    assert row["proof_sha256"] == sha256(b"").hexdigest()
    assert merkle.checked(docs.where("false")).count() == 0


def test_extra_columns_stay_packed(spark):
    docs = spark.createDataFrame([(i, "en", digest(str(i)), "t", i, "r") for i in range(20)],
                                 "doc_id int, lang string, leaf string, tree string, pos int, row string")
    got = merkle.manifest(docs).collect()
    assert {(r["row"]["pos"], r["row"]["tree"], r["row"]["row"]) for r in got} == {(i, "t", "r") for i in range(20)}
    assert all(r["leaf"] == digest(str(r["row"]["doc_id"])) and len(r["proof"]) == 2 for r in got)
