import re
from collections import Counter

from sightline.llm import quality_rules
from sightline.llm.stats import with_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_repeat_words": len(inside),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_chars": len(text), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_upper": len(re.findall("[A-Z]", text)), "n_marks": len(re.findall("[!?]", text)),
    }


def test_counts_match_brute_force(documents, text):
    long = text(30_000)
    cases = [
        None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e", "a b c d e a b c d e", "x " * 50, text(400),
        long, "\n".join([text(20)] * 3), "é ü 😀 日本 \xa0 z y", "A\n\nA\n \nB!?", "# $ % <a> " * 6,
        "a b c d e f " + text(30) + " a b c d e f", "a a a a a a b a a a a a",
    ]
    got = {r["row"]["doc_id"]: r for r in with_statistics(documents(cases)).collect()}
    for i, case in enumerate(cases):
        for name, value in brute(case).items():
            assert got[i][name] == value, (case and case[:40], name)


def test_verdicts(documents, text):
    good = "the house of the lem and a dor in the sab that it was " + text(30)
    bad = {
        "short": "the of and", "symbols": " ".join(["the$$$ of&&&"] * 3 + [w + "%%%" for w in text(40).split()]),
        "repeats": " ".join(w for w in text(20).split() for _ in range(9)), "null": None,
        "loud": " ".join(w.upper() + "!!" for w in text(60).split()),
    }
    found = quality_rules.judge(documents([good, *bad.values()])).collect()
    assert {r["row"]["doc_id"]: r["kept"] for r in found} == {0: True} | dict.fromkeys(range(1, 6), False)
    assert [r["base_failed"] for r in sorted(found, key=lambda r: r["row"]["doc_id"])] == [
        False, True, False, True, True, False,
    ]


def test_keeps_columns_and_repeated_rows(documents, text):
    good = "the house of the lem and a dor in the sab that it was " + text(30)
    docs = documents([good, good, None], [4, 4, None])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 2
    assert quality_rules.keep(docs.where("false")).count() == 0


def test_no_user_functions(documents):
    plan = quality_rules.judge(documents(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
