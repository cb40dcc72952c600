from sightline.llm import decontaminate


def brute(text, items, n=10):
    words = (text or "").encode().translate(decontaminate.FOLD).split()
    hit, named = set(), set()
    for item, told in items:
        asked = (told or "").encode().translate(decontaminate.FOLD).split()
        if not asked:
            continue
        size = min(n, len(asked))
        windows = {tuple(asked[i : i + size]) for i in range(len(asked) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                named |= set() if item is None else {str(item)}
    return len(words), len(hit), sorted(named)


def test_matches_brute_force_in_one_and_many_blocks(spark, documents, text):
    items = [(0, text(25)), (1, "Short, item!"), (2, None), (3, ""), (None, text(30)), (4, text(14)), (5, "lem")]
    items += [(6, items[0][1]), (10, items[0][1][10:90]), (0, text(12))]
    a, b = items[0][1], items[5][1]
    cases = [
        None, "", "--- ..", text(40), text(20) + " " + a.upper() + " " + text(20), a + a, b.replace(" ", "--"),
        "short ITEM", "a short item b short item", " ".join(b.split()[:9]), " ".join(b.split()[2:13]), text(30_000) + b,
        items[4][1], text(3) + " " + items[4][1], "Ünï lemé 日本", "lem",
    ]
    docs = documents([*cases, a], [*range(len(cases)), None])
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = {r["row"]["doc_id"]: r for r in decontaminate.scan(docs, bench, block_bytes=block).collect()}
        for i, case in [*enumerate(cases), (None, a)]:
            found = (got[i]["n_words"], got[i]["n_hit"], got[i]["items"])
            assert found == brute(case, items), (i, block)


def test_removes_documents_or_spans(spark, documents, text):
    item = text(12)
    docs = documents(["Before it. " + item + "! after it", "clean words only here", None])
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {0: "Before it. ! after it", 1: "clean words only here", 2: None}
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 3
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0


def test_a_window_that_many_items_share_is_spread_over_blocks(spark, documents, text):
    shared = text(10)
    bench = spark.createDataFrame([(i, shared) for i in range(400)], "item_id int, text string")
    docs = documents([text(5) + " " + shared, "clean"])
    (hit, clean) = sorted(decontaminate.scan(docs, bench, block_bytes=4000).collect(), key=lambda r: -r["n_hit"])
    assert hit["n_hit"] == 10 and hit["items"] == sorted(map(str, range(400))) and clean["items"] == []
