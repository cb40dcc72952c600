"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every text.

A window is ``N`` consecutive words of an item (the whole item if it has fewer).  Tasks turn a text
into word numbers of the benchmark's vocabulary, hash the stretches that consist of known words only,
look the hashes up, and verify each hit word by word.  The windows are cut by hash into blocks of at
most ``BLOCK_BYTES`` of text; one block is broadcast at a time, so the broadcast has a fixed size bound
however large the benchmark is, and every block meets all rows.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import settle

N = 10
BLOCK_BYTES = 16 << 20
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
# Byte by byte: A-Z in lower case, other ASCII that is no letter or digit as a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c in KEPT or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "spans:array<struct<first:bigint,last:bigint>>,cleaned:string>"
)


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, window), distinct; items without a text or words have none, one without an id a null one."""
    def cut(batches):
        for batch in batches:
            ids, found = [], []
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.translate(FOLD).split()
                size = min(n, len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    ids.append(item)
                    found.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item_id", "window"]
            )

    told = benchmark.where("text is not null").select(
        F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text")
    )
    return told.mapInArrow(cut, "item_id string, window binary").distinct()


class Windows:
    """One block of windows as sorted hashes over word numbers, for each window length."""

    @classmethod
    def of(cls, parts) -> Windows:
        made = cls.__new__(cls)
        made.numbers, made.codes, made.sizes = parts
        return made

    def parts(self):
        """Plain data, for a broadcast."""
        return self.numbers, self.codes, self.sizes

    def __init__(self, rows):
        rng = np.random.default_rng(7)
        numbers: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple, list[str]]] = {}
        for item, window in rows:
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in bytes(window).split(b" "))
            named = by_size.setdefault(len(key), {}).setdefault(key, [])
            if item is not None:
                named.append(item)
        self.numbers = numbers
        self.codes = rng.integers(1, 2**63, len(numbers) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sizes = {}
        for size, windows in by_size.items():
            keys = np.array(list(windows), dtype=np.int64).reshape(-1, size)
            hashes = self.hashes(keys.ravel(), size)[::size] if len(keys) else np.zeros(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = (hashes[order], keys[order], [list(windows.values())[i] for i in order])

    def hashes(self, ids, size):
        """A hash of every window of ``size`` consecutive numbers."""
        codes = self.codes[ids]
        last = len(ids) - size + 1
        total = np.zeros(last, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + last]
        return total

    def hits(self, words):
        """(first word, size, items) of each verified occurrence."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        unknown = np.flatnonzero(ids == 0)
        edges = np.concatenate(([-1], unknown, [len(ids)]))
        room = np.diff(edges) - 1
        for size, (known, keys, items) in self.sizes.items():
            runs = np.flatnonzero(room >= size)
            # A few long stretches are looked at alone, many short ones in one sweep.
            whole = len(runs) > 8
            for at in [0] if whole else runs:
                low = 0 if whole else edges[at] + 1
                run = ids if whole else ids[low : edges[at + 1]]
                hashes = self.hashes(run, size)
                place = np.searchsorted(known, hashes)
                place[place == len(known)] = 0
                for i in np.flatnonzero(known[place] == hashes):
                    j = place[i]
                    while j < len(known) and known[j] == hashes[i]:
                        if np.array_equal(keys[j], run[i : i + size]):
                            yield int(low + i), size, items[j]
                        j += 1


def _scan(windows):
    def scan(batches):
        block = Windows.of(windows.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for text, had in zip(
                    part.column("_text").to_pylist(), part.column("_found").to_pylist(), strict=True
                ):
                    words = (text or b"").translate(FOLD).split()
                    spans = [(s["first"], s["last"]) for s in had["spans"]] if had else []
                    items = set(had["items"]) if had else set()
                    for first, size, named in block.hits(words):
                        spans.append((first, first + size - 1))
                        items.update(named)
                    merged: list[list[int]] = []
                    for first, last in sorted(spans):
                        if merged and first <= merged[-1][1] + 1:
                            merged[-1][1] = max(merged[-1][1], last)
                        else:
                            merged.append([first, last])
                    out.append({
                        "n_words": len(words),
                        "n_hit": sum(b - a + 1 for a, b in merged),
                        "items": sorted(items),
                        "spans": [{"first": a, "last": b} for a, b in merged],
                        "cleaned": _without(text, merged) if merged else None,
                    })
                kind = pa.struct([
                    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    ("cleaned", pa.string()),
                ])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("_text"), pa.array(out, kind)],
                    ["row", "_text", "_found"],
                )

    return scan


def _without(text: bytes, spans) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, text[at:]]).decode()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES,
         carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_hit, items, spans, cleaned) for every row of ``docs``.

    ``items`` are the ids, as sorted text, of the items with an occurring window; ``spans`` the hit
    words' ranges, merged; ``cleaned`` the text without them, null where nothing is hit.  ``row``
    packs the input's columns (or those of ``carry``).  A null or empty text has no words and no hit;
    repeated rows and items count as often as they stand there, items once per id; words of an item
    without an id are hit but not named; without usable items nothing is hit.
    """
    spark = docs.sparkSession
    windows = settle(benchmark_windows(benchmark, n), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = docs.select(
        F.struct(*(carry or ["*"])).alias("row"), F.col("text").cast("binary").alias("_text"),
        F.lit(None).cast(FOUND).alias("_found"),
    )
    schema = found.schema
    for block in range(blocks):
        # Dealt by item too, so that a window which very many items share is spread over the blocks.
        mine = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == block).select("item_id", "window")
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in mine.collect()]).parts())
        found = found.mapInArrow(_scan(shared), schema)
        if blocks > 1:
            found = settle(found, "scanned")
    return found.select("row", "_found.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) without the hit words.

    Null and empty texts stay as they are, repeated rows are judged alike; without items, or with an
    empty ``docs``, all rows come back.
    """
    found = scan(docs, benchmark, n)
    if remove == "documents":
        return found.where("n_hit = 0").select("row.*")
    text = F.coalesce("cleaned", F.col("row").getField("text"))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")
