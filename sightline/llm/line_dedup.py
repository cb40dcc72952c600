"""Line deduplication by content-defined chunks of lines and by repeated passages.

A rolling hash over the hashes of the last ``ROLL`` lines ends a chunk wherever it hits one residue
of ``PERIOD``, so boundaries move with the content and an insertion shifts none behind it.  Chunks of
several lines that occur again anywhere are removed but for the first occurrence.

Chunks at the ends of a passage are cut together with what surrounds it.  Passages need no boundaries:
every line starts the shortest run of lines of more than so many words, and ends one.  Any longer run
is covered by such runs inside it, so a run that occurs again is found whole, wherever it stands.

Each line to be removed is compared byte by byte with the one that it repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, settle

ROLL = 2
PERIOD = 3
PASSAGE = 50  # words that a repeated passage has more than


def chunks(lines: list[bytes], roll: int = ROLL, period: int = PERIOD) -> list[tuple[int, int]]:
    """(first line, end) of each chunk."""
    if not lines:
        return []
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    rolled = np.zeros(len(lines), np.uint64)
    for back in range(roll):
        rolled[back:] += hashes[: len(lines) - back] * np.uint64(0x9E3779B97F4A7C15 + 2 * back)
    ends = np.flatnonzero((rolled >> np.uint64(17)) % np.uint64(period) == 0) + 1
    bounds = [0, *[int(e) for e in ends if e < len(lines)], len(lines)]
    return list(zip(bounds, bounds[1:], strict=False))


def _several(lines: list[bytes]) -> bool:
    """Whether two lines or more hold a word."""
    return sum(bool(x.strip()) for x in lines) > 1


def _lines(text: bytes | None) -> list[bytes]:
    return text.split(b"\n") if text else []


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, first, row, text): ``key`` is the same for rows of the same id and text only."""
    text = F.coalesce("text", F.lit(""))
    named = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    return docs.select(
        F.unhex(F.sha2(named, 256)).alias("key"),
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        text.cast("binary").alias("text"),
    )


def runs(lines: list[bytes], over: int) -> set[tuple[int, int]]:
    """(first line, end) of the shortest runs of more than ``over`` words from each line on and up to each line.

    Runs start and end with a line that holds a word, so a line lies in at most two for each of ``over`` words.
    """
    words = np.cumsum([0, *[len(x.split()) for x in lines]])
    start = np.arange(len(words))
    ends = np.searchsorted(words, words + over + 1)
    begins = np.searchsorted(words, words - over - 1, "right") - 1
    worded = np.append(np.diff(words) > 0, False)
    from_here = worded & (ends < len(words))
    up_to_here = (begins >= 0) & np.append(False, worded[:-1])
    return {*zip(start[from_here].tolist(), ends[from_here].tolist(), strict=True),
            *zip(begins[up_to_here].tolist(), start[up_to_here].tolist(), strict=True)}


def _told(over: int | None):
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for key, doc_id, text in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True):
                    lines = _lines(text)
                    found = {(a, b) for a, b in chunks(lines) if _several(lines[a:b])}
                    if over is not None:
                        found |= runs(lines, over)
                    out += [(key, doc_id, a, b - a, xxhash.xxh3_128_digest(b"\n".join(lines[a:b]))) for a, b in found]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "i", "n", "digest"]
                )

    return work


def _bytes_of(batches):
    """Each line asked for, once: as one that others repeat, and with the one that it repeats itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            out = []
            for key, text, asked in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True):
                lines = _lines(text)
                origins, repeats = set(), {}
                for x in asked:
                    i, n, at, of = x["i"], x["n"], x["at_i"], x["at_key"]
                    if of == key and at == i:
                        origins.update(range(i, i + n))
                        continue
                    # A run that overlaps its first occurrence leaves that one whole.
                    for j in range(max(0, at + n - i) if of == key else 0, n):
                        repeats.setdefault(i + j, set()).add((of, at + j))
                out += [(key, i, key, i, lines[i]) for i in origins]
                out += [(*min(of), key, i, lines[i]) for i, of in repeats.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["of_key", "of_i", "key", "i", "line"],
            )


def _cut(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            out = []
            texts = part["row"].field("text").to_pylist()
            for text, gone in zip(texts, part["gone"].to_pylist(), strict=True):
                lines = _lines(text.encode() if text else None)
                places = chunks(lines)
                gone = set(gone or ())
                kept = [x for i, x in enumerate(lines) if i not in gone]
                whole = sum(gone.issuperset(range(a, b)) for a, b in places)
                out.append((len(lines), len(places), whole, len(gone), b"\n".join(kept).decode()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part["row"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["row", "n_lines", "n_chunks", "removed_chunks", "removed_lines", "cleaned"],
            )


def dedup(docs: DataFrame, over: int | None = None) -> DataFrame:
    """(row, n_lines, n_chunks, removed_chunks, removed_lines, cleaned) for every row of ``docs``.

    With ``over``, every run of lines of more than so many words that occurs again is removed besides
    the chunks, a single line too; without it chunks alone are.  The first occurrence is that of the
    smallest doc_id (null ids last), then the earliest in the text; a run that overlaps its first
    occurrence is removed from where that one ends.  Chunks with fewer than two lines that hold a word
    count only as runs.  ``removed_chunks`` counts the chunks of which no line is left.  A null or empty
    text has no lines.  Rows of the same id and text are one document and share its result.
    """
    keyed = _keyed(docs)
    told = settle(
        keyed.select("key", "doc_id", "text")
        .mapInArrow(_told(over), "key binary, doc_id bigint, i int, n int, digest binary"),
        "chunks",
    )
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "i")
    again = told.groupBy("digest").agg(F.min(where).alias("at"), F.count("*").alias("times")).where("times > 1")
    asked = (
        told.join(again, "digest")
        .select("key", F.struct("i", "n", F.col("at.key").alias("at_key"), F.col("at.i").alias("at_i")).alias("x"))
        .groupBy("key").agg(F.collect_set("x").alias("asked"))
    )
    texts = keyed.join(asked, "key").select("key", "text", "asked")
    shown = settle(
        texts.mapInArrow(_bytes_of, "of_key binary, of_i int, key binary, i int, line binary"), "shown"
    )
    discard(told)
    # Rows of the same id and text are one document, so a line that others repeat is one per key and place.
    first = (F.col("key") == F.col("of_key")) & (F.col("i") == F.col("of_i"))
    origin = shown.where(first).groupBy("of_key", "of_i").agg(F.first("line").alias("origin"))
    same = shown.where(~first).join(origin, ["of_key", "of_i"]).where(F.col("line") == F.col("origin"))
    gone = same.groupBy("key").agg(F.collect_set("i").alias("gone"))
    # The text goes once, inside its row.
    rows = keyed.drop("doc_id", "text").join(gone, "key", "left").select("row", "gone")
    schema = rows.select("row", *[F.lit(None).cast(k).alias(c) for c, k in (
        ("n_lines", "bigint"), ("n_chunks", "bigint"), ("removed_chunks", "bigint"),
        ("removed_lines", "bigint"), ("cleaned", "string"))]).schema
    return rows.mapInArrow(_cut, schema)
