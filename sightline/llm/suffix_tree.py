"""Language-model scoring with a probabilistic suffix tree over the bytes of normalised texts.

A text is its lower-case words joined by spaces, then an end symbol, so its bytes and its words stand
for each other and the model's probability of the bytes is one of the words.  Contexts of up to
``DEPTH`` bytes are counted over all training texts.  A context is kept if it is frequent and its
next-symbol distribution diverges from that of its suffix, or if a longer kept one ends with it.
Each distribution is smoothed towards its suffix's, by as much as it has distinct symbols (Witten and
Bell 1991), and a symbol is scored in the longest kept suffix.

What is frequent is an absolute count, so the model grows with the corpus, and no task holds it whole.
Texts look up words and contexts by chunks: a chunk of texts lists its distinct words and its distinct
codes (contexts with their symbols) once.  Codes meet the kept contexts that end with the same three bytes,
dealt by a hash of these into buckets of about ``BUCKET`` codes; words meet their counts; and each chunk gets
its answers back, those of codes in four bytes.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import collecting, crc_of_id, discard, settle
from sightline.llm.shingles import lowered_words

DEPTH = 5
LEAST_COUNT = 4
DIVERGENCE = 4.0  # count times Kullback-Leibler divergence, in nats
CHUNK_TOKENS = 6_000_000
BUFFER_BYTES = 1 << 20
END = b"\n"  # no word holds it


def normalised(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): for each byte of each text, its ``depth`` predecessors and itself in one number.

    Before its first byte a text is preceded by end symbols.
    """
    pad = END * depth
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(data), np.uint64)
    for back in range(depth + 1):
        total[back:] |= data[: len(data) - back] << np.uint64(8 * back)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + depth) - lengths
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[starts + lengths] -= 1
    return total[np.cumsum(keep[:-1]).astype(bool)], lengths


def _merged(parts):
    code = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts])
    order = np.argsort(code)
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(count, first)


def counted(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, n) over all of ``texts`` (text as bytes), summed in tasks before the shuffle."""

    def work(batches):
        texts, size, parts, held = [], 0, [], 0

        def flush():
            nonlocal texts, size
            found = np.unique(codes(texts, depth)[0], return_counts=True)
            texts, size = [], 0
            return found

        def rows(part):
            for low in range(0, len(part[0]), 100_000):
                code, n = (x[low : low + 100_000] for x in part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"]
                )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for text in batch.slice(start, 256).column(0).to_pylist():
                    texts.append(normalised(lowered_words(text)))
                    size += len(texts[-1])
                    if size >= BUFFER_BYTES:
                        parts.append(flush())
                        held += len(parts[-1][0])
                        if held > 2_000_000:  # bounds the memory of a task, not what it counts
                            parts = [_merged(parts)]
                            held = len(parts[0][0])
                            if held > 1_500_000:
                                yield from rows(parts[0])
                                parts, held = [], 0
        if texts:
            parts.append(flush())
        if parts:
            yield from rows(_merged(parts))

    return texts.mapInArrow(work, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Tree(NamedTuple):
    """By depth: kept contexts, their totals and distinct symbols; (context, symbol) pairs and counts."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 P(symbol | longest kept suffix) for each code."""
        p = np.full(len(code), 1 / 256)
        inside = np.ones(len(code), bool)
        for depth, known in enumerate(self.contexts):
            pair = code & np.uint64((1 << 8 * (depth + 1)) - 1)
            context = pair >> np.uint64(8)
            total = _find(known, self.totals[depth], context)
            kinds = _find(known, self.kinds[depth], context)
            inside &= total > 0  # the kept contexts are closed under suffixes
            n = _find(self.pairs[depth], self.counts[depth], pair)
            p = np.where(inside, (n + kinds * p) / np.maximum(total + kinds, 1), p)
        return np.log10(p)


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked))
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, values[at], 0.0)


def learn(texts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of ``texts`` (text as bytes), on the driver: for corpora whose model fits there."""
    found = kept(settle(counted(texts, depth), "codes"), depth)
    return _tree(found.select(*KEPT).toArrow(), range(depth + 1))


KEPT = ["depth", "context", "code", "n", "total"]


def kept(level: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(depth, context, code, n, total) of the kept contexts and their symbols, from (code, n)."""
    levels = []
    for d in range(depth, -1, -1):
        pair = F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
        level = settle(level.groupBy(pair.alias("code")).agg(F.sum("n").alias("n")), "level")
        context = F.shiftrightunsigned("code", 8)
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
        often = totals.where(F.lit(d == 0) | (F.col("total") >= LEAST_COUNT))
        rows = level.withColumn("context", context).join(often, "context")
        levels.append(rows.select(F.lit(d).alias("depth"), "context", "code", "n", "total"))
    frequent = levels[0]
    for rows in levels[1:]:
        frequent = frequent.unionByName(rows)
    frequent = settle(frequent, "frequent")
    below = F.expr("shiftleft(1L, 8 * depth) - 1")  # the bits of a suffix's pair
    own = frequent.where("depth > 0").withColumn("suffix_code", F.col("code").bitwiseAND(below))
    suffix = frequent.select(
        (F.col("depth") + 1).alias("depth"), F.col("code").alias("suffix_code"),
        (F.col("n") / F.col("total")).alias("q"),
    )
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q")))
    diverging = (
        own.join(suffix, ["depth", "suffix_code"]).groupBy("depth", "context").agg(gain.alias("gain"))
        .where(F.col("gain") >= DIVERGENCE)
        .select(F.explode(F.expr("sequence(1, depth)")).alias("depth"), "context")
        .select("depth", F.col("context").bitwiseAND(F.expr("shiftleft(1L, 8 * depth) - 1")).alias("context"))
        .distinct()
    )
    return frequent.where("depth = 0").unionByName(
        frequent.join(diverging, ["depth", "context"], "left_semi")
    )


def _tree(found: pa.Table, depths: range) -> Tree:
    by = {c: found[c].to_numpy() for c in found.column_names}
    contexts, sums, kinds, pairs, counts = [], [], [], [], []
    for d in depths:
        mine = by["depth"] == d
        code = by["code"][mine].view(np.uint64)
        order = np.argsort(code)
        pairs.append(code[order])
        counts.append(by["n"][mine][order].astype(float))
        context, first, several = np.unique(
            by["context"][mine].view(np.uint64), return_index=True, return_counts=True
        )
        contexts.append(context)
        kinds.append(several.astype(float))
        sums.append(by["total"][mine][first].astype(float))
    return Tree(contexts, sums, kinds, pairs, counts)


TOLD = (
    "chunk bigint, doc_id array<bigint>, held_out array<boolean>, lines binary, "
    "word boolean, keys array<bigint>, training array<bigint>"
)
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
)
LISTED = 100_000  # keys in a row of a list
LOW = 3  # depths below hold at most 256 + 256^2 + 256^3 pairs, whatever the corpus
BUCKET = 1_000_000  # codes that a task looks up at once; no ending of LOW bytes has more than 256^(depth + 1 - LOW)


def _hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def _told(texts: DataFrame, depth: int) -> DataFrame:
    """Rows of texts, and per chunk rows of its distinct words and codes with their training counts.

    A row of texts holds about ``BUFFER_BYTES`` of them, normalised, compressed together, with their ids.
    """
    numbers = pa.list_(pa.int64())
    kinds = [pa.int64(), numbers, pa.list_(pa.bool_()), pa.binary(), pa.bool_(), numbers, numbers]
    names = [x.split()[0] for x in TOLD.split(", ")]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def work(batches):
        words: Counter = Counter()
        parts, held = [], 0
        chunk, tokens = TaskContext.get().partitionId() << 32, 0  # small numbers, as each key carries one
        rows, size = [], 0

        def flush():
            nonlocal rows, size, parts, held
            for out in (False, True):
                code, n = np.unique(codes([r[2] for r in rows if r[1] == out], depth)[0], return_counts=True)
                parts.append((code, n * (not out)))
                held += len(code)
            if held > 2_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0])
            ids, outs, lines = map(list, zip(*rows, strict=True))
            done = batch_of([(chunk, ids, outs, zstandard.compress(b"".join(lines)), None, None, None)])
            rows, size = [], 0
            return done

        def listed():
            code, n = _merged(parts)
            for word, keys, counts in (
                (True, _hashes(words), np.array(list(words.values()), np.int64)), (False, code.view(np.int64), n)
            ):
                for low in range(0, len(keys), LISTED):
                    high = low + LISTED
                    yield batch_of([(chunk, None, None, None, word, keys[low:high], counts[low:high])])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for doc_id, held_out, text in zip(
                    *[c.to_pylist() for c in batch.slice(start, 256).columns], strict=True
                ):
                    mine = [*lowered_words(text), b""]  # the end, which no word equals
                    if held_out:
                        words.update(dict.fromkeys(mine, 0))
                    else:
                        words.update(mine)
                    rows.append((doc_id, held_out, normalised(mine[:-1])))
                    size += len(rows[-1][2])
                    tokens += len(mine)
                    if size >= BUFFER_BYTES:
                        yield flush()
                    if tokens >= CHUNK_TOKENS:
                        if rows:
                            yield flush()
                        yield from listed()
                        words, parts, held, chunk, tokens = Counter(), [], 0, chunk + 1, 0
        if rows:
            yield flush()
        if parts:
            yield from listed()

    return texts.mapInArrow(work, TOLD)


def _logs(asked: DataFrame, model: DataFrame, depth: int) -> DataFrame:
    """(h, v): log10 of the probability of each code ``h``; ``model`` (rows of ``kept``) must be settled.

    A code meets the contexts that end with the ``LOW`` bytes before its symbol; shallower ones are broadcast.
    """
    low = min(LOW, depth + 1)
    shallow = _tree(model.where(F.col("depth") < low).select(*KEPT).toArrow(), range(low))
    shared = asked.sparkSession.sparkContext.broadcast(tuple(shallow))

    def work(asked: pa.Table, found: pa.Table) -> pa.Table:
        deep = _tree(found, range(low, depth + 1))
        tree = Tree(*[a + b for a, b in zip(shared.value, deep, strict=True)])
        h = asked["h"].to_numpy()
        return pa.table({"h": h, "v": tree.log10(h.view(np.uint64))})

    last = F.lit((1 << 8 * LOW) - 1)
    buckets = F.lit(max(1, -(-asked.count() // BUCKET)))
    asked = asked.select("h", F.pmod(F.xxhash64(F.shiftrightunsigned("h", 8).bitwiseAND(last)), buckets).alias("bucket"))
    deep = model.where(F.col("depth") >= low).select(
        *KEPT, F.pmod(F.xxhash64(F.col("context").bitwiseAND(last)), buckets).alias("of")
    )
    return asked.groupBy("bucket").cogroup(deep.groupBy("of")).applyInArrow(work, "h bigint, v double")


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    ``held_out`` rows, by the crc of the id (a null id counts as the empty text), teach nothing.  A null
    or empty text is an end alone.  Repeated rows count as often as they stand there.  With nothing to
    learn from, every symbol has the probability of an unknown one.
    """
    told = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (crc_of_id() % 10 == 0).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    rows = settle(_told(told, depth), "told", "zstd")
    listed = rows.where("keys is not null").select(
        "chunk", "word", F.explode(F.arrays_zip("keys", "training")).alias("w")
    ).select("chunk", "word", F.col("w.keys").alias("h"), F.col("w.training").alias("n"))
    counts = settle(listed.groupBy("word", "h").agg(F.sum("n").alias("c")), "counts")
    known = counts.where("word and c > 0")
    whole = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(whole["n"]), int(whole["v"])
    asked = counts.where("not word")
    taught = asked.where("c > 0").select(F.col("h").alias("code"), F.col("c").alias("n"))
    with collecting() as levels:
        contexts = kept(taught, depth)
    model = settle(contexts, "model")
    discard(*levels)
    logs = _logs(asked, model, depth)
    values = counts.where("word").select("word", "h", "c", F.lit(None).cast("float").alias("v")).unionByName(
        logs.select(F.lit(False).alias("word"), "h", F.lit(None).cast("bigint").alias("c"), F.col("v").cast("float"))
    )
    values = settle(values, "values")
    discard(counts, model)
    docs.sparkSession._jvm.System.gc()  # Spark removes the shuffle files of what nothing refers to any more
    answers = listed.select(F.col("chunk").alias("asker"), "word", "h").join(values, ["word", "h"])

    def scored(texts: pa.Table, answered: pa.Table) -> pa.Table:
        def answer(word):
            mine = answered["word"].to_numpy() == word
            h = answered["h"].to_numpy()[mine]
            v = answered["c" if word else "v"].to_numpy()[mine].astype(float)
            order = np.argsort(h)
            return h[order], v[order]

        logs, (keys, values) = [], answer(False)
        lines, size = [], 0
        places: dict[bytes, int] = {}
        at, times, kinds_of, tokens = [], [], [], []

        def flush():
            code, lengths = codes(lines, depth)
            each = values[np.searchsorted(keys, code.view(np.int64))]
            logs.append(np.add.reduceat(each, np.cumsum(lengths) - lengths))

        for packed in texts["lines"]:
            for line in zstandard.decompress(packed.as_py()).split(END)[:-1]:
                words = line.split()
                bag = Counter(words)
                bag[b""] = 1
                at += [places.setdefault(w, len(places)) for w in bag]
                times += bag.values()
                kinds_of.append(len(bag))
                tokens.append(len(words) + 1)
                lines.append(line + END)
                size += len(line) + 1
                if size >= BUFFER_BYTES:
                    flush()
                    lines, size = [], 0
        if lines:
            flush()
        keys, values = answer(True)
        count = values[np.searchsorted(keys, _hashes(places))][np.array(at)]
        n = np.array(times)
        first = np.cumsum(kinds_of) - kinds_of
        base = n * np.log10((count + 0.1) / (total + 0.1 * (kinds + 1)))
        return pa.table({
            "doc_id": texts["doc_id"].combine_chunks().flatten(),
            "held_out": texts["held_out"].combine_chunks().flatten(), "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": np.add.reduceat(n * (count > 0), first), "base_score": np.add.reduceat(base, first),
            "score": np.concatenate(logs),
        })

    texts = rows.where("keys is null").select("chunk", "doc_id", "held_out", "lines")
    found = texts.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(scored, SCORED)
    return found.withColumn("train_tokens", F.lit(total).cast("bigint"))
