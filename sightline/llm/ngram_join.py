"""N-gram Jaccard join with token-combination prefixes.

A token is a hashed word shingle of a text; texts with the same set of tokens form one class, which
is joined once.  Two classes link when they share ``T`` per cent of their tokens.

1. Filter.  At most n - ceil(T n) tokens of a linked class are its own alone.  Over the fixed
   share ``SAMPLE`` of the hash space, classes with more lone tokens than that are done.
2. Prefixes.  The rest are ordered by document frequency.  Tokens of up to ``RARE`` classes are
   indexed alone.  Frequent tokens are dealt to groups, and two of the same group are indexed
   together: each group weakens the prefix by one, so the prefix is extended by as many tokens
   (the k-wise signatures of Wang et al. 2016, with k = 1 and 2).  The number of groups follows the
   size of the set, so the combinations stay in proportion to its tokens.
3. Verify.  Within an index key, all classes are first held against one of them; keys whose
   classes are then in one component are done.  In the others, pairs of different components that
   pass size and bitmap bounds and share enough 32-bit tokens are verified in full, a spanning
   forest at a time, until none is left.
   Large keys are cut into blocks, and every pair of blocks is looked at.  No pair that could be a
   new link is left out, and no key lists all its pairs.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SPACES, attached, components, row_hash, settle
from sightline.llm.shingles import lowered_words, parity, shingle_hashes, shortened

WORDS = 4
PER_CENT = 85
SAMPLE = 0.3
RARE = 2048
BLOCK = 1024
BITS = 4  # of a bitmap, for each token
BROADCAST_CLASSES = 1_000_000  # hashes of candidate texts, 8 bytes each, that are broadcast


def _lists(arrays) -> pa.Array:
    """A list array from numpy arrays."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _described(docs: DataFrame, row: Column, size: int) -> DataFrame:
    """(row, k, line, n, low): the class, a hash of the text, the number of tokens, and the sampled ones."""
    bound = np.int64(round((SAMPLE - 0.5) * 2**64))

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys, counts, low = [], [], []
                for text in part.column("_text").to_pylist():
                    words = lowered_words(text)
                    found = shingle_hashes(words, size)
                    keys.append(_class(found))
                    counts.append(len(found))
                    low.append(found[found < bound])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(keys, pa.int64()), part.column("line"),
                     pa.array(counts, pa.int64()), _lists(low)],
                    ["row", "k", "line", "n", "low"],
                )

    packed = docs.select(
        row.alias("row"), F.xxhash64("text").alias("line"), F.col("text").cast("binary").alias("_text")
    )
    schema = packed.select("row", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("k", "bigint"), ("line", "bigint"), ("n", "bigint"), ("low", "array<bigint>"))]).schema
    return packed.mapInArrow(work, schema)


def _class(tokens: np.ndarray) -> int | None:
    """Names the set of tokens; None for an empty one."""
    if not len(tokens):
        return None
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _token_sets(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(k, tokens, bits, short) of each class of ``asked`` (k, line), from a text with that hash.

    ``bits`` and ``short`` are a parity bitmap and 32-bit forms of the tokens.  Texts are met with the
    hashes by a semi join: up to ``BROADCAST_CLASSES`` hashes are broadcast, so no text moves; beyond
    them Spark shuffles the texts once, and the result is the same.
    """
    hashes = asked.select("line")
    if asked.count() <= BROADCAST_CLASSES:
        hashes = F.broadcast(hashes)

    def work(batches):
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys, tokens, bits, short = [], [], [], []
                for text, line in zip(part.column("text").to_pylist(), part.column("line").to_pylist(), strict=True):
                    if line in seen:
                        continue
                    seen.add(line)  # at most the rows of a task
                    found = shingle_hashes(lowered_words(text), size)
                    keys.append(_class(found))
                    tokens.append(found)
                    short.append(shortened(found))
                    bits.append(parity(short[-1], BITS * len(found)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), _lists(tokens),
                     pa.array(bits, pa.binary()), pa.array([x.tobytes() for x in short], pa.binary())],
                    ["k", "tokens", "bits", "short"],
                )

    texts = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("line"))
    wanted = texts.join(hashes, "line", "left_semi").select("text", "line")
    found = wanted.mapInArrow(work, "k bigint, tokens array<bigint>, bits binary, short binary")
    return found.where("k is not null").dropDuplicates(["k"])


def _needed(n: int, per_cent: int) -> int:
    """Tokens a set of ``n`` must share with any set it links with."""
    return -(-per_cent * n // 100)


def _bands(n: int, per_cent: int) -> list[int]:
    """Size bands (powers of two) of the sets that one of ``n`` tokens may link with."""
    low, high = max(1, _needed(n, per_cent)), 100 * n // per_cent
    return list(range(low.bit_length() - 1, high.bit_length()))


def index_keys(n: int, frequency: np.ndarray, token: np.ndarray, rare: int, per_cent: int) -> list[int]:
    """Index keys of a set of ``n`` tokens, given those not alone in it with their frequencies."""
    need = n - _needed(n, per_cent) + 1 - (n - len(token))
    if need <= 0:
        return []
    token = token[np.lexsort((token, frequency))]
    singles = int((frequency <= rare).sum())
    keys = token[: min(need, singles)].tolist()
    need -= len(keys)
    if need <= 0:
        return keys
    frequent = token[singles:].tolist()
    for band in _bands(n, per_cent):
        groups = max(1, (1 << band) >> 4)
        members: dict[int, list[int]] = {}
        left = need
        for h in frequent:
            mine = members.setdefault((h >> 7) % groups, [])
            keys += [_pair(h, other, band) for other in mine]
            left -= bool(mine)
            mine.append(h)
            if left <= 0:
                break
    return keys


def _pair(a: int, b: int, band: int) -> int:
    text = b"%d %d %d" % (min(a, b), max(a, b), band)
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def _indexed(sets: DataFrame, rare: int, per_cent: int) -> DataFrame:
    """(key, k, n, alone) for every index key that two classes or more have."""
    tokens = sets.select("k", F.size("tokens").alias("n"), F.explode("tokens").alias("h"))
    shared = tokens.groupBy("h").count().where("count > 1")
    told = (
        tokens.join(shared, "h").groupBy("k", "n")
        .agg(F.collect_list(F.struct(F.col("count").alias("f"), "h")).alias("shared"))
    )

    def work(batches):
        for batch in batches:
            ks, ns, lists = (batch.column(c) for c in ("k", "n", "shared"))
            ends = lists.offsets.to_numpy()
            inside = lists.values
            frequency, token = inside.field("f").to_numpy(), inside.field("h").to_numpy()
            out: list[tuple] = []
            for k, n, a, b in zip(ks.to_pylist(), ns.to_pylist(), ends, ends[1:], strict=False):
                found = index_keys(n, frequency[a:b], token[a:b], rare, per_cent)
                out += [(key, k, n, n - int(b - a)) for key in set(found)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["key", "k", "n", "alone"]
            )

    rows = settle(told.mapInArrow(work, "key bigint, k bigint, n bigint, alone bigint"), "index")
    many = rows.groupBy("key").count().where("count > 1").select("key")
    return settle(rows.join(many, "key"), "keys")


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b, linked) of distinct pairs."""
    a = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    either = F.size("ta") + F.size("tb") - both
    return pairs.join(b, "b").join(a, "a").select("a", "b", (100 * both >= per_cent * either).alias("linked"))


def _near(n, label, side, bits, per_cent):
    """(r, rows): for each row the later ones of other labels that size and bitmap bounds let pass."""
    ratio = per_cent / (100 + per_cent)
    size = np.array([len(x) for x in bits])
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        twice = np.flatnonzero(size == 2 * width)
        rest = np.concatenate([own, twice])
        maps = np.array([bits[i] for i in own] + [bits[i][:width] ^ bits[i][width:] for i in twice])
        for at, r in enumerate(own):
            s = rest[at + 1 :]
            fits = (label[s] != label[r]) & (100 * n[r] >= per_cent * n[s])
            if side[r] >= 0:  # two different blocks: pairs inside either are looked at elsewhere
                fits &= side[s] != side[r]
            s, near = s[fits], maps[at + 1 :][fits]
            total = n[s] + n[r]
            apart = np.bitwise_count(near ^ maps[at]).sum(axis=1)
            s = s[apart <= total - 2 * np.ceil(ratio * total - 1e-9)]
            if len(s):
                yield r, s


def _sorted(table: pa.Table):
    t = table.sort_by([("n", "ascending"), ("k", "ascending")])
    labels, label = np.unique(t["label"].to_numpy(), return_inverse=True)
    return t, t["k"].to_numpy(), t["n"].to_numpy(), label, t["side"].to_numpy()


def _plausible(rows: DataFrame, per_cent: int) -> DataFrame:
    """(key, i, j, k): the rows of blocks that have a partner by their bitmaps."""

    def look(table: pa.Table) -> pa.Table:
        t, _, n, label, side = _sorted(table)
        bits = [np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()]
        seen = np.zeros(len(n), bool)
        for r, s in _near(n, label, side, bits, per_cent):
            seen[r] = seen[s] = True
        return t.select(["key", "i", "j", "k"]).filter(pa.array(seen))

    kept = rows.select("key", "i", "j", "k", "n", "label", "side", "bits")
    return kept.groupBy("key", "i", "j").applyInArrow(look, "key bigint, i int, j int, k bigint")


def _forests(rows: DataFrame, per_cent: int) -> DataFrame:
    """(key, i, j, a, b): likely links that would join different components, a spanning forest per block."""

    def forest(table: pa.Table) -> pa.Table:
        t, k, n, label, side = _sorted(table)
        refused = [set(x or ()) for x in t["refused"].to_pylist()]
        short = [np.frombuffer(x, np.uint32) for x in t["short"].to_pylist()]
        # Equal low halves within a set may hide a shared token: so many at most.
        hidden = n - np.array([len(x) for x in short])
        bits = [parity(x, 16 * m) for x, m in zip(short, n, strict=True)]
        out: list[tuple[int, int]] = []
        for r, s in _near(n, label, side, bits, per_cent):
            for j in s:
                if label[j] == label[r] or k[j] in refused[r] or k[r] in refused[j]:
                    continue
                both = len(np.intersect1d(short[r], short[j], assume_unique=True)) + min(hidden[r], hidden[j])
                if (100 + per_cent) * both >= per_cent * (n[r] + n[j]):
                    out.append((k[r], k[j]))
                    label[label == label[j]] = label[r]
        a, b = zip(*out, strict=True) if out else ((), ())
        here = {c: pa.array([t[c][0].as_py()] * len(out), t.schema.field(c).type) for c in ("key", "i", "j")}
        return pa.table(here | {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(forest, "key bigint, i int, j int, a bigint, b bigint")


def _labelled(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    roots = settle(components(links), "roots")
    mine = rows.join(roots, rows["k"] == roots["node"], "left")
    return roots, mine.withColumn("label", F.coalesce("root", "k")).drop("node", "root")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(sets: DataFrame, per_cent: int = PER_CENT, rare: int = RARE, block: int = BLOCK):
    """(links (a, b), roots (node, root)) of the settled classes ``sets`` (k, tokens, short)."""
    index = _indexed(sets, rare, per_cent)
    pivot = index.groupBy("key").agg(F.min(F.struct("alone", "k", "n")).alias("p"))
    fits = 100 * F.least("n", F.col("p.n")) >= per_cent * F.greatest("n", F.col("p.n"))
    pairs = index.join(pivot, "key").where(F.col("k") != F.col("p.k")).where(fits)
    pairs = settle(pairs.select(F.col("p.k").alias("a"), F.col("k").alias("b")).distinct(), "pairs")
    judged = settle(_verified(pairs, sets, per_cent), "judged")
    again = None
    while True:
        roots, rows = _labelled(index, judged.where("linked").select("a", "b"))
        if again is not None and again.isEmpty():
            return judged.where("linked").select("a", "b"), roots
        rows = settle(rows, "labelled")
        mixed = rows.groupBy("key").agg(
            F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")
        ).where("x <> y").select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
        open_ = (
            rows.join(mixed, "key")
            .join(sets.select("k", "bits"), "k")
            .withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .withColumn("side", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("block")))
        )
        # A block whose likely links all held has no other left; those with a refusal come again.
        open_ = open_ if again is None else open_.join(again, ["key", "i", "j"], "left_semi")
        near = settle(_plausible(open_, per_cent), "near")
        # A refusal is kept at its second class: it is not the one that many are held against.
        refused = judged.where("not linked").groupBy("b").agg(F.collect_list("a").alias("refused"))
        about = (
            near.select("k").distinct()
            .join(sets.select("k", "short"), "k")
            .join(refused, F.col("k") == F.col("b"), "left").drop("b")
        )
        some = rows.select("key", "k", "n", "label")
        side = F.when(F.col("i") == F.col("j"), -1).otherwise(F.pmod(F.xxhash64("k"), F.col("blocks")))
        near = near.join(some, ["key", "k"]).join(mixed, "key").withColumn("side", side.cast("int"))
        found = settle(_forests(
            near.join(about, "k").select("key", "i", "j", "k", "n", "label", "short", "refused", "side"),
            per_cent,
        ), "pairs")
        if found.isEmpty():
            return judged.where("linked").select("a", "b"), roots
        new = settle(_verified(found.select("a", "b").distinct(), sets, per_cent), "verified")
        again = found.join(new.where("not linked"), ["a", "b"]).select("key", "i", "j").distinct()
        again = settle(again, "again")
        judged = settle(judged.unionByName(new), "judged")


def join(docs: DataFrame, row: Column | None = None, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """(row, doc_id, n_shingles, label, component_id) for every row of ``docs``.

    ``label`` names the component (null for texts without words, which link with nothing), and
    ``component_id`` is its smallest doc_id.  ``row`` packs the input's columns unless another column
    is given.  Repeated rows and ids share a class; a null id never is the smallest, and a component
    of null ids has a null one.  Tokens and classes are told apart by 64-bit hashes.
    """
    carried = F.struct(F.col("doc_id"), (F.struct("*") if row is None else row).alias("row"))
    told = settle(_described(docs, carried, words), "described")
    told = told.select("row.row", "row.doc_id", "k", "line", "n", "low")
    lone = (
        told.select("k", F.explode("low").alias("h"))
        .groupBy("h").agg(F.min("k").alias("k"), F.max("k").alias("y")).where("k = y")
        .groupBy("k").agg(F.count("*").alias("lone"))
    )
    spare = F.col("n") - F.ceil(F.col("n") * per_cent / 100)
    classes = told.where("n > 0").groupBy("k").agg(F.max("n").alias("n"), F.min("line").alias("line"))
    asked = settle(
        classes.join(lone, "k", "left").where(F.coalesce("lone", F.lit(0)) <= spare).select("k", "line"),
        "asked",
    )
    sets = settle(_token_sets(docs, asked, words), "sets")
    _, roots = links(sets, per_cent)
    named = told.join(roots, told["k"] == roots["node"], "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "k").alias("label")
    )
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    alone = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "label", "left").select(
        "row", "doc_id", "n_shingles", "label", alone.alias("component_id")
    )


def first_of_each(docs: DataFrame, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, the least hash among equals.

    Texts without words link with nothing, so all of them stay.
    """
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == ""
    found = join(docs.where(~bare), row_hash(docs), words, per_cent)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    best = found.groupBy("label").agg(F.min_by("row", key).alias("row_hash")).select("row_hash")
    return attached(docs.where(~bare), best).select("row.*").unionByName(docs.where(bare))
