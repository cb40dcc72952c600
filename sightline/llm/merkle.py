"""Merkle manifest of a dataset, by time-forward processing.

Every node of the hash tree has a label; children have smaller labels than their parents.  A priority
queue ordered by label delivers each child's digest to its parent, which is hashed when its label comes
up; then a sweep in reverse order delivers to every node the rest of its proof, from the root down.

The queue is external: labels are cut into blocks of ``FAN ** LEVELS`` neighbours of a level with all
that is above them for ``LEVELS`` levels.  Inside a block the queue is a heap; what leaves a block is a
row of the next round's table in the shared folder, dealt to the block it is addressed to.  So a task
holds one block, however many leaves a tree has, and the rounds grow with the logarithm of its size.

There is one tree per language, whose leaves ascend by id, and one over the languages' roots.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import crc_of_id, lookup_small, settle
from sightline.plans.ordering import with_position

FAN = 8
LEVELS = 4
BROADCAST_TREES = 50_000
PAIR = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def hashed(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values, each told with its length; ``-`` for a null one."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _sizes(n: int, levels: int | None) -> list[int]:
    """Nodes by level over ``n`` leaves: up to one node, or so many levels."""
    sizes = [n]
    while len(sizes) <= levels if levels else sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


class Block:
    """The part of a tree above some neighbouring nodes; label = first label of its level + place."""

    def __init__(self, digests: list[str], levels: int | None):
        self.sizes = _sizes(len(digests), levels)
        self.first = [sum(self.sizes[:i]) for i in range(len(self.sizes))]
        self.digests = digests
        self.runs: dict[int, list[str]] = {}
        self.root = self._forward()

    def _nodes(self) -> Iterator[tuple[int, int, int]]:
        for level, size in enumerate(self.sizes):
            for place in range(size):
                yield level, place, self.first[level] + place

    def _forward(self) -> str:
        queue: list[tuple[int, int, str]] = []
        digest = ""
        for level, place, label in self._nodes():
            if level == 0:
                digest = self.digests[place]
            else:
                run = []
                while queue and queue[0][0] == label:
                    run.append(heapq.heappop(queue)[2])
                self.runs[label] = run
                digest = sha256("".join(run).encode()).hexdigest()
            if level + 1 < len(self.sizes):
                heapq.heappush(queue, (self.first[level + 1] + place // FAN, label, digest))
        return digest

    def proofs(self, rest: tuple | None) -> list[list[tuple[str, str]]]:
        """For each leaf the siblings to its left and right, level by level; ``rest`` is the root's own."""
        found: list[list[tuple[str, str]]] = [[] for _ in self.digests]
        top = self.first[-1]
        queue: list[tuple[int, tuple | None]] = [(-top, rest)]
        for level, place, label in reversed(list(self._nodes())):
            suffix = heapq.heappop(queue)[1]
            if level == 0:
                while suffix:
                    found[place].append(suffix[0])
                    suffix = suffix[1]
                continue
            run = self.runs[label]
            below = self.first[level - 1] + place * FAN
            for k in range(len(run)):
                pair = ("".join(run[:k]), "".join(run[k + 1 :]))
                heapq.heappush(queue, (-(below + k), (pair, suffix)))
        return found


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        told = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        start = 0
        for i, key in enumerate(told):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if len(told) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _up(fan_levels: int):
    def up(batches):
        for group in _groups(batches, 2):
            n = group["n"][0].as_py()
            whole = n <= FAN**fan_levels
            block = Block(group["digest"].to_pylist(), None if whole else fan_levels)
            yield pa.RecordBatch.from_arrays(
                [
                    group["tree"].slice(0, 1).combine_chunks(), group["block"].slice(0, 1).combine_chunks(),
                    pa.array([1 if whole else -(-n // FAN**fan_levels)], pa.int64()),
                    pa.array([block.root], pa.string()),
                ],
                ["tree", "pos", "n", "digest"],
            )

    return up


def _down(fan_levels: int):
    def down(batches):
        for group in _groups(batches, 2):
            # The message to the block comes first, then its nodes.
            rest = None
            for pair in reversed(group["proof"][0].as_py()):
                rest = ((pair["left"], pair["right"]), rest)
            root = group["subroot"][0].as_py()
            nodes = group.slice(1).combine_chunks()
            n = nodes["n"][0].as_py()
            block = Block(nodes["digest"].to_pylist(), None if n <= FAN**fan_levels else fan_levels)
            proofs = block.proofs(rest)
            flat = [pair for proof in proofs for pair in proof]
            ends = [0]
            for proof in proofs:
                ends.append(ends[-1] + len(proof))
            pairs = pa.StructArray.from_arrays(
                [pa.array([p[i] for p in flat], pa.string()) for i in (0, 1)], ["left", "right"]
            )
            told = {c: nodes[c].combine_chunks() for c in ("tree", "pos", "digest", "row")}
            told["proof"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            told["subroot"] = pa.array([root] * len(nodes), pa.string())
            yield pa.RecordBatch.from_arrays(list(told.values()), list(told))

    return down


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _block(pos: str, fan_levels: int) -> Column:
    return F.floor(F.col(pos) / FAN**fan_levels).cast("bigint").alias("block")


def climb(nodes: DataFrame, fan_levels: int = LEVELS) -> list[DataFrame]:
    """The rounds' tables (tree, pos, n, digest, row): ``nodes`` first, then the blocks' roots.

    ``n`` counts the nodes of the tree at that level; a row with ``n = 1`` is its tree's root.
    """
    rounds = [nodes]
    kind = nodes.schema["row"].dataType
    while not rounds[-1].where("n > 1").isEmpty():
        asked = rounds[-1].where("n > 1").select("tree", _block("pos", fan_levels), "pos", "n", "digest")
        made = _dealt(asked, "pos").mapInArrow(_up(fan_levels), "tree string, pos bigint, n bigint, digest string")
        rounds.append(settle(made, "nodes").withColumn("row", F.lit(None).cast(kind)))
    return rounds


def descend(rounds: list[DataFrame], roots: DataFrame, fan_levels: int = LEVELS) -> DataFrame:
    """(tree, pos, digest, row, proof, subroot) of every node of the first round.

    ``roots`` (tree, proof, subroot) tells what the proof of each tree's root is.
    """
    found = None
    for nodes in reversed(rounds):
        mine = nodes.where("n = 1").join(roots, "tree").select("tree", "pos", "digest", "row", "proof", "subroot")
        if found is not None:
            sent = found.select(
                "tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"),
                F.lit(None).cast(nodes.schema["row"].dataType).alias("row"), "proof", "subroot",
            )
            asked = nodes.where("n > 1").select(
                "tree", _block("pos", fan_levels), "pos", "n", "digest", "row",
                F.lit(None).cast(PAIR).alias("proof"), F.lit(None).cast("string").alias("subroot"),
            )
            kind = nodes.schema["row"].dataType.simpleString()
            mine = mine.union(_dealt(asked.union(sent), "pos").mapInArrow(
                _down(fan_levels),
                f"tree string, pos bigint, digest string, row {kind}, proof {PAIR}, subroot string",
            ))
        found = mine if nodes is rounds[0] else settle(mine, "proofs")
    return found


def _roots(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [r.where("n = 1").select("tree", "digest") for r in rounds])


def manifest(leaves: DataFrame, fan_levels: int = LEVELS) -> DataFrame:
    """(row, leaf, subroot, root, proof) for every row of ``leaves`` (doc_id, lang, leaf, ...).

    ``row`` packs the columns but the leaf, whatever their names.  Per ``lang`` leaves ascend by
    ``doc_id``, null first, ties by the leaf; every ``FAN`` neighbours become the hash of their digests
    until one is left, the subroot.  The subroots, by ``lang`` (null first), give the root alike.
    ``proof`` has per level the digests left and right of the leaf's own, up to the root.  Repeated
    rows are leaves of their own; an empty table gives none.
    """
    # Null sorts before every language; the joins below need a value.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c != "leaf"]).alias("row")
    told = leaves.select(tree.alias("tree"), F.col("doc_id").alias("_id"), F.col("leaf").alias("digest"), row)
    placed = settle(with_position(told, ["tree"], ["_id", "digest"], "pos").drop("_id"), "leaves")
    counts = settle(placed.groupBy("tree").agg(F.count("*").alias("n")), "trees")
    rounds = climb(lookup_small(placed, counts, "tree", BROADCAST_TREES, "digest"), fan_levels)

    subroots = settle(_roots(rounds), "subroots")
    over = subroots.select(F.lit("").alias("top"), F.struct("tree").alias("row"), "tree", "digest")
    over = with_position(over, ["top"], ["tree"], "pos")
    over = over.select(F.col("top").alias("tree"), "pos", F.lit(counts.count()).cast("bigint").alias("n"), "digest", "row")
    above = climb(settle(over, "subroots"), fan_levels)
    end = _roots(above).select("digest").first()
    root = end[0] if end else None  # one digest
    whole = above[-1].select("tree", F.array().cast(PAIR).alias("proof"), F.col("digest").alias("subroot")).where(
        F.col("subroot") == root
    )
    handed = descend(above, whole, fan_levels).select(
        F.col("row.tree").alias("tree"), "proof", F.col("digest").alias("subroot")
    )
    found = descend(rounds, settle(handed, "proofs"), fan_levels)
    return found.select("row", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof")


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def checked(docs: DataFrame, fan_levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``folded_root`` is what the proof gives for the row as it is read back: every third row, by a hash
    of its id, has its text lower-cased first and is found out where that changes it.
    """
    fields = [F.col(c) for c in FIELDS]
    leaf = hashed(*fields)
    other = hashed(*fields[:-1], F.translate("text", UPPER, UPPER.lower()))
    leaves = docs.select(
        "doc_id", "lang", leaf.alias("leaf"), F.when(crc_of_id() % 3 == 0, other).otherwise(leaf).alias("read")
    )
    return manifest(leaves, fan_levels).select(
        "row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("row.read"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
