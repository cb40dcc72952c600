"""Ranges as aligned blocks and devices cut by opposing evidence, against plain Python."""

import random

from pyspark.sql import functions as F

from sightline.operators import devices, subnets

TOP = (1 << 32) - 1


def test_ranges_are_cut_into_few_exact_blocks(spark):
    rng = random.Random(3)
    ranges = [(0, 0, TOP), (1, 1, TOP - 1), (2, 5, 5), (3, 9, 8), (4, 0, 0), (5, TOP, TOP)]
    for at in range(6, 60):
        low = rng.randrange(TOP)
        ranges.append((at, low, min(TOP, low + rng.randrange(1 << rng.randrange(1, 33)))))
    frame = spark.createDataFrame(ranges, "range_id int, low bigint, high bigint")
    got = {}
    for r in subnets.range_blocks(frame).collect():
        got.setdefault(r.range_id, []).append((r.block << r.level, (r.block + 1 << r.level) - 1))
    for at, low, high in ranges:
        blocks = sorted(got.get(at, []))
        if low > high:
            assert not blocks
            continue
        assert len(blocks) <= 62 and blocks[0][0] == low and blocks[-1][1] == high
        assert all(a[1] + 1 == b[0] for a, b in zip(blocks, blocks[1:]))
    assert [r.cidr for r in subnets.range_cidrs(frame.where("range_id = 0")).collect()] == ["0.0.0.0/0"]

    numbers = [(n, rng.randrange(TOP)) for n in range(200)] + [(200, 0), (201, TOP), (202, None), (203, 5)]
    rows = spark.createDataFrame(numbers, "id int, n bigint")
    met = {(r.id, r.range_id) for r in subnets.in_ranges(rows, frame, "n", "id").collect()}
    assert met == {(i, at) for i, n in numbers if n is not None for at, low, high in ranges if low <= n <= high}
    assert subnets.in_ranges(rows, frame.where("low > high"), "n", "id").isEmpty()


def by_hand(edges, sides):
    """Distance from every node with a side, one by one; then components inside a side."""
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    best = {}
    for start, side in sides.items():
        far, front = {start: 0}, [start]
        while front:
            node = front.pop(0)
            for other in around.get(node, ()):
                if other not in far:
                    far[other] = far[node] + 1
                    front.append(other)
        for node, steps in far.items():
            best[node] = min(best.get(node, (steps, side)), (steps, side))
    side = {node: best[node][1] if node in best else None for node in around}
    label = {node: node for node in around}
    for _ in around:
        for a, b in edges:
            if side[a] == side[b]:
                label[a] = label[b] = min(label[a], label[b])
    return {(n, side[n], label[n]) for n in around}


def test_no_component_holds_two_sides(spark):
    rng = random.Random(11)
    for case, size in enumerate((6, 30, 60)):
        names = [f"n{i:02d}" for i in range(size)]
        edges = [tuple(rng.sample(names, 2)) for _ in range(int(size * 1.2))]
        edges += [("line0", "line1"), ("line1", "line2"), ("line2", "line3"), ("line3", "line4"), ("u", "v")]
        sides = {n: rng.choice("xyz") for n in names if rng.random() < 0.2}
        sides |= {"line0": "x", "line4": "y", "elsewhere": "z"}
        frame = spark.createDataFrame(edges, "a string, b string")
        told = spark.createDataFrame(list(sides.items()), "node string, side string")
        got = {tuple(r) for r in devices.parted(frame, told).collect()}
        assert got == by_hand(edges, sides), case
        # The middle of the line is as near to both and goes with the lesser side.
        assert {n for n, _, label in got if label == "line0"} == {"line0", "line1", "line2"}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "a string, b string")
    assert devices.parted(edges, edges.select(F.col("a").alias("node"), F.col("b").alias("side"))).isEmpty()
