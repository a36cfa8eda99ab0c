"""Shared by the near-duplicate operators: pairs within buckets, in blocks, and connected components.

A bucket is all rows with the same key. Buckets of any size are cut into blocks of bounded size by a hash of the
node, and every pair of blocks is a unit of work of its own, so a bucket with a third of all rows is spread over many
tasks and no pair of rows is ever a row of a frame: an Arrow function looks at the pairs of a unit in numpy and emits
at most a spanning forest of its links, or sums by node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, discard, ship_with

#: Rows of a block, and pairs that numpy looks at in one go.
BLOCK_ROWS, PAIRS_AT_ONCE = 8192, 1 << 20


def in_blocks(rows: DataFrame, block: int = BLOCK_ROWS, payload: DataFrame | None = None) -> DataFrame:
    """Rows (key, node, ...) dealt out and sorted by unit of work (key, a, b): blocks a <= b of the key's bucket.

    Rows that are alone in their bucket go. `own` is the block that a row itself is in. A bucket of n rows sends
    n / block copies of each. payload (node, ...), if any, is joined when only rows with company are left.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "other")
    if payload is not None:
        dealt = dealt.join(payload, "node")
    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units from sorted batches, with the offsets of the units; a unit is never cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks()
        starts = unit_starts(whole)
        if len(starts) > 1:
            last = int(starts[-1])
            yield whole.slice(0, last), np.append(starts[:-1], last)
            held = whole.slice(last).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        if whole.num_rows:
            yield whole, np.append(unit_starts(whole), whole.num_rows)


def unit_starts(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in ("key", "a", "b"):
        value = rows.column(name).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)


def pairs(rows: pa.Table, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of the rows of every pair of each unit, a bounded number at once.

    Of a unit of one block all pairs, of a unit of two the pairs across them.
    """
    own, across = rows.column("own").to_numpy(), rows.column("a").to_numpy() != rows.column("b").to_numpy()
    partners = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(rows.num_rows) - 1
    upto = np.cumsum(partners)
    start = 0
    while start < rows.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        n = partners[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        kept = ~across[i] | (own[i] != own[j])
        yield i[kept], j[kept]
        start = end


class Joined:
    """Which of n things are connected, while links come in; links between connected ones cost a look-up only."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        label = np.arange(len(self.label))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        self.label = label[self.label]

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A link for each thing but one of each connected group."""
        other = np.flatnonzero(self.label != np.arange(len(self.label)))
        return nodes[other], nodes[self.label[other]]


def links_of(units_frame: DataFrame, linked: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], node_type: str) -> DataFrame:
    """A spanning forest (u, v) of the links within each unit; linked(rows, i, j) says which pairs link."""

    def run(batches):
        for rows, offsets in units(batches):
            joined = Joined(rows.num_rows)
            for i, j in pairs(rows, offsets):
                if len(i):
                    kept = linked(rows, i, j)
                    joined.add(i[kept], j[kept])
            u, v = joined.edges(rows.column("node").to_numpy())
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return ship_with(units_frame).mapInArrow(run, f"u {node_type}, v {node_type}")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link: the smallest node that links lead to.

    Alternating large-star and small-star steps (a logarithmic number of rounds). Each is two aggregations and two
    joins over edges, with the state in the shared checkpoint folder from round to round (the files of the round
    before go); nothing is collected but a count and a checksum.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, cut(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
