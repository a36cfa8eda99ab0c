"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation for balanced binary codes is learned (PCA, then iterative quantisation) on a bounded sample of vectors, once
for each of a few starting points; every vector is indexed. Its codes are cut into substrings, each of which is the key
of a table; vectors that share a key are candidates, and all candidates are reranked with the original vectors: links
are cosines in double precision at or above the threshold. The substring length follows the logarithm of the number of
vectors. Pairs at the threshold are planted around the sampled vectors, pairs a little above it are taken from the sample,
and tables are added until enough of each kind meet; where that takes too many tables, substrings become shorter. The
number of rotations is what the tables need. Where most of any two vectors would meet, all pairs are compared.

Equal vectors are one node. Buckets of any size are worked on in blocks; a pair counts in the first table that it
meets in, so numpy can sum up links where it finds them, and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import links
from tracewright.llm.common import cut, one_blas_thread, ship_with, table
from tracewright.llm.keyed import join_many

THRESHOLD = 0.95
#: Most vectors that rotations are learned from, ITQ steps, and the chance that a link at the threshold is missed.
SAMPLE, STEPS, MISS = 10_000, 30, 0.003
LEAST_KEY_BITS, CODE_BITS = 12, 64
#: Planted pairs of each kind that recall is measured on; beyond so many tables keys get shorter; rows made at once.
PLANTED, MOST_TABLES, KEYED = 10_000, 128, 100_000
#: Sampled vectors whose neighbours in the sample are looked for; where so many of any two vectors meet, all are compared.
ASKED, CROWDED = 2_000, 0.5
#: Up to this size, units of work are looked at pair by pair together; larger ones each by matrix products of so many rows.
SMALL_UNIT, PRODUCT_ROWS = 48, 512
#: Bytes of the vectors of a block; cosines that are nearer to the threshold are summed up again, in one order.
BLOCK_BYTES, NEAR = 2 << 20, 1e-9


def itq(sample: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are balanced binary codes of normalised vectors."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    pca = axes[: min(CODE_BITS, sample.shape[1])].T
    v = x @ pca
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(pca.shape[1],) * 2))[0]
    for _ in range(STEPS):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, pca @ rotation


def untrained(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For dimensions with too few vectors to learn from: a random rotation."""
    q = np.linalg.qr(np.random.default_rng(seed + 1000 * dim).normal(size=(dim, dim)))[0]
    return np.zeros(dim), q[:, : min(CODE_BITS, dim)]


def planted(sample: np.ndarray, threshold: float, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the threshold: away from sampled ones in any direction, and in those in which they differ."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), PLANTED)]
    out = []
    for away in (rng.normal(size=x.shape), sample[rng.integers(0, len(sample), PLANTED)] - sample[rng.integers(0, len(sample), PLANTED)]):
        away = away - np.einsum("ij,ij->i", away, x)[:, None] * x
        size = np.linalg.norm(away, axis=1)
        there = size > 1e-9
        if there.any():
            own = x[there]
            out.append((own, threshold * own + math.sqrt(max(0.0, 1 - threshold**2)) * away[there] / size[there, None]))
    return out


def near_pairs(sample: np.ndarray, threshold: float, seed: int = 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sampled unit vectors that are little above the threshold, where the sample has some."""
    rng = np.random.default_rng(seed)
    asked, left, right = rng.permutation(len(sample))[:ASKED], [], []
    for start in range(0, len(asked), 200):
        own = asked[start : start + 200]
        cosine = sample[own] @ sample.T
        i, j = np.nonzero((cosine >= threshold) & (cosine < threshold + 0.4 * (1 - threshold)))
        some = rng.permutation(len(i))[: PLANTED // 10]
        left.append(own[i[some]])
        right.append(j[some])
    left, right = np.concatenate([*left, asked[:0]]), np.concatenate([*right, asked[:0]])
    return [(sample[left], sample[right])] if len(left) >= 100 else []


class Plan:
    """Key length, number of tables and their projections for a number of vectors, whose sample has unit vectors."""

    def __init__(self, n: int, dim: int, threshold: float, sample: np.ndarray):
        differ = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        bits = min(CODE_BITS, max(1, dim))
        learned = len(sample) >= 2 * dim
        if not learned:
            sample = np.random.default_rng(dim).normal(size=(PLANTED, dim))
            sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        pairs = planted(sample, threshold) + near_pairs(sample, threshold)
        rng = np.random.default_rng(dim)
        any_two = tuple(sample[rng.integers(0, len(sample), PLANTED)] for _ in range(2))
        self.projections: list[tuple[np.ndarray, np.ndarray]] = []
        apart: list[list[np.ndarray]] = []  # by rotation and kind of pairs: the bits that differ

        def rotation(k: int) -> list[np.ndarray]:
            while len(apart) <= k:
                mean, p = itq(sample, len(apart)) if learned else untrained(dim, len(apart))
                self.projections.append((mean, p))
                apart.append([((x - mean) @ p >= 0) != ((y - mean) @ p >= 0) for x, y in [*pairs, any_two]])
            return apart[k]

        for self.key_bits in range(min(bits, max(LEAST_KEY_BITS, math.ceil(math.log2(max(2, n))) - 4)), 0, -1):
            self.each = bits // self.key_bits  # substrings of a code
            same = (1 - differ) ** self.key_bits
            least = max(1, math.ceil(math.log(MISS) / math.log(1 - same))) if 0 < same < 1 else 1
            met, self.tables = [np.zeros(len(x), bool) for x, _ in [*pairs, any_two]], 0
            while self.tables < least or (self.tables < MOST_TABLES and not all(m.mean() >= 1 - MISS for m in met[:-1])):
                at = self.tables % self.each * self.key_bits
                for m, d in zip(met, rotation(self.tables // self.each), strict=True):
                    m |= ~d[:, at : at + self.key_bits].any(axis=1)
                self.tables += 1
            self.recall = min([float(m.mean()) for m in met[:-1]], default=1.0)
            crowded = met[-1].mean() >= CROWDED
            if self.recall >= 1 - MISS or crowded:
                break
        if self.recall < 1 - MISS or crowded:
            self.key_bits, self.each, self.tables, self.recall = 0, bits, 1, 1.0  # every pair
        self.rotations = math.ceil(self.tables / self.each)
        rotation(self.rotations - 1)
        del self.projections[self.rotations :]

    def key(self, codes: np.ndarray, t: int) -> np.ndarray:
        """Substrings by vector for a table. codes: by vector and rotation."""
        return codes[:, t // self.each] >> np.uint64(t % self.each * self.key_bits) & np.uint64((1 << self.key_bits) - 1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Substrings by vector and table."""
        return np.stack([self.key(codes, t) for t in range(self.tables)], axis=1)


def usable(values: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and vector of those that are not null, not zero, and without null or non-finite components."""
    for i, x in enumerate(values):
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(kind)
            if np.isfinite(v).all() and np.abs(v).max() > 0:
                yield i, v


def encoded(vectors: DataFrame, id_col: str, vec_col: str, threshold: float) -> tuple[DataFrame, dict[int, Plan], str]:
    """(id, dim, codes, vec) of every vector; dim null for unusable ones. vec holds the components as they came."""
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    own = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].alias("vec"))
    sizes = {r["d"]: r["n"] for r in own.where("size(vec) > 0").groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    there = sum(sizes.values())
    sample = own.where("size(vec) > 0").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, there)))).select("vec").limit(2 * SAMPLE).toArrow().column("vec").combine_chunks()
    by_dim: dict[int, list[np.ndarray]] = {}
    for _, v in usable(sample, "<f8"):
        by_dim.setdefault(len(v), []).append(v / np.abs(v).max())
    plans, projections = {}, {}
    for d, n in sizes.items():
        x = np.array(by_dim.get(d, [])).reshape(-1, d)
        if len(x):
            x = x[np.lexsort(x.T)]  # the same whatever the order of arrival
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        plans[d] = Plan(n, d, threshold, x)
        projections[d] = plans[d].__dict__.pop("projections")  # plans go to tasks that need no projections

    def code(batches):
        for batch in batches:
            dims, codes, kept = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            groups: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, v in usable(batch.column("vec"), kind):
                groups.setdefault(len(v), []).append((i, v))
            for d, found in groups.items():
                raw = np.stack([v for _, v in found])
                x = raw.astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                signs = np.stack([(x - mean) @ projection >= 0 for mean, projection in projections[d]], axis=1)
                signs = np.concatenate([signs, np.zeros((*signs.shape[:2], CODE_BITS - signs.shape[2]), bool)], axis=2)
                packed = np.packbits(signs, axis=2, bitorder="little")
                for k, (i, _) in enumerate(found):
                    dims[i], codes[i], kept[i] = d, packed[k].tobytes(), raw[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(kept, pa.binary())], ["id", "dim", "codes", "vec"])

    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("dim", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("vec", T.BinaryType())])
    return ship_with(own).mapInArrow(code, schema), plans, kind


def close(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y whose cosine is at or above the threshold, some rows of x at once; the same in any block."""
    most = max(1, links.PAIRS_AT_ONCE // max(1, len(y)))
    for start in range(0, len(x) if len(y) else 0, most):
        cosine = x[start : start + most] @ y.T
        i, j = np.nonzero(cosine >= threshold - NEAR)
        kept = cosine[i, j] >= threshold + NEAR
        unsure = np.flatnonzero(~kept)
        kept[unsure] = together(x[start + i[unsure]], y[j[unsure]]) >= threshold
        yield start + i[kept], j[kept]


def together(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, in an order that does not depend on how many rows there are."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += a * b
    return total


def linked(nodes: DataFrame, plans: dict[int, Plan], kind: str, threshold: float) -> DataFrame:
    """(u, v, links) rows from nodes (node, dim, codes, vec, copies): u's links found in a unit, or a link u-v (links 0)."""
    node_type = dict(nodes.dtypes)["node"]

    def tables(batches):
        most = max(1, KEYED // max((plan.tables for plan in plans.values()), default=1))
        for batch in (whole.slice(start, most) for whole in batches for start in range(0, whole.num_rows, most)):
            for d, plan in plans.items():
                own = np.flatnonzero(batch.column("dim").to_numpy() == d)
                if len(own):
                    codes = np.frombuffer(b"".join(batch.column("codes").take(pa.array(own)).to_pylist()), "<u8").reshape(len(own), -1)
                    number = np.arange(plan.tables, dtype=np.uint64)[None, :] + np.uint64(1_000 * d)
                    key = (plan.keys(codes) << np.uint64(32) ^ number).view(np.int64).ravel()
                    node = batch.column("node").take(pa.array(np.repeat(own, plan.tables)))
                    yield pa.RecordBatch.from_arrays([node, pa.array(key)], ["node", "key"])

    def work(batches):
        one_blas_thread()
        for rows, offsets in links.units(batches):
            n = np.diff(offsets)
            small = np.repeat(n <= SMALL_UNIT, n)
            if small.any():
                part = rows.filter(pa.array(small)).combine_chunks()
                yield from found(part, np.concatenate([[0], np.cumsum(n[n <= SMALL_UNIT])]), False)
            for k in np.flatnonzero(n > SMALL_UNIT).tolist():
                yield from found(rows.slice(offsets[k], n[k]).combine_chunks(), np.array([0, n[k]]), True)

    def found(rows, offsets, whole):
        node, copies, dim = (rows.column(c).to_numpy() for c in ("node", "copies", "dim"))
        number = rows.column("key").to_numpy().view(np.uint64) & np.uint64(0xFFFFFFFF)
        total, joined = np.zeros(len(node), np.int64), links.Joined(len(node))
        for d, plan in plans.items():
            own = np.flatnonzero(dim == d)
            if not len(own):
                continue
            codes = np.frombuffer(b"".join(rows.column("codes").take(pa.array(own)).to_pylist()), "<u8").reshape(len(own), -1)
            t = (number[own] - np.uint64(1_000 * d)).astype(int)
            before = [plan.key(codes, k) for k in range(int(t.max()))]
            if whole and any((key == key[0]).all() for key in before):
                continue  # all of these pairs met in an earlier table
            x = np.frombuffer(b"".join(rows.column("vec").take(pa.array(own)).to_pylist()), kind).reshape(len(own), d).astype(np.float64)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if whole:
                side = rows.column("own").to_numpy()[own]
                candidates = within(x, before) if rows.column("a")[0] == rows.column("b")[0] else across(x, side == side.min())
            else:
                place = np.full(len(dim), -1)
                place[own] = np.arange(len(own))
                candidates = one_by_one(x, place, links.pairs(rows, offsets))
            for i, j in candidates:
                for k, key in enumerate(before):  # pairs count in the first table they meet in
                    first = (key[i] != key[j]) | (k >= t[i])
                    if not first.all():
                        i, j = i[first], j[first]
                i, j = own[i], own[j]
                total += np.bincount(i, copies[j], minlength=len(node)).astype(np.int64) + np.bincount(j, copies[i], minlength=len(node)).astype(np.int64)
                joined.add(i, j)
        has = np.flatnonzero(total)
        if len(has):
            u, v = joined.edges(node)
            ends = pa.array(v)
            ends = pa.concat_arrays([pa.nulls(len(has), ends.type), ends])
            sums = np.concatenate([total[has], np.zeros(len(u), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[has], u])), ends, pa.array(sums)], ["u", "v", "links"])

    def one_by_one(x, place, pairs):
        for i, j in pairs:
            i, j = place[i], place[j]
            there = (i >= 0) & (j >= 0)
            i, j = i[there], j[there]
            kept = together(x[i], x[j]) >= threshold
            yield i[kept], j[kept]

    def across(x, left):
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        for i, j in close(x[one], x[two], threshold):
            yield one[i], two[j]

    def within(x, before):
        """Links inside one block, without the products of rows that share the key of the first table."""
        if not before:
            for i, j in close(x, x, threshold):
                yield i[i < j], j[i < j]
            return
        order = np.argsort(before[0], kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(before[0][order])) + 1).tolist(), len(order)]
        start = 0
        for k, end in enumerate(cuts[1:], 1):
            if end - start >= PRODUCT_ROWS or end == len(order):  # small keys go together
                own, rest = order[start:end], order[end:]
                for i, j in close(x[own], x[rest], threshold):
                    yield own[i], rest[j]
                if cuts[k - 1] != start:  # several keys: among one another too
                    for i, j in close(x[own], x[own], threshold):
                        yield own[i[i < j]], own[j[i < j]]
                start = end

    ship_with(nodes)
    block = max(SMALL_UNIT, min(links.BLOCK_ROWS, BLOCK_BYTES // (int(kind[-1]) * max(plans, default=1))))
    keyed = nodes.select("node", "dim", "codes").mapInArrow(tables, f"node {node_type}, key long")
    return links.in_blocks(keyed, block, nodes).mapInArrow(work, f"u {node_type}, v {node_type}, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows with a cosine of at least the threshold), component_id and kept.

    Integer ids. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
    components of their own, as do vectors of different length with one another. Repeated rows and equal vectors link
    with one another. Rows that share an id are one in components, whatever their vectors; each row has the links of its
    own vector. Rows with a null id link like all others; a component is named by the smallest id that is not null, and is
    null if there is none. A null id is not kept. An empty table gives an empty one; further columns are ignored.
    """
    coded, plans, kind = encoded(vectors, id_col, vec_col, threshold)
    coded = cut(coded)
    members = coded.where("dim is not null")
    nodes = members.groupBy("vec").agg(F.first("dim").alias("dim"), F.first("codes").alias("codes"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # a number for each distinct vector, fixed by the checkpoint
    found = cut(linked(nodes, plans, kind, threshold))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = cut(join_many(members.select("id", "vec"), nodes.select("vec", "node", "copies"), ["vec"], "copies", "inner").groupBy("id", "node").agg(F.count(F.lit(1)).alias("rows")))
    of_id = named.where("id is not null").groupBy("id").agg(F.min("node").alias("first"))
    same_id = named.join(of_id, "id").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    labels = links.components(found.where("v is not null").select("u", "v").unionByName(same_id))
    label = F.coalesce("component", "node")
    whole = cut(nodes.select("vec", "node", "copies").join(labels, "node", "left").join(counts, "node", "left").select("vec", "node", "copies", label.alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("node").agg(F.min("id").alias("id")).join(whole.select("node", "component"), "node").groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("vectors"))
    known = cut(join_many(whole, cut(least), ["component"], "vectors").select("vec", "node", "copies", "n_links", "component_id"))
    linked_rows = join_many(members.select("id", "vec"), known, ["vec"], "copies", "inner").select("id", "n_links", "component_id")
    alone = coded.where("dim is null").select("id")
    by_id = of_id.join(known.select(F.col("node").alias("first"), "component_id"), "first").select("id", "component_id")
    alone = alone.join(by_id, "id", "left").select("id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = linked_rows.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
