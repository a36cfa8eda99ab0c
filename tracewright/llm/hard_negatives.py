"""Hard negatives by an exact distributed kNN join over Voronoi cells.

Rows get one more component, the root of what their squared norm lacks to the largest one, and anchors a zero there:
an inner product is then larger the nearer the two are. Anchors belong to the cell of their nearest pivot. How far an
anchor must look follows from scores that are known to be reached: first those of a sample of rows, then those of its
positives. By the triangle inequality a row can serve an anchor of a cell only if it lies within the cell's reach of the
pivot, so rows are copied to these cells only. There anchors and rows meet in units of bounded size, whose scores are
exact integers; the best of each unit are merged by rank. Pivots, sample and bounds decide how many rows are copied, never what
is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, one_blas_thread, ship_with, table

POSITIVES, NEGATIVES = 5, 5
#: Rows and bytes of the sample that gives pivots and first bounds; anchors for a pivot, and most pivots.
SAMPLE_ROWS, SAMPLE_BYTES, ANCHORS_A_PIVOT, MOST_PIVOTS = 4096, 4 << 20, 128, 256
#: Classes of labels that have a reach of their own in each cell.
LABEL_CLASSES = 16
#: Anchors and rows of a unit of work, and scores that are looked at together.
UNIT_ANCHORS, UNIT_ROWS, SCORES_AT_ONCE = 1024, 16_384, 1 << 20
LARGEST = float(2**31 - 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec, norm, dim) of the rows that take part: vec holds floor(scale * x) as little-endian 32-bit integers."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), vectors[vec_col].cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and label is not null and vec is not null")

    def code(batches):
        for batch in batches:
            lists = batch.column("vec")
            flat = lists.flatten()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            fine = np.isfinite(x)
            x = np.floor(scale * np.where(fine, x, 0.0))
            fine &= np.abs(x) <= LARGEST
            x = np.where(fine, x, 0.0)
            bad = np.concatenate([[0], np.cumsum(~fine)])
            real = np.concatenate([[0.0], np.cumsum(x * x)])
            kept = np.flatnonzero((bad[ends[1:]] == bad[ends[:-1]]) & (np.diff(real[ends]) < 2.0**62))
            whole = x.astype("<i4")
            vec = [whole[ends[i] : ends[i + 1]] for i in kept]
            norms = [int(v.astype(np.int64) @ v.astype(np.int64)) for v in vec]
            ids = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(ids), batch.column("label").take(ids), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(norms, pa.int64()), pa.array([len(v) for v in vec], pa.int32())], ["id", "label", "vec", "norm", "dim"])

    return ship_with(rows).mapInArrow(code, "id long, label long, vec binary, norm long, dim int")


def matrix(vecs: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of integers, shorter ones with zeros at their ends."""
    found = vecs.to_pylist()
    if all(len(v) == 4 * dim for v in found):
        return np.frombuffer(b"".join(found), "<i4").reshape(len(found), dim)
    out = np.zeros((len(found), dim), np.int32)
    for i, v in enumerate(found):
        out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, in the fastest numbers that hold them and all partial sums."""
    most = x.shape[1] * float(np.abs(x.astype(np.int64)).max(initial=0)) * float(np.abs(y.astype(np.int64)).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return x.astype(kind) @ y.astype(kind).T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row (all, if fewer); of equal ones the first columns."""
    lowest = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    s = np.where(allowed, scores, lowest)
    if s.shape[1] <= k:
        return np.nonzero(allowed)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
    level = s == least
    return np.nonzero(allowed & ((s > least) | (level & (np.cumsum(level, axis=1) <= k))))


@dataclass
class Space:
    """A bounded sample of the rows, the pivots among it, and the largest norm of all rows."""

    dim: int
    norm: float  # largest squared norm
    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    pivots: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, dim: int, norm: int, n_pivots: int) -> Space:
        most = max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * max(1, dim))))
        sample = rows.select("id", "label", "vec").orderBy(F.xxhash64("vec", "id"), "id").limit(most).toArrow()
        vecs = matrix(sample.column("vec").combine_chunks(), dim)
        space = cls(dim, float(norm), sample.column("id").to_numpy(), sample.column("label").to_numpy(), vecs, np.zeros((0, dim + 1)))
        points = space.lifted(vecs)
        chosen, gap = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(n_pivots, len(points)) and gap.max() > 0:  # each pivot is the row farthest from those before
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
        space.pivots = points[chosen]
        return space

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.norm))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.norm - (x * x).sum(axis=1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of points to each pivot."""
        return np.sqrt(np.maximum(0.0, (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from an anchor a row with at least this score can be."""
        return np.sqrt(np.maximum(0.0, (q.astype(np.float64) ** 2).sum(axis=1) + self.norm - 2 * score))


def located(anchors: DataFrame, space: Space, positives: int) -> DataFrame:
    """Anchors with their cell, the distance of its pivot, and the reach (from the pivot) that their positives need."""

    def locate(batches):
        one_blas_thread()
        for whole in batches:
            for batch in (whole.slice(k, UNIT_ANCHORS // 4) for k in range(0, whole.num_rows, UNIT_ANCHORS // 4)):
                q = matrix(batch.column("vec"), space.dim)
                away = space.distances(np.column_stack([q, np.zeros(len(q))]))
                cell = away.argmin(axis=1)
                away = away[np.arange(len(q)), cell]
                ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
                scores = products(q, space.vecs).astype(np.float64)
                scores = np.where((labels[:, None] == space.labels) & (ids[:, None] != space.ids), scores, -np.inf)
                known = np.partition(scores, -positives, axis=1)[:, -positives] if scores.shape[1] >= positives else np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(away + space.reach(q, known))], [*batch.schema.names, "cell", "away", "reach"])

    return ship_with(anchors).mapInArrow(locate, "row long, id long, label long, vec binary, norm long, cell int, away double, reach double")


def copied(rows: DataFrame, space: Space, reach: np.ndarray, with_rows: bool) -> DataFrame:
    """Rows (grp, row, id, label, vec) once for each group of anchors that they may serve, or only the grp column.

    reach holds a line for each cell and a column for each class of labels; group numbers count along its lines.
    """
    classes = reach.shape[1]

    def copy(batches):
        one_blas_thread()
        for whole in batches:
            step = max(1, SCORES_AT_ONCE // max(reach.size, space.dim + 1))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                away = space.distances(space.lifted(matrix(batch.column("vec"), space.dim)))
                own = np.mod(batch.column("label").to_numpy(), classes) if with_class else np.zeros(batch.num_rows, np.int64)
                i, cell = np.nonzero(away <= reach[:, own].T + space.slack)
                group = pa.array((cell * classes + own[i]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([group, *(batch.take(pa.array(i)).select(["row", "id", "label", "vec"]).columns if with_rows else [])], ["grp", *(["row", "id", "label", "vec"] if with_rows else [])])

    with_class = classes > 1
    return ship_with(rows).select("row", "id", "label", "vec").mapInArrow(copy, "grp int, row long, id long, label long, vec binary" if with_rows else "grp int")


def joined(anchors: DataFrame, rows: DataFrame, space: Space, classes: int, unit, schema: str) -> DataFrame:
    """unit(anchors, rows) over units of bounded size that bring every anchor (with grp, reach) to every row copied to its group."""
    held = anchors.groupBy("grp").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # at most MOST_PIVOTS * LABEL_CLASSES
    reach = np.full(len(space.pivots) * classes, -np.inf)
    for r in held:
        reach[r["grp"]] = r["reach"]
    reach = reach.reshape(-1, classes)
    sizes = {r["grp"]: r["n"] for r in copied(rows, space, reach, False).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(r["grp"], -(-r["n"] // UNIT_ANCHORS), -(-sizes.get(r["grp"], 0) // UNIT_ROWS)) for r in held]
    plan = F.broadcast(anchors.sparkSession.createDataFrame(plan, "grp int, chunks int, slices int").where("slices > 0"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(plan, "grp").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("slice", spread("slices")).drop("chunks", "slices", "reach")
    right = copied(rows, space, reach, True).join(plan, "grp").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).withColumn("chunk", spread("chunks")).drop("chunks", "slices", "row")
    key = ["grp", "chunk", "slice"]
    return ship_with(left).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(unit, schema)


def unit_blocks(anchors: pa.Table, rows: pa.Table, dim: int):
    """(number of the first anchor, scores, same label) of some anchors at once, with all rows of the unit in order of id; and these ids."""
    one_blas_thread()
    rows = rows.sort_by("id").combine_chunks()
    q, x = (matrix(t.column("vec").combine_chunks(), dim) for t in (anchors, rows))
    ids, labels, own = rows.column("id").to_numpy(), rows.column("label").to_numpy(), anchors.column("label").to_numpy()
    step = max(1, SCORES_AT_ONCE // max(1, len(x)))
    for start in range(0, len(q), step):
        yield start, ids, products(q[start : start + step], x), own[start : start + step, None] == labels


def first_ranked(found: DataFrame, by: list[str], k: int, id_col: str) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), id_col)))
    return ranked.where(F.col("rank") <= k)


def positives_of(anchors: DataFrame, rows: DataFrame, space: Space, k: int) -> DataFrame:
    """(row, positives): for each anchor its k best other rows of the same label, as an array of (score, id)."""

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for start, ids, scores, same in unit_blocks(left, right, space.dim):
            i, j = best(scores, same, k + 1)
            out.append((start + i, ids[j], scores[i, j].astype(np.int64)))
        i, ids, scores = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        own = [left.column(c).combine_chunks().take(pa.array(i.astype(np.int64))) for c in ("row", "id", "norm")]
        return pa.table([*own, pa.array(ids.astype(np.int64)), pa.array(scores)], names=["row", "anchor", "norm", "id", "score"])

    grouped = anchors.withColumn("grp", (F.col("cell") * LABEL_CLASSES + F.pmod("label", F.lit(LABEL_CLASSES))).cast("int")).drop("away", "cell")
    found = joined(grouped, rows, space, LABEL_CLASSES, unit, "row long, anchor long, norm long, id long, score long")
    top = first_ranked(found, ["row"], k + 1, "id").groupBy("row").agg(F.first("anchor").alias("anchor"), F.first("norm").alias("norm"), F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("top"))
    # of the rows that are like the anchor, in id and score, one is the anchor itself
    place = F.array_position(F.transform("top", lambda x: (x["id"] == F.col("anchor")) & (x["score"] == F.col("norm"))), True).cast("int")
    others = F.filter("top", lambda x, n: (F.col("own") == 0) | (n + 1 != F.col("own")))
    return top.withColumn("own", place).select("row", F.transform(F.slice(others, 1, k), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives"))


def window_of(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score n with 80 p <= 100 n <= 100 p; none where p is negative."""
    return score - score // 5, score


def negatives_of(anchors: DataFrame, rows: DataFrame, space: Space, k: int) -> DataFrame:
    """(row, place, id, score, rank): the k best rows of other labels within the window of each positive of an anchor."""

    def look(batches):
        one_blas_thread()
        for whole in batches:
            for batch in (whole.slice(n, UNIT_ANCHORS // 4) for n in range(0, whole.num_rows, UNIT_ANCHORS // 4)):
                q, sums = matrix(batch.column("vec"), space.dim), batch.column("scores").to_pylist()
                known = products(q, space.vecs).astype(np.float64)
                other = batch.column("label").to_numpy()[:, None] != space.labels
                need = np.full(len(q), np.inf)
                for i, scores in enumerate(sums):
                    for p in scores:
                        if p >= 0:
                            low, high = window_of(np.int64(p))
                            there = known[i][other[i] & (known[i] >= low) & (known[i] <= high)]
                            need[i] = min(need[i], np.partition(there, -k)[-k] if len(there) >= k else low)
                reach = np.where(np.isinf(need), -np.inf, batch.column("away").to_numpy() + space.reach(q, np.where(np.isinf(need), 0, need)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)], [*batch.schema.names, "reach"])

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        out, sums = [], left.column("scores").to_pylist()
        width = max(map(len, sums), default=0)
        filled = np.array([[*s, *[-1] * (width - len(s))] for s in sums], np.int64).reshape(len(sums), width)
        for start, ids, scores, same in unit_blocks(left, right, space.dim):
            for place in range(width):
                p = filled[start : start + len(scores), place, None]
                low, high = window_of(p)
                i, j = best(scores, ~same & (p >= 0) & (scores >= low) & (scores <= high), k)
                out.append((start + i, np.full(len(i), place), ids[j], scores[i, j].astype(np.int64)))
        i, place, ids, scores = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table([left.column("row").combine_chunks().take(pa.array(i.astype(np.int64))), pa.array(place.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(scores)], names=["row", "place", "id", "score"])

    near = ship_with(anchors).select("row", "id", "label", "vec", "cell", "away", F.col("positives.score").alias("scores")).mapInArrow(look, "row long, id long, label long, vec binary, cell int, away double, scores array<long>, reach double")
    near = cut(near.where("reach >= 0").select("row", "label", "vec", F.col("cell").alias("grp"), "scores", "reach"))
    return first_ranked(joined(near, rows, space, 1, unit, "row long, place int, id long, score long"), ["row", "place"], k, "id")


def hard_negatives(vectors: DataFrame, anchor: str = "true", label: str = "label", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", n_pivots: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see op12 in the README.

    anchor is an SQL condition on the columns id and label; label an SQL expression of them that replaces the label.
    Rows with a null id, label or vector, with a null or non-finite component, or with numbers too large for exact
    scores (a component of 2**31, a squared norm of 2**62, or more) take no part. A vector counts as zero beyond its end,
    so vectors of different length compare. Rows with the same id are rows of their own: each is an anchor, and other
    rows like it can be its positives. Without anchors, positives or negatives in the window there is no row; an empty
    table gives an empty one; further columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col, label_col, scale)
    anchors = F.expr(anchor)
    rows = cut(rows.select("id", F.expr(label).cast("long").alias("label"), "vec", "norm", "dim", F.coalesce(anchors, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")).where("label is not null"))
    n, dim, norm = rows.agg(F.count_if("anchor"), F.max("dim"), F.max("norm")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    space = Space.of(rows, dim, norm, n_pivots or max(1, min(MOST_PIVOTS, n // ANCHORS_A_PIVOT)))
    anchors = cut(located(rows.where("anchor").select("row", "id", "label", "vec", "norm"), space, positives))
    known = cut(anchors.drop("reach").join(positives_of(anchors, rows, space, positives), "row"))
    found = negatives_of(known, rows, space, negatives)
    held = known.select("row", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    out = found.join(held, ["row", "place"])
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label AS own, b.r AS br, b.vec_id AS id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT r, br, anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.r, p.br ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"), "id % 100 = 0", "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
