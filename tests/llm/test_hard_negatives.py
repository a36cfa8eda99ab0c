"""Hard negatives against all scores, computed in plain integers."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hard_negatives as hn
from tracewright.llm import registry

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, anchor, scale=256, k=5, m=5):
    rows = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (anchor_id, q, own) in enumerate(rows):
        if not anchor(anchor_id):
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, label) for b, (i, v, label) in enumerate(rows) if b != a)
        for p, positive, _ in [s for s in scores if s[2] == own][:k]:
            there = [s for s in scores if s[2] != own and -80 * p <= -100 * s[0] <= -100 * p][:m]
            out += [(anchor_id, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(there, 1)]
    return sorted(out)


def found(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()))


def test_query_and_sql_over_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = by_hand(rows, lambda i: i % 100 == 0)
    assert found(registry.QUERIES["op12_hard_negatives"](spark, data)) == want and want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    assert sorted(c.execute(registry.ORACLES["op12_hard_negatives"]).fetchall()) == want


@pytest.mark.parametrize("n_pivots", [1, 7, 40])
def test_cells_units_and_ties(spark, monkeypatch, n_pivots):
    """Clusters, many equal vectors and ids, vectors of different norm and length, labels that few rows have; tiny units."""
    monkeypatch.setattr(hn, "UNIT_ANCHORS", 5)
    monkeypatch.setattr(hn, "UNIT_ROWS", 60)
    monkeypatch.setattr(hn, "SCORES_AT_ONCE", 300)
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 100)
    rng = random.Random(n_pivots)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(500):
        c = rng.randrange(12)
        vec = [x * rng.choice([1, 1, 1, 3]) + rng.gauss(0, 0.1) for x in centres[c]] if i % 3 else list(centres[0])
        rows.append((i // 2 if i % 50 < 4 else i, vec[: rng.choice([6, 6, 6, 4])], (c + (rng.random() < 0.4)) % 5 if i % 97 else 50 + i % 2))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(hn.hard_negatives(frame, "id % 10 = 0", n_pivots=n_pivots)) == by_hand(rows, lambda i: i % 10 == 0)


def test_far_rows_are_not_copied(spark):
    """Rows of a cluster that no anchor can want stay out of the cells of the others."""
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 10
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.01, 8)).tolist(), i % 16 // 8) for i in range(1600)]
    held = hn.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 256).withColumn("row", F.monotonically_increasing_id())
    dim, norm = held.agg(F.max("dim"), F.max("norm")).first()
    space = hn.Space.of(held, dim, norm, 8)
    anchors = hn.located(held.where("id % 10 = 0").select("row", "id", "label", "vec", "norm"), space, 5)
    reach = np.full((8, 1), -np.inf)
    for cell, most in anchors.groupBy("cell").agg(F.max("reach")).collect():
        reach[cell, 0] = most
    assert hn.copied(held, space, reach, False).count() == 800  # anchors are in four of the eight clusters


def test_large_numbers_are_exact(spark):
    """Scores beyond the exact range of doubles; rows whose scores would not fit take no part."""
    rows = [(i, [float(2**21 + i), float(i % 3), 2.0**21 - i], i % 2) for i in range(40)] + [(100, [1e30, 0.0, 0.0], 0), (200, [2.0**22, 2.0**23 - 1, 2.0**23 - 1], 1)]
    want = by_hand(rows[:40], lambda i: i % 4 == 0)
    assert found(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 4 = 0")) == want and want
    assert max(r[4] for r in want) > 2**53


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.9, 0.4], 2), (3, [0.0, 0.0], 2), (0, [1.0, 0.5], 1), (4, [], 1), (5, [], 2), (6, [1.0], 2), (8, [-1.0, -1.0], 3)]
    bad = [(None, [1.0, 0.5], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 2), (400, [inf, 1.0], 2), (7, [1.0, 0.5], None)]
    want = by_hand(good + bad, lambda i: True)
    frame = spark.createDataFrame(good + bad, SCHEMA)
    assert found(hn.hard_negatives(frame)) == want
    assert found(hn.hard_negatives(frame.withColumns({"row": F.lit("x"), "ID": F.lit(9), "vec": F.lit(1), "score": F.lit(None)}))) == want
    assert found(hn.hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert found(hn.hard_negatives(spark.createDataFrame(bad, SCHEMA))) == []
    assert found(hn.hard_negatives(spark.createDataFrame(good[:1], SCHEMA))) == []
