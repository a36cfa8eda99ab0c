"""As-of by commit order against a walk with a priority queue."""

import heapq
import random
from datetime import datetime, timedelta

import pytest

from tracewright.operators import commits

START = datetime(2024, 1, 1)


def walk(found, head, at):
    """The newest commit of the queue, again and again, until one is at or before the time."""
    if head not in found:
        return None
    queue, seen = [(-found[head][1].timestamp(), head)], {head}
    while queue:
        _, c = heapq.heappop(queue)
        if found[c][1] <= at:
            return c
        for p in found[c][0]:
            if p in found and p not in seen:
                seen.add(p)
                heapq.heappush(queue, (-found[p][1].timestamp(), p))
    return None


@pytest.mark.parametrize("seed", [0, 1])
def test_walks_of_random_histories(spark, seed):
    rng = random.Random(seed)
    every, heads, asks, want = [], [], [], []
    for repo in range(6):
        found = {}
        minutes = rng.sample(range(5000), 120)
        for n in range(60):
            parents = rng.sample(range(max(0, n - 6), n), min(n, rng.choice([1, 1, 1, 2, 3]))) if n else []
            late = rng.choice([0, 0, 0, 3000, -3000]) if repo % 2 else 0
            found[f"c{n:02}"] = ([f"c{p:02}" for p in parents], START + timedelta(minutes=n * 80 + late + minutes[n] / 5000))
        every += [(f"r{repo}", c, p, t) for c, (p, t) in found.items()]
        for branch, head in (("main", "c59"), ("side", "c31"), ("gone", "nowhere")):
            heads.append((f"r{repo}", branch, head))
            for k in range(25):
                at = found[f"c{rng.randrange(60):02}"][1] if k % 3 else START + timedelta(minutes=rng.randrange(-9000, 9000))
                asks.append((len(asks), f"r{repo}", branch, at))
                want.append(walk(found, head, at))
    got = commits.asof_commit(spark.createDataFrame(asks, "id int, repo string, branch string, at timestamp"), spark.createDataFrame(every, "repo string, commit_id string, parents array<string>, committed_at timestamp"), spark.createDataFrame(heads, "repo string, branch string, commit_id string"))
    got = {r["id"]: r["commit_id"] for r in got.collect()}
    assert [got[i] for i in range(len(asks))] == want
    assert sum(w is not None for w in want) > 200


def test_long_history_equal_times_and_missing_parents(spark):
    """300 commits in a row take few rounds; a head at the time itself is found; commits without a time are passed over."""
    made = [("r", str(n), [str(n - 1)], START + timedelta(minutes=n)) for n in range(300)] + [("r", "x", ["299"], START + timedelta(minutes=299)), ("r", "lost", None, None), ("r", "head", None, START)]
    heads = [("r", "main", "x"), ("r", "short", "head")]
    asks = [(0, "r", "main", START + timedelta(minutes=299)), (1, "r", "main", START + timedelta(minutes=150, seconds=30)), (2, "r", "main", START - timedelta(1)), (3, "r", "short", START), (4, "r", "other", START), (5, "r", "main", None)]
    got = commits.asof_commit(spark.createDataFrame(asks, "id int, repo string, branch string, at timestamp"), spark.createDataFrame(made, "repo string, commit_id string, parents array<string>, committed_at timestamp"), spark.createDataFrame(heads, "repo string, branch string, commit_id string"))
    assert {r["id"]: r["commit_id"] for r in got.collect()} == {0: "x", 1: "150", 2: None, 3: "head", 4: None, 5: None}
    none = commits.asof_commit(spark.createDataFrame(asks[:2], "id int, repo string, branch string, at timestamp"), spark.createDataFrame([], "repo string, commit_id string, parents array<string>, committed_at timestamp"), spark.createDataFrame(heads, "repo string, branch string, commit_id string"))
    assert [r["commit_id"] for r in none.collect()] == [None, None]
