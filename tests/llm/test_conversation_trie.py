"""The trie of rebuilt conversations against one built in plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversation_trie as trie
from tracewright.llm import keyed, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v, key=lambda r: r[:2])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_over_the_table(spark):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.QUERIES["op11_prefix_trie"](spark, data)) == by_hand(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted(c.execute(registry.ORACLES["op11_prefix_trie"]).fetchall(), key=repr) == by_hand(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_long_and_forking_conversations(spark, monkeypatch, seed):
    """Chains of hundreds of turns over small blocks and pieces, conversations over several partitions, few turn texts."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "LIST_IDS", 3)
    monkeypatch.setattr(keyed, "HOT_LEAST", 3)
    monkeypatch.setattr(keyed, "HOT_SHARE", 0.01)
    rng, rows = random.Random(seed), []
    for c in [*range(40), *range(100, 130), 205, -7, 10**12]:
        n = rng.choice([1, 2, 3, 8, 40]) if c else 300
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "ü😀", "", None]) if rng.random() < 0.1 else "same") for t in range(n)]
    rng.shuffle(rows)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == by_hand(rows)


def test_odd_inputs(spark):
    rows = [(1, None, None, None), (1, None, "user", ""), (None, 1, "user", "lost"), (2, 5, "user", "x" * 50_000), (2, 5, "user", "x" * 50_000), (3, -1, "a", "bc"), (4, 1, "ab", "c"), (100, 1, "user", "only")]
    frame = spark.createDataFrame(rows, SCHEMA)
    result = got(trie.prefix_trie(frame))
    assert {r[0] for r in result if r[1] == 0} == {1} and sum(r[1] == 0 for r in result) == 1
    whole = [r for r in rows if not (r[0] == 1 and r[2] is None)]  # turns of one number in any order: leave that one out
    assert got(trie.prefix_trie(spark.createDataFrame(whole, SCHEMA))) == by_hand(whole)
    assert got(trie.prefix_trie(spark.createDataFrame(whole, SCHEMA).withColumns({"a": F.lit(1), "part": F.lit("x"), "depth": F.lit(0), "MARK": F.lit(2)}))) == by_hand(whole)
    assert got(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_conversations_without_turns(spark):
    """Those whose own turns are all replaced by the first turns of a conversation that is not there."""
    short = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2][:6]
    rows = [(c, 0, "user", "x") for c in short]
    result = got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert result == by_hand(rows) == [(short[0], 0, None, 6, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_join_many_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_LEAST", 2)
    rows = spark.range(100).select((F.col("id") % 10 % 4 * (F.col("id") < 90).cast("int")).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 3")
    want = sorted(map(tuple, rows.join(lookup, "k", "left").select("k", "id", "n").collect()))
    for share in (0.0, 0.3, 1.0):
        monkeypatch.setattr(keyed, "HOT_SHARE", share)
        found = keyed.join_many(rows, lookup, ["k"], "n").select("k", "id", "n")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
        inner = keyed.join_many(rows, lookup, ["k"], "n", "inner").select("k", "id", "n")
        assert sorted(map(tuple, inner.collect())) == [r for r in want if r[2] is not None]
