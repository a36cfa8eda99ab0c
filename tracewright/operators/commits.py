"""The latest commit of a branch before a time, in commit order: as a walk from the branch's head finds it.

The walk takes the newest commit among those it has come to, then comes to the parents of that. So the first commit
found at or before a time X is one that the head leads to through commits after X only. With `until`, the highest that the
lowest time on a way to a commit can be, these are the commits with committed_at <= X < until, and the newest of them is the
answer. Clocks that go wrong (a child older than its parent) are thus treated as the walk treats them.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.joins import asof_backward
from tracewright.session import cut, discard

NODE = ["repo", "commit_id"]


def first_parent_jumps(commits: DataFrame) -> list[DataFrame]:
    """Tables (repo, commit_id, to): 1, 2, 4, ... steps along first parents, as far as there are any."""
    jumps = [cut(commits.where(F.size("parents") > 0).select(*NODE, F.col("parents")[0].alias("to")))]
    while not jumps[-1].isEmpty():
        half = jumps[-1].select("repo", F.col("commit_id").alias("to"), F.col("to").alias("further"))
        jumps.append(cut(jumps[-1].join(half, ["repo", "to"]).select(*NODE, F.col("further").alias("to"))))
    return jumps[:-1]


def reachable(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, branch, commit_id) of all commits that a branch's head leads to.

    A round follows first parents to the end, in a logarithmic number of joins, then comes to the other parents of what it
    has found: as many rounds as merges lie within merged branches.
    """
    jumps = first_parent_jumps(commits)
    others = commits.where(F.size("parents") > 1).select(*NODE, F.explode(F.slice("parents", 2, F.size("parents") - 1)).alias("to"))
    found, new = None, cut(heads.select("repo", "branch", "commit_id").distinct())
    while not new.isEmpty():
        for jump in jumps:  # cut each time: the plan of a frame that is used twice would double with every table
            last, new = new, cut(new.unionByName(new.join(jump, NODE).select("repo", "branch", F.col("to").alias("commit_id"))).distinct())
            discard(last)
        if found is not None:
            new = new.join(found, ["repo", "branch", "commit_id"], "left_anti")
        new = cut(new)
        last, found = found, new if found is None else cut(found.unionByName(new))
        if last is not None:
            discard(last)
        new = cut(new.join(others, NODE).select("repo", "branch", F.col("to").alias("commit_id")).distinct().join(found, ["repo", "branch", "commit_id"], "left_anti"))
    for jump in jumps:
        discard(jump)
    return found if found is not None else new


def history(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, branch, commit_id, committed_at, until): the commits of a branch, and how long the walk comes to them
    before it finds an older one; null for the head, which it always comes to.

    commits: repo, commit_id, parents, committed_at. Times spread from children to parents until nothing changes: one round
    where clocks are right, and one more for each commit of the longest run of commits that are all older than their parents.
    Parents that are not there (a shallow clone) lead nowhere; commits without a time are passed over.
    """
    timed = commits.where("committed_at is not null").select(*NODE, F.col("committed_at").cast("timestamp").alias("committed_at"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    own = cut(reachable(timed, heads).join(timed, NODE))
    edges = own.select("repo", "branch", F.col("commit_id").alias("child"), F.col("committed_at").alias("child_at"), F.explode("parents").alias("commit_id"))
    edges = cut(edges.join(own.select("repo", "branch", "commit_id"), ["repo", "branch", "commit_id"]))
    on = ["repo", "branch", "commit_id"]
    state = held = cut(edges.groupBy(*on).agg(F.max("child_at").alias("until")))
    while True:
        above = state.select("repo", "branch", F.col("commit_id").alias("child"), F.col("until").alias("child_until"))
        new = edges.join(above, ["repo", "branch", "child"], "left").groupBy(*on).agg(F.max(F.least("child_at", "child_until")).alias("until"))
        new = cut(new.join(state.withColumnRenamed("until", "was"), on))
        changed = not new.where("until <> was").isEmpty()
        discard(held)
        state, held = new.drop("was"), new
        if not changed:
            return own.select(*on, "committed_at").join(state, on, "left")


def _steps(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, seen_at, until, commit_id, older_at): a row for each time of a branch. older_at is the last time before it whose
    commit stays in sight longer: where this one is out of sight, so is everything in between."""
    own = history(commits, heads).withColumn("until", F.coalesce(F.col("until").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")))
    own = own.groupBy(F.concat_ws("\u0000", "repo", "branch").alias("key"), F.unix_micros("committed_at").alias("seen"))
    own = own.agg(F.unix_micros(F.max("until")).alias("until"), F.min_by("commit_id", F.struct(-F.unix_micros("until"), "commit_id")).alias("commit_id"))

    def run(batches):
        last, longer = None, []  # (until, seen) of commits that stay in sight longer than all after them
        for batch in batches:
            older = []
            for key, seen, until in zip(*(batch.column(c).to_pylist() for c in ("key", "seen", "until")), strict=True):
                if key != last:
                    last, longer = key, []
                while longer and longer[-1][0] <= until:
                    longer.pop()
                older.append(longer[-1][1] if longer else None)
                longer.append((until, seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(older, pa.int64())], [*batch.schema.names, "older"])

    ordered = own.repartition("key").sortWithinPartitions("key", "seen").mapInArrow(run, "key string, seen long, until long, commit_id string, older long")
    return ordered.select("key", F.timestamp_micros("seen").alias("seen_at"), F.timestamp_micros("until").alias("until"), "commit_id", F.timestamp_micros("older").alias("older_at"))


def asof_commit(asks: DataFrame, commits: DataFrame, heads: DataFrame, at: str = "at") -> DataFrame:
    """asks (repo, branch, `at`, ...) with the commit_id and committed_at that the walk finds; null where it finds none.

    Of commits of one time the one counts that is in sight longest, then the smallest id. An ask looks at the newest commit
    before its time, and in the next round, where that is hidden, at the next older one that can be in sight.
    """
    steps = cut(_steps(commits, heads).withColumn("from_at", F.col("seen_at")))
    every = cut(asks.withColumns({"key": F.concat_ws("\u0000", "repo", "branch"), "ask": F.monotonically_increasing_id(), "before": F.col(at).cast("timestamp"), "asked_at": F.col(at).cast("timestamp")}))
    waiting, done = every.select("ask", "key", "asked_at", "before"), []
    while not waiting.isEmpty():
        found = cut(asof_backward(waiting, steps, "key", "before", "from_at", ["seen_at", "until", "commit_id", "older_at"]))
        hidden = F.coalesce(F.col("asked_at") >= F.col("until"), F.lit(False))
        done.append(found.where(~hidden).select("ask", "commit_id", F.col("seen_at").alias("committed_at")))
        waiting = found.where(hidden & F.col("older_at").isNotNull()).select("ask", "key", "asked_at", F.col("older_at").alias("before"))
    none = every.select("ask", F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast("timestamp").alias("committed_at")).limit(0)
    return every.drop("key", "before", "asked_at").join(reduce(DataFrame.unionByName, done, none), "ask", "left").drop("ask")
