"""The prefix trie of rebuilt conversations, with subtree sums by heavy-path decomposition.

Prefixes are told apart by sums over their turns, modulo four primes below 2**31, of a digest of the turn times a power
of a base: such sums can be put together from any stretches of a conversation, so a conversation of any length is
summed by as many tasks as its rows need, and prefixes that two conversations share have the same sums.

A node is named by its smallest member and its depth. The largest child of each node (most members) continues the
node's heavy path; the others start light paths. Runs of a path that lie in one member's chain are found by windows
over blocks of depths, and joined up to paths by pointer jumping. Sums over paths flow from light paths to their
parents' paths, in at most log2(members) rounds, since a light child has at most half of its parent's members; then
suffix sums along each path, in blocks of depths, give the sums of every subtree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, discard, ship_with, table
from tracewright.llm.keyed import before, in_order, join_many, run_places

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1220703125, 410338673, 1977326743, 893871739)
#: Turns that a conversation can take from another one, depths of a block, and ids of a piece of a list of ends.
HEAD, BLOCK, LIST_IDS = 5, 1024, 256
_SUMS = [f"s{k}" for k in range(len(PRIMES))]
_PREVIOUS = [f"q{k}" for k in range(len(PRIMES))]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, idx, chars, s0.., q0..): sums up to each turn and up to the one before, within a range partition."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.length(text).cast("long").alias("chars"))

    def sums(batches):
        part, last, idx0, power0, sum0 = TaskContext.get().partitionId(), None, 0, [1] * len(PRIMES), [0] * len(PRIMES)
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), "<u4").reshape(len(conv), 4)
            start, place = run_places(conv)
            going = (start == 0) & (conv == last)  # rows that carry on the run of the batch before
            idx = place + 1 + idx0 * going
            ends, previous = [], []
            for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                prime, weights = np.uint64(p), powers(base, int(place.max()) + 1, p)
                weight = weights[place]
                weight = np.where(going, weight * np.uint64(power0[k]) % prime, weight)
                term = marks[:, k].astype(np.uint64) % prime * weight % prime
                total = np.cumsum(term)
                total = (total - (total - term)[start] + np.uint64(sum0[k]) * going.astype(np.uint64)) % prime
                ends.append(total.astype(np.int64))
                previous.append(((total + prime - term) % prime).astype(np.int64))
                power0[k], sum0[k] = int(weight[-1]), int(total[-1])
            last, idx0 = conv[-1], int(idx[-1])
            columns = [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(idx.astype(np.int64)), batch.column("chars"), *map(pa.array, ends + previous)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "idx", "chars", *_SUMS, *_PREVIOUS])

    ordered = in_order(rows, "conv_id", F.col("turn").asc_nulls_first(), "mark")
    return ship_with(ordered).mapInArrow(sums, "conv_id long, part int, idx long, chars long, " + ", ".join(f"{c} long" for c in _SUMS + _PREVIOUS))


def powers(base: int, n: int, p: int) -> np.ndarray:
    """base**1 to base**n modulo p."""
    out = np.array([base % p], np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * out[-1] % np.uint64(p)])
    return out[:n]


def whole_sums(stretches: DataFrame) -> DataFrame:
    """Turns with their place in the whole conversation and the sums up to it.

    Of a conversation in several range partitions, what lies before each partition comes from its sums there: at most
    one conversation goes over each border of two partitions, so that is at most two rows for a partition.
    """
    edges = stretches.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"))
    over = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    found = stretches.join(F.broadcast(edges.join(over, "conv_id")), ["conv_id", "part"]).groupBy("conv_id", "part").agg(F.max("idx").alias("n"), F.max_by(F.struct(*_SUMS), "idx").alias("s"))

    def add(held, value):
        n, sums = held or (0, (0,) * len(PRIMES))
        return n + value[0], tuple((a + pow(b, n, p) * s) % p for a, b, s, p in zip(sums, BASES, value[1], PRIMES, strict=True))

    offsets = [(*key, held[0], *held[1], *(pow(b, held[0], p) for b, p in zip(BASES, PRIMES, strict=True))) for key, held in before([(r["conv_id"], r["part"], (r["n"], tuple(r["s"]))) for r in found.collect()], add).items() if held]
    names = [*(f"b{k}" for k in range(len(PRIMES))), *(f"w{k}" for k in range(len(PRIMES)))]
    offsets = stretches.sparkSession.createDataFrame(offsets, "conv_id long, part int, n_before long, " + ", ".join(f"{c} long" for c in names))
    joined = stretches.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    moved = lambda c, k: F.when(F.col("n_before").isNull(), F.col(f"{c}{k}")).otherwise((F.col(f"b{k}") + F.col(f"w{k}") * F.col(f"{c}{k}")) % PRIMES[k]).alias(f"{c}{k}")
    return joined.select("conv_id", (F.col("idx") + F.coalesce("n_before", F.lit(0))).alias("pos"), "chars", *(moved(c, k) for c in "sq" for k in range(len(PRIMES))))


def packed(sums: list) -> list:
    """Four sums below 2**31 in two longs."""
    return [F.shiftleft(sums[0], 31) + sums[1], F.shiftleft(sums[2], 31) + sums[3]]


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, prefixes): (conv_id, depth, a, b) of each whole rebuilt conversation, and a row for each of its prefixes
    but the empty one: (conv_id, depth, a, b, pa, pb, chars), pa and pb being the key of the prefix without its last turn."""
    first = F.when(F.col("pos") <= HEAD, F.struct("pos", "chars", *_SUMS, *_PREVIOUS))
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by(F.struct(*_SUMS), "pos").alias("all"), F.array_sort(F.collect_list(first)).alias("head"))
    own = cut(own)
    bases = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(bases, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    joined = joined.withColumn("h", h).withColumn("taken", F.least("h", F.coalesce(F.size("base_head"), F.lit(0))))
    at = lambda array, place, k: F.when((F.col(place) > 0) & (F.col(place) <= F.size(array)), F.col(array)[F.greatest(F.col(place) - 1, F.lit(0))][f"s{k}"]).otherwise(F.lit(0))
    held = cut(joined.select("conv_id", "n", "all", "h", "taken", F.slice("base_head", F.lit(1), F.col("taken")).alias("base_head"), *(F.coalesce(at("base_head", "taken", k), F.lit(0)).cast("long").alias(f"a{k}") for k in range(len(PRIMES))), *(F.coalesce(at("head", "h", k), F.lit(0)).cast("long").alias(f"o{k}") for k in range(len(PRIMES)))))

    def moved(sum_at, k):  # from own places to places in the rebuilt conversation, which are h - taken places earlier
        p = PRIMES[k]
        back = F.array(*(F.lit(pow(BASES[k], -d, p)) for d in range(HEAD + 1)))[F.col("h") - F.col("taken")]
        return (F.col(f"a{k}") + back * F.pmod(sum_at - F.col(f"o{k}"), F.lit(p))) % p

    n_own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    whole = [F.when(n_own > 0, moved(F.col("all")[f"s{k}"], k)).otherwise(F.col(f"a{k}")) for k in range(len(PRIMES))]
    a, b = packed(whole)
    members = held.select("conv_id", (F.col("taken") + n_own).cast("long").alias("depth"), a.alias("a"), b.alias("b"))
    taken = held.select("conv_id", F.explode("base_head").alias("x"))
    heads = taken.select("conv_id", F.col("x.pos").alias("depth"), F.col("x.chars").alias("chars"), *(F.col(f"x.{c}").alias(c) for c in _SUMS + _PREVIOUS))
    tails = join_many(rows, held.select("conv_id", "n", "h", "taken", *(f"{c}{k}" for c in "ao" for k in range(len(PRIMES)))), ["conv_id"], "n", "inner").where("pos > h")
    tails = tails.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "chars", *(moved(F.col(f"{c}{k}"), k).alias(f"{c}{k}") for c in "sq" for k in range(len(PRIMES))))
    (a, b), (pa_, pb) = packed([F.col(c) for c in _SUMS]), packed([F.col(c) for c in _PREVIOUS])
    prefixes = heads.unionByName(tails).select("conv_id", F.col("depth").cast("long").alias("depth"), a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "chars")
    return members, prefixes


def ends(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids that end at a node, in order. Lists of any length: ids are joined in
    pieces, and the pieces of a node pass through one digest, a batch at a time."""
    pieces = members.groupBy("depth", "a", "b", F.floor(F.col("conv_id") / LIST_IDS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "ends_sha256"), r, strict=True)) for r in out], schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "a", "b", "ends_sha256"), (*key, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    dealt = pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "piece")
    return ship_with(dealt).mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def tree_nodes(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, heavy, n_convs, n_children, chars, ends_sha256)."""
    nodes = prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    nodes = cut(nodes.unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy_child"))
    key = ["depth", "a", "b"]
    known = cut(nodes.join(children, key, "left").join(ends(members), key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    discard(nodes)
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "heavy_child", F.col("n_children").alias("siblings"))
    linked = join_many(known.drop("heavy_child"), parents, ["depth", "pa", "pb"], "siblings")
    none = hashlib.sha256(b"").hexdigest()
    tree = cut(linked.select("conv_id", "depth", "parent_conv_id", F.coalesce(F.col("heavy_child") == F.col("conv_id"), F.lit(False)).alias("heavy"), "n_convs", "n_children", "chars", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
    discard(known)
    return tree


def heavy_paths(tree: DataFrame) -> DataFrame:
    """tree with path_conv and path_depth: the top node of the heavy path that a node is on."""
    chain = Window.partitionBy("conv_id", F.floor(F.col("depth") / BLOCK)).orderBy("depth")
    opens = F.lag("depth").over(chain).isNull() | ~(F.col("heavy") & (F.col("parent_conv_id") == F.col("conv_id")))
    runs = tree.withColumn("opens", F.coalesce(opens, F.lit(True)))
    so_far = chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.withColumn("run", F.last(F.when(F.col("opens"), F.col("depth")), ignorenulls=True).over(so_far))
    runs = cut(runs.withColumn("topmost", F.last(F.when(F.col("opens"), ~F.col("heavy")), ignorenulls=True).over(so_far)))
    tops = runs.where("opens")
    on = ["parent_conv_id", "above"]
    above = runs.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("above"), F.col("conv_id").alias("up_conv"), F.col("run").alias("up_run"), F.col("topmost").alias("done"))
    lower = tops.where("heavy").select("conv_id", "run", "parent_conv_id", (F.col("depth") - 1).alias("above"))
    settled = tops.where("not heavy").select("conv_id", "run", F.col("conv_id").alias("up_conv"), F.col("run").alias("up_run"), F.lit(True).alias("done"))
    state = cut(lower.join(above, on).select("conv_id", "run", "up_conv", "up_run", "done").unionByName(settled))
    while not (waiting := state.where("not done")).isEmpty():  # a waiting run points to a run of its own: no key is common
        steps = state.select(F.col("conv_id").alias("up_conv"), F.col("run").alias("up_run"), F.col("up_conv").alias("next_conv"), F.col("up_run").alias("next_run"), F.col("done").alias("next_done"))
        moved = waiting.join(steps, ["up_conv", "up_run"]).select("conv_id", "run", F.col("next_conv").alias("up_conv"), F.col("next_run").alias("up_run"), F.col("next_done").alias("done"))
        last, state = state, cut(moved.unionByName(state.where("done")))
        discard(last)
    found = cut(runs.join(state.select("conv_id", "run", F.col("up_conv").alias("path_conv"), F.col("up_run").alias("path_depth")), ["conv_id", "run"]).drop("run", "opens", "topmost"))
    discard(runs)
    discard(state)
    return found


def subtree_sums(nodes: DataFrame, values: dict) -> DataFrame:
    """nodes of heavy_paths() with each value (name: expression of a node) summed over the node's subtree."""
    path, names = ["path_conv", "path_depth"], list(values)
    nodes = nodes.withColumns(values)
    add = [F.sum(c).alias(c) for c in names]
    tops = nodes.where((F.col("conv_id") == F.col("path_conv")) & (F.col("depth") == F.col("path_depth")) & (F.col("depth") > 0)).select(*path, "parent_conv_id", (F.col("depth") - 1).alias("above"))
    at = nodes.where("n_children > 1").select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("above"), F.col("path_conv").alias("to_conv"), F.col("path_depth").alias("to_depth"), "n_children")
    tops = cut(join_many(tops, at, ["parent_conv_id", "above"], "n_children", "inner"))
    flow = cut(nodes.groupBy(*path).agg(*add))
    sums = [flow]
    while True:
        onward = cut(flow.join(tops.select(*path, "to_conv", "to_depth"), path).groupBy(F.col("to_conv").alias("path_conv"), F.col("to_depth").alias("path_depth")).agg(*add))
        if onward.isEmpty():
            break
        sums.append(flow := onward)
    total = sums[0]
    for more in sums[1:]:
        total = total.unionByName(more)
    total = total.groupBy(*path).agg(*add)
    light = tops.join(total, path).groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("above").alias("depth")).agg(*[F.sum(c).alias(f"light_{c}") for c in names])
    whole = nodes.join(light, ["conv_id", "depth"], "left")
    whole = cut(whole.withColumns({c: F.col(c) + F.coalesce(f"light_{c}", F.lit(0)) for c in names}).withColumn("block", F.floor(F.col("depth") / BLOCK)).drop(*(f"light_{c}" for c in names)))
    below = Window.partitionBy(*path).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = whole.groupBy(*path, "block").agg(*add)
    blocks = blocks.select(*path, "block", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"below_{c}") for c in names))
    along = Window.partitionBy(*path, "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = whole.withColumns({c: F.sum(c).over(along) for c in names}).join(blocks, [*path, "block"])
    return summed.withColumns({c: F.col(c) + F.col(f"below_{c}") for c in names})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the README for the columns.

    Turns go by `turn`, null first, and those of one turn number by a digest of role and text. Null roles and texts are
    empty; repeated rows are turns of their own; rows with a null conv_id take no part. The remainder of a negative id has
    its sign, as in SQL. Texts of any length count whole. Without conversations there is no node. Further columns are ignored.
    """
    stretches = cut(turns(conversations.select("conv_id", "turn", "role", "text")))
    members, prefixes = rebuilt(whole_sums(stretches))
    tree = tree_nodes(members, prefixes)
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    out = subtree_sums(heavy_paths(tree), {"n_leaves": leaf, "saved_tokens": saved})
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT *, list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)) AS bytes FROM own),
h AS (SELECT conv_id, turns, xor(list_reduce(bytes, lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h FROM b),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(own.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % 100),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(conv_id) AS c, count(*) AS n_convs, array_to_string(list(conv_id::VARCHAR ORDER BY conv_id) FILTER (WHERE n = d), ',') AS ends FROM prefixes GROUP BY d, p),
parents AS (SELECT DISTINCT d - 1 AS d, p[1:d - 1] AS p FROM nodes WHERE d > 0),
marked AS (SELECT n.*, parents.d IS NULL AS leaf, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.p[-1].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN parents ON parents.d = n.d AND parents.p = n.p),
above AS (SELECT a AS d, p[1:a] AS p, d AS own_d, leaf, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM marked)),
sums AS (SELECT d, p, count(*) FILTER (WHERE own_d = d + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY d, p)
SELECT n.c::BIGINT AS conv_id, n.d::BIGINT AS depth, up.c::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
