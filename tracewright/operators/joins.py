"""Joins with a policy: strict, first or last wins, as-of, band, interval, path suffix, positional."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracewright.session import cut, ship


def first_wins(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the one that is first in the order."""
    return _one(frame, key, F.min_by, order)


def last_wins(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the one that is last in the order."""
    return _one(frame, key, F.max_by, order)


def _one(frame, key, pick, order):
    kept = pick(F.struct(*(frame[c].alias(c) for c in frame.columns)), F.col(order)).alias("__row")
    return frame.groupBy(F.col(key).alias("__key")).agg(kept).select("__row.*")


def strict_inner(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join that fails where a left row has no match: loud where a plain one would drop it."""
    marked = left.join(right.withColumn("__there", F.lit(True)), on, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"no match for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return marked.where(checked).drop("__there")


def _place(at: Column, kind: T.DataType, width: float) -> Column:
    """The stretch of `width` that a number, date (days) or time (seconds) lies in."""
    if isinstance(kind, T.DateType):
        at = F.unix_date(at)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.unix_micros(at.cast("timestamp")) / 1e6
    return F.floor(at / F.lit(width))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], tie: str | None = None, width: float | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (null where none).

    Both sides are one stream ordered by time, so a key is shuffled and sorted once and there is no range join. Right
    rows at the same time rank by `tie`, the largest last. A null key or time finds nothing. A value whose name is a left
    column's gets the ending `_right`.

    width: a key with many rows is cut into stretches of this length (numbers, days or seconds), each sorted on its own;
    what holds at the beginning of a stretch comes from one row for each stretch before it.
    """
    rank = F.col(tie).cast("string") if tie else F.lit(None).cast("string")
    kind = left.schema[left_time].dataType
    place = lambda c: _place(F.col(c), kind, width) if width else F.lit(0).cast("long")
    events = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("__key"), place(right_time).alias("__place"), F.col(right_time).alias("__time"), F.lit(0).alias("__side"), rank.alias("__tie"), F.struct(*values).alias("__value"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    asks = left.select(F.col(key).alias("__key"), place(left_time).alias("__place"), F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__tie"), F.lit(None).cast(events.schema["__value"].dataType).alias("__value"), F.struct(*left.columns).alias("__row"))
    stream = events.unionByName(asks)
    upto = Window.partitionBy("__key", "__place").orderBy("__time", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("__last", F.last("__value", ignorenulls=True).over(upto)).where("__side = 1")
    if width:
        of_event = F.when(F.col("__side") == 0, F.struct("__time", "__tie"))
        ends = stream.where("__key is not null and __place is not null").groupBy("__key", "__place").agg(F.max_by("__value", of_event).alias("__end"))
        before = Window.partitionBy("__key").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        found = found.join(carried, ["__key", "__place"], "left").withColumn("__last", F.coalesce("__last", "__before"))
    return found.select("__row.*", *(F.col("__last")[v].alias(v if v not in left.columns else f"{v}_right") for v in values))


def band_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, window: int) -> DataFrame:
    """Pairs with the same key and left <= right <= left + window.

    Positions are cut into buckets of the window's length; a left row looks into its own bucket and the next, so the
    join is on equality and a key with many rows still spreads over buckets.
    """
    size = window + 1
    a = left.withColumn("__bucket", F.explode(F.array(F.floor(F.col(left_at) / size), F.floor(F.col(left_at) / size) + 1)))
    b = right.withColumn("__bucket", F.floor(F.col(right_at) / size))
    return a.join(b, [on, "__bucket"]).where(F.col(right_at).between(F.col(left_at), F.col(left_at) + window)).drop("__bucket")


def overlap_join(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], bucket: int, factor: int = 16, levels: int = 8) -> DataFrame:
    """Pairs of one key whose closed intervals overlap; empty intervals (start > end) overlap nothing.

    Buckets have levels: those of a level are `factor` times as long as of the one before. An interval belongs to the
    level whose buckets are as long as it, so it touches two at most there and on every higher level (of the highest
    one it may touch more). It is looked up on its own level and on those that the other side's intervals belong to; a pair
    counts on the higher level of both, in the bucket where its common part begins.
    """
    sizes = [bucket * factor**k for k in range(levels)]
    size = F.element_at(F.array(*(F.lit(x).cast("long") for x in sizes)), F.col("__level") + 1)

    def of_level(frame, span, own):
        length = F.col(span[1]) - F.col(span[0])
        return frame.where(F.col(span[0]) <= F.col(span[1])).withColumn(own, sum((F.when(length >= x, 1).otherwise(0) for x in sizes[:-1]), F.lit(0)))

    def spread(frame, span, own, others, its):
        there = others.agg(F.collect_set(its).alias("__there"))
        looked = frame.crossJoin(F.broadcast(there)).withColumn("__level", F.explode(F.filter(F.sequence(own, F.lit(levels - 1)), lambda k: (k == F.col(own)) | F.array_contains("__there", k)))).drop("__there")
        return looked.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(span[0]) / size), F.floor(F.col(span[1]) / size))))

    a, b = of_level(left, left_span, "__a"), of_level(right, right_span, "__b")
    meets = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    first = F.floor(F.greatest(left_span[0], right_span[0]) / size) == F.col("__bucket")
    pairs = spread(a, left_span, "__a", b, "__b").join(spread(b, right_span, "__b", a, "__a"), [on, "__level", "__bucket"])
    return pairs.where(meets & first & (F.col("__level") == F.greatest("__a", "__b"))).drop("__level", "__bucket", "__a", "__b")


def in_ranges(value: Column, ranges: Column, start: str = "start", end: str = "end") -> Column:
    """Whether a value is in any of an array of closed ranges."""
    return F.exists(ranges, lambda r: value.between(r[start], r[end]))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path by whole components, the path itself first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def unique_suffix_match(candidates: DataFrame, files: DataFrame, candidate: str, path: str, scope: str | None = None) -> DataFrame:
    """Candidates with the one file whose path ends in their components; those with none or several go."""
    keys = [scope] if scope else []
    known = files.select(*keys, path, F.explode(path_suffixes(F.col(path))).alias(candidate))
    only = known.groupBy(*keys, candidate).agg(F.count(F.lit(1)).alias("__n"), F.min(path).alias(path)).where("__n = 1").drop("__n")
    return candidates.join(only, [*keys, candidate])


def any_suffix_match(candidates: DataFrame, files: DataFrame, candidate: str, path: str) -> DataFrame:
    """Each candidate with the least known path that ends in its text or that its text ends in; by characters.

    Texts of both sides are sorted from their ends, by ranges: a text and all that end in it then are neighbours, and one pass
    with the endings that are still open finds both directions, whatever the lengths. Endings that a range's first text has
    in common with earlier ranges are carried into it: at most one for each of its characters.
    """
    ship(candidates.sparkSession)
    both = candidates.select(F.reverse(candidate).alias("text"), F.lit(True).alias("asks"), F.lit(False).alias("known"))
    both = both.unionByName(files.select(F.reverse(path).alias("text"), F.lit(False).alias("asks"), F.lit(True).alias("known"))).where("text is not null")
    both = both.groupBy("text").agg(F.bool_or("asks").alias("asks"), F.bool_or("known").alias("known"))

    def placed(batches):
        for batch in batches:
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32)))

    rows = cut(both.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(placed, "text string, asks boolean, known boolean, part int"))
    firsts = rows.groupBy("part").agg(F.min("text").alias("first"))
    open_ = firsts.select(F.col("part").alias("into"), F.explode(F.transform(F.sequence(F.lit(0), F.length("first")), lambda n: F.left("first", n))).alias("text"))
    carried: dict[int, list] = {}
    for r in rows.join(F.broadcast(open_), "text").where("part < into").collect():
        carried.setdefault(r["into"], []).append((r["text"], r["asks"], r["known"]))

    def matched(batches):
        stack, found, ready = [], [], False  # of open endings: text, whether it asks, the least known path it ends in, the least that ends in it

        def least(a, b):
            return b if a is None else a if b is None else min(a, b)

        def close():
            text, asks, _, below = stack.pop()
            if stack:
                stack[-1][3] = least(stack[-1][3], below)
            if asks and below is not None:
                found.append((text[::-1], below))

        def enter(text, asks, known):
            own = text[::-1] if known else None
            while stack and not text.startswith(stack[-1][0]):
                close()
            above = least(stack[-1][2] if stack else None, own)
            if asks and above is not None:
                found.append((text[::-1], above))
            stack.append([text, asks, above, own])

        for batch in batches:
            if not ready and batch.num_rows:
                ready = True
                for text, asks, known in sorted(carried.get(batch.column("part")[0].as_py(), ())):
                    enter(text, asks, known)
            for text, asks, known in zip(*(batch.column(c).to_pylist() for c in ("text", "asks", "known")), strict=True):
                enter(text, asks, known)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], [candidate, path])
            found.clear()
        while stack:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], [candidate, path])

    schema = T.StructType([T.StructField(candidate, T.StringType()), T.StructField(path, T.StringType())])
    return rows.mapInArrow(matched, schema).groupBy(candidate).agg(F.min(path).alias(path))


def positional_full(left: DataFrame, right: DataFrame, on: Sequence[str], order: str, width: float | None = None) -> DataFrame:
    """Rows of both sides paired by their number within a key; leftovers of either side stay. Equal orders have any order.

    width: a key with many rows is cut into stretches of the order of this length (numbers, days or seconds), numbered
    each on its own; the rows of the stretches before are added.
    """

    def numbered(frame, side):
        own = frame.select(*on, F.struct(*(c for c in frame.columns if c not in on)).alias(side), F.col(order).alias("__order"))
        own = own.withColumn("__place", _place(F.col("__order"), frame.schema[order].dataType, width) if width else F.lit(0).cast("long"))
        own = own.withColumn("pos", F.row_number().over(Window.partitionBy(*on, "__place").orderBy("__order")))
        if width:
            sizes = own.groupBy(*on, "__place").agg(F.count(F.lit(1)).alias("__rows"))
            before = Window.partitionBy(*on).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
            ahead = F.coalesce(F.sum("__rows").over(before), F.lit(0)).cast("int").alias("__ahead")
            keys = [*on, "__place"]
            sizes = sizes.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), ahead)
            same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)))
            own = own.join(sizes, same).withColumn("pos", F.col("pos") + F.col("__ahead"))
        return own.select(*on, "pos", side)

    return numbered(left, "left").join(numbered(right, "right"), [*on, "pos"], "full")


def first_existing(rows: DataFrame, candidates: Column, files: DataFrame, path: str, key: str) -> DataFrame:
    """For each key the first of its ordered candidate paths that exists; null where none does."""
    tried = rows.select(key, F.posexplode(candidates).alias("pos", path))
    hit = tried.join(files.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, "pos").alias(path))
    return rows.select(key).distinct().join(hit, key, "left")


def nearest_ancestor(files: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each file with the deepest of the root folders above it; null where there is none."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = files.select(path, F.posexplode(above).alias("depth", root))
    hit = tried.join(roots.select(root).distinct(), root, "left_semi").groupBy(path).agg(F.max_by(root, "depth").alias(root))
    return files.select(path).distinct().join(hit, path, "left")
