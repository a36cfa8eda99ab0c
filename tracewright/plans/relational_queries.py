"""Joins, selections and histograms over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import commits, joins
from tracewright.plans import query
from tracewright.plans.trace_queries import table

BUCKETS = ("core", "integration", "mixed", "other", "unknown", "no_diff_url")


def bucket_of(source):
    n = F.regexp_extract(source, r"(\d+)$", 1).cast("int")
    return F.when(n < 4, "core").when(n < 12, "integration").when(n == 12, "mixed").when(n < 19, "other").otherwise("unknown")


@query(
    "category_breakdown",
    """
    WITH b AS (SELECT CASE WHEN n < 4 THEN 'core' WHEN n < 12 THEN 'integration' WHEN n = 12 THEN 'mixed' WHEN n < 19 THEN 'other' ELSE 'unknown' END AS bucket
               FROM (SELECT regexp_extract(source, '([0-9]+)$', 1)::INT AS n FROM documents)),
    s AS (SELECT unnest(['core', 'integration', 'mixed', 'other', 'unknown', 'no_diff_url']) AS bucket),
    c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket), t AS (SELECT count(*) AS total FROM b)
    SELECT s.bucket, coalesce(n, 0)::BIGINT AS n, round(CASE WHEN total > 0 THEN coalesce(n, 0) * 100.0::DOUBLE / total ELSE 0 END, 4) AS percent FROM s LEFT JOIN c USING (bucket), t
    """,
)
def category_breakdown(spark, sf_dir):
    """Every bucket has a row, with 0 where nothing falls in it; the spine of buckets is a constant."""
    counts = table(spark, sf_dir, "documents").groupBy(bucket_of(F.col("source")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string").join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("total"))
    return spine.crossJoin(total).select("bucket", F.col("n").cast("long").alias("n"), F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)), 4).alias("percent"))


@query("golden_ids", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def golden_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query("golden_join_strict", "SELECT doc_id, lang, source FROM labels JOIN documents USING (doc_id) WHERE quality = 1")
def golden_join_strict(spark, sf_dir):
    golden = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return joins.strict_inner(golden, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("golden_left_join", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'no_label') AS label FROM documents LEFT JOIN labels USING (doc_id)")
def golden_left_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("label"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit("no_label")).alias("label"))


@query("anti_checkpoint", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_checkpoint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_names", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_names(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(used, "p_partkey", "left_semi")


@query("first_wins", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins(spark, sf_dir):
    return joins.first_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return joins.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("latest_limit", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def latest_limit(spark, sf_dir):
    """Top rows by time: tasks send at most the limit."""
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "user_id")


@query(
    "asof_commit",
    """
    SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
)
def asof_commit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof_backward(buys, views, "user_id", "ts", "view_ts", ["view_id"], tie="view_id", width=86_400.0).select("event_id", "view_id")


@query(
    "asof_commit_order",
    """
    WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type = 'error' THEN ts - INTERVAL 1 DAY ELSE ts END AS t FROM events),
    e AS (SELECT user_id, n, CASE WHEN n % 5 = 3 THEN n - 2 ELSE n - 1 END AS p FROM r UNION ALL SELECT user_id, n, n - 3 FROM r WHERE n % 5 = 0),
    h AS (SELECT user_id, max(n) AS n FROM r GROUP BY user_id),
    walk(user_id, n, until) AS (SELECT user_id, n, TIMESTAMP '9999-12-31' FROM h UNION SELECT w.user_id, e.p, least(w.until, r.t) FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n JOIN r ON r.user_id = w.user_id AND r.n = w.n WHERE e.p > 0),
    seen AS (SELECT user_id, n, t, max(until) AS until FROM walk JOIN r USING (user_id, n) GROUP BY ALL)
    SELECT q.event_id, arg_max(n, (t, until)) AS commit_n FROM (SELECT * FROM events WHERE event_type = 'purchase') q LEFT JOIN seen s ON s.user_id = q.user_id AND s.t <= q.ts AND q.ts < s.until GROUP BY q.event_id
    """,
)
def asof_commit_order(spark, sf_dir):
    """Events of a user are commits of a repository: every fifth merges a side branch, and the clock of errors is a day late."""
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_type") == "error", F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    r = e.select(F.col("user_id").cast("string").alias("repo"), at.alias("committed_at"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    first = F.when(F.col("n") % 5 == 3, F.col("n") - 2).otherwise(F.col("n") - 1)
    parents = F.filter(F.array(first, F.when(F.col("n") % 5 == 0, F.col("n") - 3)), lambda p: p > 0)
    made = r.select("repo", F.col("n").cast("string").alias("commit_id"), "committed_at", parents.cast("array<string>").alias("parents"))
    heads = r.groupBy("repo").agg(F.max("n").cast("string").alias("commit_id")).withColumn("branch", F.lit("main"))
    asks = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("repo"), F.lit("main").alias("branch"), "ts")
    return commits.asof_commit(asks, made, heads, "ts").select("event_id", F.col("commit_id").cast("long").alias("commit_n"))


@query(
    "event_band_join",
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id BETWEEN a.event_id AND a.event_id + 100 WHERE a.event_type = 'error' AND b.event_type = 'view'",
)
def event_band_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b"))
    return joins.band_join(a, b, "user_id", "a", "b", 100).select("a", "b")


@query(
    "interval_overlap",
    """
    WITH l AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS id, l_partkey AS s, l_partkey + (l_quantity::INT % 7) - 1 AS e, l_linenumber AS n FROM lineitem)
    SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.g = b.g AND a.n = 1 AND b.n = 2 AND a.s <= b.e AND b.s <= a.e WHERE a.s <= a.e AND b.s <= b.e
    """,
)
def interval_overlap(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("int") % 7 - 1).alias("e"), "l_linenumber")
    side = lambda n, x: own.where(F.col("l_linenumber") == n).select("g", F.col("id").alias(x), F.col("s").alias(f"{x}_s"), F.col("e").alias(f"{x}_e"))
    return joins.overlap_join(side(1, "a"), side(2, "b"), "g", ("a_s", "a_e"), ("b_s", "b_e"), 64).select("a", "b")


@query("range_contains", "SELECT event_id, (value::INT BETWEEN 3 AND 9) OR (value::INT BETWEEN 40 AND 44) OR (value::INT BETWEEN 20 AND 19) AS inside FROM (SELECT event_id, floor(value) AS value FROM events)")
def range_contains(spark, sf_dir):
    r = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    return table(spark, sf_dir, "events").select("event_id", joins.in_ranges(F.floor("value"), F.array(r(3, 9), r(40, 44), r(20, 19))).alias("inside"))


@query(
    "suffix_unique_match",
    """
    WITH f AS (SELECT DISTINCT url AS path FROM pages), p AS (SELECT path, string_split(path, '/') AS c FROM f),
    s AS (SELECT path, array_to_string(c[i:], '/') AS cand FROM (SELECT path, c, unnest(range(1, len(c) + 1)) AS i FROM p)),
    u AS (SELECT cand, min(path) AS path FROM s GROUP BY cand HAVING count(*) = 1),
    q AS (SELECT DISTINCT array_to_string(c[-k:], '/') AS cand FROM (SELECT c, unnest([1, 2]) AS k FROM p))
    SELECT cand, path FROM q JOIN u USING (cand)
    """,
)
def suffix_unique_match(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    parts = F.split("path", "/")
    wanted = f.select(F.explode(F.array(*(F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), F.lit(k)), "/") for k in (1, 2)))).alias("cand")).distinct()
    return joins.unique_suffix_match(wanted, f, "cand", "path").select("cand", "path")


@query(
    "suffix_any_match",
    """
    WITH f AS (SELECT DISTINCT url AS path FROM pages), c AS (SELECT DISTINCT cand FROM (SELECT right(path, 9) AS cand FROM f UNION ALL SELECT 'x/' || path FROM f))
    SELECT cand, min(path) AS path FROM c JOIN f ON ends_with(path, cand) OR ends_with(cand, path) GROUP BY cand
    """,
)
def suffix_any_match(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    wanted = f.select(F.right("path", F.lit(9)).alias("cand")).unionByName(f.select(F.concat(F.lit("x/"), "path").alias("cand"))).distinct()
    return joins.any_suffix_match(wanted, f, "cand", "path")


@query(
    "positional_full_join",
    """
    WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role <> 'user')
    SELECT conv_id, pos::INT AS pos, u.turn AS left_turn, a.turn AS right_turn FROM u FULL JOIN a USING (conv_id, pos)
    """,
)
def positional_full_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    left, right = c.where("role = 'user'").select("conv_id", "turn"), c.where("role <> 'user'").select("conv_id", "turn")
    return joins.positional_full(left, right, ["conv_id"], "turn", width=1_000).select("conv_id", "pos", F.col("left.turn").alias("left_turn"), F.col("right.turn").alias("right_turn"))


@query(
    "nearest_ancestor",
    """
    WITH f AS (SELECT DISTINCT url AS path FROM pages), p AS (SELECT path, string_split(path, '/') AS c FROM f),
    s AS (SELECT path, i, array_to_string(c[1:i], '/') AS folder FROM (SELECT path, c, unnest(range(0, len(c))) AS i FROM p)),
    r AS (SELECT array_to_string(c[1:len(c) - 1], '/') AS folder FROM p WHERE contains(path, '?') UNION SELECT array_to_string(c[1:3], '/') FROM p WHERE NOT contains(path, '#'))
    SELECT f.path, arg_max(r.folder, i) FILTER (WHERE r.folder IS NOT NULL) AS folder FROM f LEFT JOIN s USING (path) LEFT JOIN r USING (folder) GROUP BY f.path
    """,
)
def nearest_ancestor(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    parts = F.split("path", "/")
    holds_query = f.where(F.contains("path", F.lit("?"))).select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"))
    hosts = f.where(~F.contains("path", F.lit("#"))).select(F.array_join(F.slice(parts, 1, 3), "/").alias("folder"))
    roots = holds_query.unionByName(hosts).distinct()
    return joins.nearest_ancestor(f, roots, "path", "folder")


@query(
    "first_existing_path",
    """
    WITH c AS (SELECT doc_id, unnest([0, 1, 2]) AS pos, doc_id * 7 % 1500 + unnest([0, 1, 2]) AS other FROM documents), hit AS (SELECT c.doc_id, pos, other FROM c JOIN labels ON labels.doc_id = other)
    SELECT d.doc_id, 'd' || arg_min(other, pos) AS path FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id
    """,
)
def first_existing_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    have = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    places = F.array(*(F.concat(F.lit("d"), (F.col("doc_id") * 7 % 1500 + k).cast("string")) for k in range(3)))
    return joins.first_existing(d, places, have, "path", "doc_id")


@query(
    "set_operations",
    """
    WITH w AS (SELECT c_nationkey AS k, list_sort(list_distinct(list(c_mktsegment))) AS a FROM customer WHERE c_acctbal >= 0 GROUP BY 1),
    v AS (SELECT c_nationkey AS k, list_sort(list_distinct(list(c_mktsegment))) AS b FROM customer WHERE c_acctbal < 0 GROUP BY 1)
    SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS u, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), '|') AS i, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS m, a = b AS same, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS covered FROM w JOIN v USING (k)
    """,
)
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda cond, name: c.where(cond).groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias(name))
    both = side("c_acctbal >= 0", "a").join(side("c_acctbal < 0", "b"), "k")
    return both.select("k", *(F.array_join(F.array_sort(f("a", "b")), "|").alias(n) for n, f in (("u", F.array_union), ("i", F.array_intersect), ("m", F.array_except))), (F.col("a") == F.col("b")).alias("same"), F.forall("b", lambda x: F.array_contains("a", x)).alias("covered"))


@query("severity_max", "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END)::INT AS worst, bool_or(event_type = 'error') AS any_error, bool_and(value >= 0) AS all_positive, arg_max(event_type, (CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END) * 1000000000::BIGINT - event_id) AS kind FROM events GROUP BY user_id")
def severity_max(spark, sf_dir):
    """The most severe event type of each user, the first of equals."""
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(rank).alias("worst"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.bool_and(F.col("value") >= 0).alias("all_positive"), F.max_by("event_type", F.struct(rank, -F.col("event_id"))).alias("kind"))
