"""Benchmark decontamination: a prefix-filtered join between windows of benchmark items and whole documents.

Each item gives windows of ten consecutive words (a shorter item one window). A window is a sequence of two-word
shingles; as all of them must be in a document that holds the window, its prefix is one shingle, and the rarest one in
the corpus is taken. Every document word position is looked up by its shingle; a hit is bounded by position (the
window must begin inside the text) and length (it must end there) and verified on the exact words.

Built-in functions only. Positions are exploded, looked up and verified inside one generated-code stage, so the words
of a document are never copied per position nor shuffled; what leaves the stage are occurrences. The windows' side is
broadcast while it has a bounded number of rows. A larger benchmark takes as many passes over the corpus, not more: each
position is first held against a broadcast table of at most FILTER_ROWS hash places of the shingles, and what is left
meets the windows in a shuffled join, with the words around it. Shingles that are frequent in the corpus are dealt out
over several keys there.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, free_name, table

WINDOW_WORDS, SHINGLE_WORDS = 10, 2
#: Rows of windows (some 200 bytes each at most) or of document ids that one broadcast may have.
BROADCAST_ROWS = 100_000
#: Hash places that stand for more shingles than that, and places of a shingle in the corpus that one key takes at least.
FILTER_ROWS, KEY_ROWS = 1 << 20, 100_000
#: What parts words in a text whose A-Z are not lower-cased yet.
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_az(text: Column) -> Column:
    """A-Z only: lower() would also change other letters, so it is for ASCII strings."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text in its own case; none for null."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _APART), "")


def shingle_at(words: Column, position: Column, size: int) -> Column:
    """`size` words from a position on (0 the first), lower-cased; shorter at the end."""
    return lower_az(F.concat_ws(" ", *(F.get(words, position + k) for k in range(size))))


def windows_of(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (window, n, item): the words of a window joined by spaces, and how many there are."""
    words = items.select(items[item_col].cast("string").alias("item"), words_of(items[text_col]).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW_WORDS))
    starts = words.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("s"))
    return starts.select(lower_az(F.array_join(F.slice("words", F.col("s"), F.col("n")), " ")).alias("window"), "n", "item").distinct()


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, hash, start, n, window) of every place in docs (id, hash, words) where a window (window, n) occurs."""
    parts = cut(
        windows.select("window", "n", F.split("window", " ").alias("words"))
        .select("window", "n", F.when(F.col("n") >= SHINGLE_WORDS, SHINGLE_WORDS).otherwise(1).alias("size"), "words", F.expr(f"posexplode(slice(words, 1, greatest(n - {SHINGLE_WORDS - 1}, 1))) as (offset, first)"))
        .select("window", "n", "size", "offset", shingle_at(F.col("words"), F.col("offset"), SHINGLE_WORDS).alias("shingle"))
    )
    held = {r["size"]: (r["rows"], r["shingles"]) for r in parts.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("shingle").alias("shingles")).collect()}
    found = []
    for size, (rows, shingles) in sorted(held.items()):
        # the outer form, as the inner one would add a filter that splits every text a second time
        places = docs.select("id", "hash", "words", F.posexplode_outer("words").alias("at", "word")).withColumn("shingle", shingle_at(F.col("words"), F.col("at"), size))
        own = parts.where(F.col("size") == size)
        if shingles <= BROADCAST_ROWS:
            likely = places.select("shingle").join(F.broadcast(own.select("shingle").distinct()), "shingle")
            seen = likely.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
        else:
            seen = _likely(places, own).groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
        # a window with a shingle that no document has cannot occur
        rated = own.join(seen, "shingle", "left")
        rarest = cut(rated.groupBy("window", "n").agg(F.min(F.coalesce("seen", F.lit(0))).alias("seen"), F.min_by(F.struct("shingle", "offset"), F.struct("seen", "offset")).alias("prefix")).where("seen > 0").select("window", "n", "prefix.shingle", "prefix.offset", "seen"))
        if rows <= BROADCAST_ROWS:
            hit = places.join(F.broadcast(rarest.drop("seen")), "shingle").withColumn("start", F.col("at") - F.col("offset"))
            bounded = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words"))
            exact = lower_az(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")) == F.col("window")
            found.append(hit.where(F.when(bounded, exact).otherwise(False)).select("id", "hash", "start", "n", "window"))
        else:
            found.append(_met(places, rarest))
    return reduce(DataFrame.unionByName, found) if found else None


def _place(shingle: Column) -> Column:
    return F.pmod(F.xxhash64(shingle), F.lit(FILTER_ROWS)).cast("int")


def _likely(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions whose shingle has the hash place of a wanted one: all of these, and others while places are many."""
    held = wanted.select(_place(F.col("shingle")).alias("place")).distinct()
    return places.withColumn("place", _place(F.col("shingle"))).join(F.broadcast(held), "place").drop("place")


def _met(places: DataFrame, rarest: DataFrame) -> DataFrame:
    """(id, hash, start, n, window) by a shuffled join of likely positions, which carry the words around them."""
    reach = WINDOW_WORDS - 1
    first = F.greatest(F.col("at") - reach, F.lit(0))
    around = F.slice("words", first + 1, F.col("at") - first + WINDOW_WORDS)
    likely = _likely(places, rarest).select("id", "hash", "at", "shingle", (F.col("at") - first).alias("ahead"), around.alias("around"))
    # shingles are dealt out over as many keys as their places fill; those with more than one key are few
    hot = rarest.groupBy("shingle").agg(F.max("seen").alias("seen")).where(F.col("seen") > KEY_ROWS).select("shingle", F.ceil(F.col("seen") / KEY_ROWS).cast("int").alias("keys"))
    likely = likely.join(hot, "shingle", "left").withColumn("key", F.when(F.col("keys").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "hash", "at"), F.col("keys")).cast("int"))).drop("keys")
    windows = rarest.withColumn("key", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("seen") / KEY_ROWS).cast("int"), F.lit(1)) - 1))).drop("seen")
    hit = likely.join(windows, ["shingle", "key"])
    bounded = (F.col("ahead") >= F.col("offset")) & (F.col("ahead") - F.col("offset") + F.col("n") <= F.size("around"))
    exact = lower_az(F.array_join(F.slice("around", F.col("ahead") - F.col("offset") + 1, F.col("n")), " ")) == F.col("window")
    return hit.where(F.when(bounded, exact).otherwise(False)).select("id", "hash", (F.col("at") - F.col("offset")).alias("start"), "n", "window")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurrence), n_items, items (their ids as sorted strings).

    Null and empty texts have no words; an item without words has no window; a null item id counts for hits but not
    as an item. Repeated rows repeat, each with the figures of its own text; ids need not be unique or non-null. Empty
    docs give an empty table; without items nothing is hit. Further columns are ignored.
    """
    text = docs[text_col].cast("string")
    whole = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), words_of(text).alias("words"))
    owners = cut(windows_of(items, item_col, item_text_col))
    windows = owners.select("window", "n").distinct()
    hits = occurrences(whole, windows)
    counted = whole.select("id", "hash", F.size("words").cast("long").alias("n_words"))
    nothing = F.array().cast("array<string>")
    if hits is None:
        return counted.select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items"))
    hits = cut(hits.distinct())
    inside = hits.select("id", "hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    n_hit = inside.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n_hit"))
    held = hits.select("id", "hash", "window").distinct().join(owners.select("window", "item").where("item is not null"), "window").select("id", "hash", "item").distinct()
    by_doc = held.groupBy("id", "hash").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = n_hit.join(by_doc, n_hit["id"].eqNullSafe(by_doc["id"]) & (n_hit["hash"] == by_doc["hash"]), "left").select(n_hit["id"], n_hit["hash"], "n_hit", "items")
    out = counted.join(found, counted["id"].eqNullSafe(found["id"]) & (counted["hash"] == found["hash"]), "left")
    items_col = F.coalesce(found["items"], nothing)
    return out.select(counted["id"].alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no window of any item, with all columns, whatever their names.

    Null and empty texts hold none and stay; repeated rows stay or go alike; ids need not be unique or non-null. An
    empty table gives an empty one; without items all rows stay. Only (id, hash) pairs of the others are joined; up to
    BROADCAST_ROWS of them go to the texts, beyond that both sides are shuffled.
    """
    text = docs[text_col].cast("string")
    whole = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), words_of(docs[text_col]).alias("words"))
    hits = occurrences(whole, windows_of(items, item_col, item_text_col).select("window", "n").distinct())
    if hits is None:
        return docs
    of_id, of_text = free_name(docs.columns, "bad_id"), free_name(docs.columns, "bad_text")
    bad = cut(hits.select(F.col("id").alias(of_id), F.col("hash").alias(of_text)).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_text)), "left_anti")


def op8_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[s:s + l - 1] AS g, l FROM starts),
lens AS (SELECT DISTINCT l FROM win),
ds AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, lens WHERE len(w) >= l),
occ AS (SELECT doc_id, s, ds.l, item_id FROM ds JOIN win ON win.g = ds.w[ds.s:ds.s + ds.l - 1] AND win.l = ds.l),
inside AS (SELECT doc_id, unnest(range(s, s + l)) AS p FROM occ),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM inside GROUP BY doc_id),
held AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM held GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
