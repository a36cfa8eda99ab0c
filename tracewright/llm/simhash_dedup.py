"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints of 64 bits are computed in an Arrow function, one text at a time. Texts with the same fingerprint are one
node from there on. For links within radius r, 2^(r+1) - 1 bit masks are made from one vector of r + 1 bits for each
bit position: mask v keeps the positions whose vector has an odd product with v. Any r positions are all dropped by
some mask, as r vectors never span r + 1 dimensions; so every pair within the radius agrees in some masked table, with
no probability involved. Vectors are dealt out evenly, so each mask keeps about half of the positions. Pairs in a
bucket are verified on the whole fingerprint, in blocks; components come from star contraction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import links
from tracewright.llm.common import cut, free_name, id_field, ids_and_texts, map_texts, table

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 3, 3, 42
#: Ids (some 50 bytes each) that are sent to the texts; with more of them both sides are shuffled.
DROPPED_IDS = 1_000_000
#: Bytes of a text whose words and hashes are in memory at once, some 25 times as much.
STRETCH_BYTES = 1 << 20
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks such that any two words within the radius agree under one of them."""
    vectors = [p % (2 ** (radius + 1) - 1) + 1 for p in range(bits)]
    return [sum((bin(vectors[p] & v).count("1") & 1) << p for p in range(bits)) for v in range(1, 2 ** (radius + 1))]


def word_stretches(data: bytes, most: int) -> Iterator[list[bytes]]:
    """Words of a text, those of some bytes at once; a stretch ends before white space."""
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= most else next((m.start() for m in _GAP.finditer(data, start + most)), len(data))
        yield data[start:end].split()
        start = end


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, a stretch of the text after another: A-Z lower-cased, words parted
    by ASCII white space. Each stretch takes over the last words of the one before, so none is lost."""
    digest, held, seen = xxhash.xxh64_intdigest, [], False
    for words in word_stretches(text.encode().lower() if text else b"", STRETCH_BYTES):
        words = held + words
        n = len(words) - words_each + 1
        if n > 0:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:n].tolist()
            yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)], "<u8")
            seen, words = True, words[n:]
        held = words
    if held and not seen:
        yield np.array([digest(b" ".join(held), seed)], "<u8")


def fingerprints_of(texts: list[str | None], words_each: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """A bit is set where over half of a text's hashes have it; zero for texts without words."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        counts, n = np.zeros(BITS, np.int64), 0
        for hashes in shingle_hashes(text, words_each, seed):
            n += len(hashes)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        if n:
            out[k] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and fp, the fingerprint as a long. Long texts are hashed in stretches of STRETCH_BYTES."""
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("fp", T.LongType())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(fingerprints_of(part.column("text").to_pylist()).view(np.int64))], ["doc_id", "fp"])

    return map_texts(ids_and_texts(docs, id_col, text_col), work, schema)


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v), enough to connect whatever is within the radius, among nodes (node, fp) of distinct fingerprints."""
    masks = covering_masks(radius)
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)))
    rows = nodes.where("node is not null").select("node", "fp", F.explode(keys).alias("key"))

    def linked(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        return np.bitwise_count(fp[i] ^ fp[j]) <= radius

    return links.links_of(links.in_blocks(rows), linked, dict(nodes.dtypes)["node"])


def simhash_components(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, fp (long) and component_id, the smallest id that links of `radius` or fewer differing bits reach.

    Integer ids. Null and word-free texts have fingerprint zero and link like any other. Repeated rows repeat; rows
    that share an id are one node. A null id links with nothing of its own: it takes part through rows with the same
    fingerprint only, and its component is null where there are none. An empty table gives an empty one.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = links.components(near_links(nodes, radius))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all columns; one row of it where rows share an id.

    Of rows that share an id the one with the smallest hash of its text stays (any of equal ones). Rows with a null id
    cannot be told apart and all stay. Null and empty texts are near duplicates of one another. An empty table gives
    an empty one; further columns may have any name.

    Ids of documents that go are sent to the texts while they are few (DROPPED_IDS); the texts are not shuffled then.
    """
    found = simhash_components(docs, radius, id_col, text_col).where("doc_id is not null")
    ids = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first")))
    dropped, repeated = ids.agg(F.count_if(~F.col("first")), F.count_if(F.col("first") & (F.col("rows") > 1))).first()
    gone = free_name(docs.columns, "gone")
    out = ids.where(~F.col("first")).select(F.col("doc_id").alias(gone))
    kept = docs.join(F.broadcast(out) if dropped <= DROPPED_IDS else out, docs[id_col] == F.col(gone), "left_anti")
    if repeated:
        again = ids.where(F.col("first") & (F.col("rows") > 1)).select(F.col("doc_id").alias(gone))
        own = kept.join(F.broadcast(again) if repeated <= DROPPED_IDS else again, kept[id_col] == F.col(gone), "left_semi")
        one = F.min_by(F.struct(*(own[c].alias(f"c{k}") for k, c in enumerate(docs.columns))), F.xxhash64(own[text_col].cast("string")))
        own = own.groupBy(own[id_col].alias("id")).agg(one.alias("row")).select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))
        kept = kept.join(F.broadcast(again) if repeated <= DROPPED_IDS else again, kept[id_col] == F.col(gone), "left_anti").unionByName(own)
    return kept


def op9_simhash_dedup(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
