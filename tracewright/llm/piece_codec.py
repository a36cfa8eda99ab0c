"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece reaches from another character into a following word mark, so a text falls into marked words (a run of
marks, then other characters) that are segmented independently. Within an Arrow batch each distinct marked word is
segmented and decoded once; ids and decoded words are joined back by position with Arrow's take. The table of the
words seen is kept from batch to batch within a bound. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import id_field, ids_and_texts, map_texts, table
from tracewright.llm.token_counts import MODEL, sentencepiece_model

MARK = "▁"
#: Distinct words, and their characters, that a worker keeps from batch to batch; the table is emptied beyond either.
TABLE_WORDS, TABLE_CHARS = 100_000, 2_000_000
#: Bytes of text at once; ids and decoded words of them take some 50 times as much memory.
SLICE_BYTES = 2 << 20
_RUNS = re.compile(" +[^ ]*")


def marked_words(text: str) -> list[str]:
    """The words of a text, each without the first of its marks: joined by single spaces they give the text again."""
    return [w[1:] for w in _RUNS.findall(" " + text)] if text else []


class ChunkTable:
    """Ids and decoded text of each distinct marked word."""

    def __init__(self, path: str):
        self.model = sentencepiece_model(path)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.chars = 0
        self.lone_mark = self.model.piece_to_id(MARK)

    def rows(self, words: list[str]) -> list[tuple[bytes, str]]:
        if len(self.known) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.known.clear()
            self.chars = 0
        new = [w for w in words if w not in self.known]
        self.chars += sum(map(len, new))
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            ids = [x if w else [self.lone_mark] for w, x in zip(part, self.model.encode(part, num_threads=1), strict=True)]
            for w, x, decoded in zip(part, ids, self.model.decode(ids, num_threads=1), strict=True):
                self.known[w] = (np.array(x, "<u4").tobytes(), decoded)
        return [self.known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts one after another with the offsets of each text, and the decoded texts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.match_substring_regex(texts, "^ |  | $")
        if pc.any(odd).as_py():
            lists = [marked_words(t) if o else (t.split(" ") if t else []) for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
            lists = pa.array(lists, pa.list_(pa.string()))
            empty = np.zeros(len(texts), bool)
        else:
            lists = pc.split_pattern(texts, " ")
            empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist())
        sizes = np.array([len(r[0]) // 4 for r in rows], np.int64)
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(r[0] for r in rows), "<u4")))
        where = coded.indices
        ids = each.take(where).flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes[where.to_numpy(zero_copy_only=False)])]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array([r[1] for r in rows], pa.string()).take(where)), " ")
        offsets = starts[bounds]
        if empty.any():  # split gives an empty text one empty word, which has no id
            drop = np.zeros(len(ids), bool)
            drop[offsets[:-1][empty]] = True
            ids, less = ids[~drop], np.concatenate([[0], np.cumsum(empty)])
            offsets = offsets - less
        return ids, offsets, joined


def encode_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ids (with begin and end ids) and decoded text.

    A null text counts as empty: begin and end ids only, decoded to an empty text. Repeated rows repeat; an empty
    table gives an empty one; further columns are ignored.
    """
    return _coded(docs, model_path, id_col, text_col, digest=False)


def encode_digest(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but with the number of ids and digests in place of ids and text."""
    return _coded(docs, model_path, id_col, text_col, digest=True)


def _coded(docs: DataFrame, model_path: str | None, id_col: str, text_col: str, digest: bool) -> DataFrame:
    path = model_path or public_tokenizers.path(MODEL)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not digest:
        fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType([id_field(docs, id_col, "doc_id"), *fields])
    held: list[ChunkTable] = []  # one table in each task

    def code(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(ChunkTable(path))
        chunks, model = held[0], held[0].model
        ids, offsets, decoded = chunks.encode(part.column("text"))
        begin, end = (np.array([x], "<u4") for x in (model.bos_id(), model.eos_id()))
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        if digest:
            columns = [pa.array(np.diff(offsets) + 2), pa.array([_sha(begin, ids[a:b], end) for a, b in spans]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded.to_pylist()])]
        else:
            columns = [pa.array([np.concatenate([begin, ids[a:b], end]).astype(np.int32) for a, b in spans], pa.list_(pa.int32())), decoded]
        return pa.RecordBatch.from_arrays([part.column("id"), *columns], schema=pa.schema([pa.field("doc_id", part.column("id").type), *(pa.field(f.name, c.type) for f, c in zip(fields, columns, strict=True))]))

    return map_texts(ids_and_texts(docs, id_col, text_col), code, schema, SLICE_BYTES)


def _sha(*arrays: np.ndarray) -> str:
    digest = hashlib.sha256()
    for a in arrays:
        digest.update(np.ascontiguousarray(a, "<u4").data)
    return digest.hexdigest()


def op7_piece_codec(spark, sf_dir):
    return encode_digest(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
