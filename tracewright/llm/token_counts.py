"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are packed into batches of about equal bytes, so no call holds many ids at once. A long text is split at safe
boundaries first: a single space that follows a character other than a space or word mark, and that does not end the
text. No piece of the model reaches from another character into a following word mark, so no token crosses such a
place; the space itself is dropped, since the encoder puts one before each part. Nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import id_field, ids_and_texts, map_texts, table

MODEL = "piece_bpe_32k.model"
#: Characters of a part of a long text, and UTF-8 bytes of all parts that are encoded in one call.
PART_CHARS, CALL_BYTES = 2_000, 200_000
TOKEN_LIMIT = 4096
_SAFE = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


@lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    """The loaded model, checked for the property that splitting rests on: marks only ahead of other characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} reaches over a word mark: texts cannot be split at spaces")
    return model


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of at least `size` characters, but for the last, whose token counts add up to the text's."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size and (found := _SAFE.search(text, start + size)):
        parts.append(text[start : found.start()])
        start = found.end()
    parts.append(text[start:])
    return parts


def count_tokens(texts: list[str | None], model) -> np.ndarray:
    """Tokens of each text, without begin or end ids."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = safe_parts(text or "")
        parts += own
        owner += [i] * len(own)
    counts, start, held = [], 0, 0
    for k, part in enumerate(parts):
        n = len(part) if part.isascii() else len(part.encode())
        if held and held + n > CALL_BYTES:
            counts += map(len, model.encode(parts[start:k], num_threads=1))
            start, held = k, 0
        held += n
    counts += map(len, model.encode(parts[start:], num_threads=1))
    return np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); every input row gives one row, so repeated rows repeat; an empty
    table gives an empty one; further columns are ignored.
    """
    path = model_path or public_tokenizers.path(MODEL)
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def lengths(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        tokens = count_tokens(texts, sentencepiece_model(path))
        n_bytes = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(tokens), pa.array(n_bytes)], ["doc_id", "n_tokens", "n_bytes"])

    counted = map_texts(ids_and_texts(docs, id_col, text_col), lengths, schema)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
