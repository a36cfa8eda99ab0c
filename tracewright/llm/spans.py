"""Spans as arrays of (kind, start, end) in code points, and the digests of them that the queries return."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(SPAN)


class CodePoints:
    """Code point offsets of byte offsets in one UTF-8 text."""

    def __init__(self, data: bytes):
        self.ahead = None if data.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])

    def __call__(self, offset: int) -> int:
        return offset if self.ahead is None else int(self.ahead[offset])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined; spans are in the order start, kind already."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
