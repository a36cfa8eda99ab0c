"""Settings of a collection, from the session's configuration, read when it is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX = "spark.tracewright.collect."


@dataclass(frozen=True)
class Collection:
    """Which repository is collected, how many records at most, and where checkpoints and results go."""

    repository: str
    limit: int | None
    checkpoint: str
    out: str
    page_rows: int


def collection(spark: SparkSession) -> Collection:
    """From spark.tracewright.collect.{repository, limit, checkpoint, out, page_rows}; the first has no default."""
    get = lambda name, default=None: spark.conf.get(PREFIX + name, default)
    repository = get("repository", "")
    if not repository:
        raise ValueError(f"{PREFIX}repository is not set")
    limit = get("limit", "")
    return Collection(repository, int(limit) if limit else None, get("checkpoint", "collected"), get("out", "issues"), int(get("page_rows", "50")))
