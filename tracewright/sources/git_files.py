"""Files of patches out of git work trees: what changed, both versions and the diff, as the table that patch checks read.

Each work tree is read by one task, with read-only git commands; the trees must be on a path that executors see.
"""

from __future__ import annotations

import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.session import ship

TIMEOUT_SECONDS = 30
FILES = "patch_id string, file_path string, old_source string, new_source string, diff_text string, error string"


def git(worktree: str, *args: str) -> str | None:
    """What a git command says; None where it fails."""
    try:
        done = subprocess.run(["git", "-C", worktree, "-c", "core.quotepath=off", *args], capture_output=True, timeout=TIMEOUT_SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def _versions(patch: str, worktree: str, base: str, head: str, suffix: str):
    names = git(worktree, "diff", "--name-only", "-z", f"{base}..{head}")
    if names is None:
        return [(patch, None, None, None, None, f"no diff of {base} and {head}")]
    found = sorted(n for n in names.split("\0") if n.endswith(suffix) and n)
    return [(patch, n, git(worktree, "show", f"{base}:{n}"), git(worktree, "show", f"{head}:{n}"), git(worktree, "diff", "--unified=0", f"{base}..{head}", "--", n), None) for n in found]


def file_versions(patches: DataFrame, suffix: str = ".py") -> DataFrame:
    """(patch_id, file_path, old_source, new_source, diff_text, error) of the files that changed from base_ref to head_ref.

    patches: patch_id, worktree, base_ref, head_ref. A version that is not there is null. A patch without changed files has
    no row; one whose tree or refs can't be read has a row with the error.
    """
    ship(patches.sparkSession)
    names = [f.split()[0] for f in FILES.split(", ")]

    def read(batches):
        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("patch_id", "worktree", "base_ref", "head_ref")), strict=True):
                rows = _versions(*own, suffix)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 6, names)

    return patches.select(*(patches[c].cast("string").alias(c) for c in ("patch_id", "worktree", "base_ref", "head_ref"))).mapInArrow(read, FILES)


def clean_trees(patches: DataFrame) -> DataFrame:
    """(patch_id, clean): whether the work tree has no changes; null where it can't be read."""
    ship(patches.sparkSession)

    def read(batches):
        for batch in batches:
            said = [git(w, "status", "--porcelain") for w in batch.column("worktree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("patch_id"), pa.array([None if s is None else s.strip() == "" for s in said], pa.bool_())], ["patch_id", "clean"])

    return patches.select(patches["patch_id"].cast("string").alias("patch_id"), patches["worktree"].cast("string").alias("worktree")).mapInArrow(read, "patch_id string, clean boolean")
