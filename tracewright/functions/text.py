"""Text functions as column expressions; regexes use (?U) where the meaning is that of Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names too common to identify code. Fixed values.
COMMON_NAMES = (
    "print", "len", "str", "int", "dict", "list", "range", "type", "isinstance", "super", "getattr", "setattr", "format", "open", "sorted", "enumerate", "zip", "map", "filter", "input", "float",
    "bool", "set", "tuple", "sum", "min", "max", "abs", "round", "repr", "hash", "id", "next", "iter", "vars", "dir", "help",
)
# Patterns of issue texts. Fixed values.
IDENTIFIER = r"`([\w.]+)`"
PYTHON_PATH = r"`?([\w\-/]+\.py)`?"
EXCEPTION = r"\b([A-Z][a-zA-Z0-9]*(?:Error|Exception|Warning))\b\s*:"
TRACEBACK_PATH = r'File "([^"]+\.py)"'
QUOTED_PATH = r"`{1,3}([^`\s]+\.py)`{1,3}"
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg")
CORE_PREFIX, INTEGRATION_PREFIX = "llama-index-core/", "llama-index-integrations/"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokenize(text: Column) -> Column:
    """Lower-cased identifiers."""
    return _all(F.lower(text), "[A-Za-z_][A-Za-z0-9_]*", 0)


def clean_description(body: Column) -> Column:
    """The part of an issue body that describes: before the first header, or the first section; without fenced code."""
    body = F.coalesce(body, F.lit(""))
    header = r"(?m)^#{1,6}[\s]"
    at_start = body.rlike(r"^#{1,6}[\s]")
    before = F.regexp_extract(body, r"(?s)\A(.*?)(?:(?m:^)#{1,6}\s|\z)", 1)
    rest = F.regexp_replace(body, r"\A#{1,6}\s(?:[^\n]*\n|(?=[^\n]*\z))", "")
    section = F.regexp_extract(rest, r"(?s)\A(.*?)(?:(?m:^)#{1,6}\s|\z)", 1)
    head = F.when(at_start, section).when(body.rlike(header), before).otherwise(body)
    return strip(F.regexp_replace(head, r"(?s)```.*?```", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def identifiers(text: Column) -> Column:
    """Distinct last segments of names in backticks, sorted, without the most common names."""
    last = F.transform(_all(text, "(?U)" + IDENTIFIER, 1), lambda s: F.element_at(F.split(s, r"\."), -1))
    return F.array_sort(F.filter(F.array_distinct(last), lambda s: ~s.isin(*COMMON_NAMES)))


def python_paths(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, "(?U)" + PYTHON_PATH, 1)))


def exception_types(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, "(?U)" + EXCEPTION, 1)))


def semantic_text(title: Column, body: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), clean_description(body)))


def referenced_paths(text: Column) -> Column:
    """Paths in traceback frames and in backticks, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(_all(text, TRACEBACK_PATH, 1), _all(text, "(?U)" + QUOTED_PATH, 1))))


def canonical_path(path: Column, root: str) -> Column:
    """From the last component named root on; null for paths without it; bare names stay."""
    parts = F.split(F.trim(path), "/")
    back = F.array_position(F.reverse(parts), root)
    tail = F.array_join(F.slice(parts, F.size(parts) - back.cast("int") + 1, back.cast("int")), "/")
    return F.when(~F.contains(path, F.lit("/")), F.trim(path)).when(back > 0, tail)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]+#[^\\n]*", "")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty part."""
    return F.when(part == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of old in text replaced; the text itself where there is none."""
    found = F.instr(text, old)
    return F.when(found > 0, F.concat(F.substring(text, F.lit(1), found - 1), new, F.substring(text, found + F.length(old), F.length(text)))).otherwise(text)


def without_fence(text: Column) -> Column:
    """Without the Markdown fence that a response begins with, and the one it then ends with."""
    own = strip(text)
    inner = F.when(F.contains(own, F.lit("\n")), F.regexp_replace(own, r"\A[^\n]*\n", "")).otherwise(F.substring(own, F.lit(4), F.length(own)))
    return F.when(own.startswith("```"), strip(F.regexp_replace(inner, r"```\z", ""))).otherwise(own)


def added_ranges(diff: Column, drop_empty: bool = True) -> Column:
    """Ranges of new-side lines in hunk headers; a header with count 0 is dropped, or an empty range (start > end)."""
    heads = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda line: line.rlike(r"^@@[^+]*\+\d+(,\d+)?\s*@@"))

    def one(line):
        start = F.regexp_extract(line, r"\+(\d+)", 1).cast("int")
        count = F.coalesce(F.nullif(F.regexp_extract(line, r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
        return F.struct(start.alias("start"), (start + count - 1).alias("end"))

    ranges = F.transform(heads, one)
    return F.filter(ranges, lambda r: r["end"] >= r["start"]) if drop_empty else ranges


def changed_paths(diff: Column) -> Column:
    return _all(F.coalesce(diff, F.lit("")), r"(?m)^diff --git a/(\S+) b/\S+", 1)


def diff_class(diff: Column, core: str = CORE_PREFIX, integration: str = INTEGRATION_PREFIX) -> Column:
    """core, integration, mixed, other, or unknown where no path is found."""
    paths = changed_paths(diff)
    in_core, in_integration = F.exists(paths, lambda p: p.startswith(core)), F.exists(paths, lambda p: p.startswith(integration))
    return F.when(F.size(paths) == 0, "unknown").when(in_core & in_integration, "mixed").when(in_core, "core").when(in_integration, "integration").otherwise("other")


def lint_finding(line: Column) -> Column:
    """path:line:col: message as a struct; null where the line has another form."""
    p = r"^([^:]*):(\d+):(\d+):? ?(.*)$"
    part = lambda k: F.regexp_extract(line, p, k)
    return F.when(line.rlike(p), F.struct(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("message")))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    found = F.split(text, r"\R|[\x1c-\x1e]")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def head(text: Column, n: int, note: str = "... (truncated)") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(note))).otherwise(text)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def is_test_file(path: Column, rule: str = "name") -> Column:
    """rule `name`: test_* or *_test.py, or a tests or test folder; `file`: its first part alone; `folder`: a tests folder or
    test_*.py."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    if rule == "file":
        return name.startswith("test_") | name.endswith("_test.py")
    if rule == "folder":
        return F.array_contains(parts, "tests") | (name.startswith("test_") & name.endswith(".py"))
    return name.startswith("test_") | name.endswith("_test.py") | F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("tests"), F.lit("test")))


def prompt(title: Column, semantic: Column, sources: Column, retry_note: Column) -> Column:
    """Prompt sections that are there, one after another."""
    return F.concat_ws("\n\n", F.concat(F.lit("Issue: "), title), semantic, F.when(F.size(sources) > 0, F.array_join(sources, "\n---\n")), retry_note)


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, as text; halves go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))


def utc_iso(at: Column) -> Column:
    """A time as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(at: Column) -> Column:
    return F.unix_micros(at) / 1e6
