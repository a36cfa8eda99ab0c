"""Inputs for text and code queries that are built from whole document texts, as Spark columns and as DuckDB SQL.

Regular expressions of different engines agree on ASCII, so texts are taken with everything else as a space. The tables hold
no code: a module is built from the words of a text by templates, a line or a definition for each word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of so many letters become definitions, shorter ones comments.
LONG_WORD = 12
#: Stands for a line break in literals, whatever a client does to strings.
BREAK = "~~"


def ascii_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\n -~]", " ")


ASCII_SQL = "regexp_replace(coalesce(text, ''), '[^\\n -~]', ' ', 'g')"


def sql_text(value: str) -> str:
    literal = "'" + value.replace("'", "''").replace("\n", BREAK) + "'"
    return f"replace({literal}, '{BREAK}', chr(10))" if "\n" in value else literal


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values) -> Column:
    """One of the values, by id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def pick_sql(values) -> str:
    return f"replace({sql_list(v.replace(chr(10), BREAK) for v in values)}[doc_id % {len(values)} + 1], '{BREAK}', chr(10))"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(ascii_text(text)), F.lit("[a-z]+"), F.lit(0))


WORDS_SQL = f"regexp_extract_all(lower({ASCII_SQL}), '[a-z]+')"


class Module:
    """Code from the words of a text. head comes first; the first template is for short words, the others take turns.

    Templates may have {w} (the word), {i} (its number from 1), {n} (its length) and any further {name} whose value is
    given by `values`.
    """

    def __init__(self, head: str, templates: tuple[str, ...]):
        self.head, self.templates = head, templates

    def source(self, text: Column, **values: str) -> Column:
        def filled(template, w, i):
            for name, value in values.items():
                template = template.replace("{" + name + "}", value)
            out = F.lit(template)
            for name, value in (("{w}", w), ("{i}", i), ("{n}", F.length(w).cast("string"))):
                out = F.replace(out, F.lit(name), value) if name in template else out
            return out

        def piece(w, i):
            place, number = i + 1, (i + 1).cast("string")
            out = filled(self.templates[0], w, number)
            kind = (F.length(w) + place) % (len(self.templates) - 1) + 1
            for k, template in enumerate(self.templates[1:], 1):
                out = F.when((F.length(w) >= LONG_WORD) & (kind == k), filled(template, w, number)).otherwise(out)
            return out

        return F.concat(F.lit(self.head), F.array_join(F.transform(words(text), piece), "\n"))

    def _filled_sql(self, template: str, **values: str) -> str:
        for name, value in values.items():
            template = template.replace("{" + name + "}", value)
        out = "'" + template.replace("'", "''").replace("\n", BREAK) + "'"
        for name, value in (("{w}", "w"), ("{i}", "i::VARCHAR"), ("{n}", "n::VARCHAR")):
            out = f"replace({out}, '{name}', {value})" if name in template else out
        return f"replace({out}, '{BREAK}', chr(10))" if "\n" in template else out

    def pieces_sql(self, name: str = "p", **values: str) -> str:
        """CTEs up to `name`: (doc_id, i, w, n, k, line): each word, its template's number and its first line."""
        lines = lambda t: t.format_map(_Blank(values)).count("\n") + 1
        sizes = "[" + ", ".join(str(lines(t)) for t in self.templates) + "]"
        return f"""{name}_w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
        {name}_i AS (SELECT doc_id, ws[i] AS w, i, length(ws[i]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM {name}_w)),
        {name}_k AS (SELECT *, CASE WHEN n < {LONG_WORD} THEN 0 ELSE (n + i) % {len(self.templates) - 1} + 1 END AS k FROM {name}_i),
        {name} AS (SELECT *, {self.head.count(chr(10)) + 1} + (coalesce(sum({sizes}[k + 1]) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line FROM {name}_k)"""

    def template_sql(self, k: int, **values: str) -> str:
        return self._filled_sql(self.templates[k], **values)

    def lines_sql(self, name: str = "p", **values: str) -> str:
        """Lines of a document's module."""
        lines = lambda t: t.format_map(_Blank(values)).count("\n") + 1
        sizes = "[" + ", ".join(str(lines(t)) for t in self.templates) + "]"
        return f"SELECT doc_id, ({self.head.count(chr(10))} + greatest(coalesce(sum({sizes}[k + 1]), 1), 1))::BIGINT AS n_lines FROM documents LEFT JOIN {name} USING (doc_id) GROUP BY doc_id"


class _Blank(dict):
    def __missing__(self, key):
        return key
