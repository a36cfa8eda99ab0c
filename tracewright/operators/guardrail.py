"""Safety scan of proposed source: text rules as column expressions, tree rules in an Arrow function.

Both layers always run; per category the text layer's finding goes first, and of the categories hit the most urgent is
reported. Order is encoded in the expressions, never taken from row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import pyast
from tracewright.functions.text import lines
from tracewright.session import ship

CREDENTIALS, CODE, DESTRUCTIVE = "credential_exfiltration", "arbitrary_code_execution", "destructive_shell_command"
#: Most urgent first. Fixed values, as are the rules below.
PRIORITY = (CREDENTIALS, CODE, DESTRUCTIVE)
PATTERNS = {
    DESTRUCTIVE: (
        r"""\brm[\s"',]+-rf\b""",
        r"""\brm[\s"',]+-f\b.*\*""",
        r"""\bgit[\s"',]*push[\s"',]+(--force|-f)\b""",
        r"""\bgit[\s"',]*reset[\s"',]+--hard\b""",
        r"""\bdd[\s"',]*if=""",
        r"""\bmkfs\b""",
        r""">\s*/dev/sd[a-z]""",
        r"""\bchmod[\s"',]+-R[\s"',]+777\b""",
        r"""\bchown[\s"',]+-R\b""",
    ),
    CREDENTIALS: (
        r"""AKIA[0-9A-Z]{16}""",
        r"""sk-[a-zA-Z0-9]{20,}""",
        r"""api_key\s*=\s*["'][^"']{20,}["']""",
    ),
    CODE: (
        r"""\beval\s*\(""",
        r"""\bexec\s*\(""",
        r"""\bos\.system\s*\(""",
        r"""\bpickle\.loads\s*\(""",
        r"""__import__\s*\(""",
    ),
}
NEIGHBOURS = {
    CREDENTIALS: (r"""os\.environ|os\.getenv|\.env\b""", r"""requests\.(get|post)|urllib|socket\.|print\s*\(|log\w*\.\w+\s*\(""", 10),
    CODE: (r"""\bsubprocess\.""", r"""shell\s*=\s*True""", 3),
}


#: What every text that a pattern finds holds, so that a look for it rules the pattern out.
REQUIRED = {
    DESTRUCTIVE: ("-rf", "-f", "push", "--hard", "if=", "mkfs", "/dev/sd", "777", "chown"),
    CREDENTIALS: ("AKIA", "sk-", "api_key"),
    CODE: ("eval", "exec", "os.system", "pickle.loads", "__import__"),
}
REQUIRED_NEIGHBOURS = {
    CREDENTIALS: ((".env", "os.getenv"), ("requests.", "urllib", "socket.", "print", "log")),
    CODE: (("subprocess.",), ("shell",)),
}


def bound(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_pair(text_lines: Column, first: str, second: str, window: int) -> Column:
    """(a, b): the first lines, from 1, such that a has the first pattern and b within window lines on the second.

    In one row and in a time linear in the lines: each line becomes a sign that tells which patterns it has, and the
    leftmost shortest match over the signs is the pair.
    """
    sign = lambda line: F.when(line.rlike(first), F.when(line.rlike(second), "c").otherwise("a")).when(line.rlike(second), "b").otherwise(".")
    signs = F.array_join(F.transform(text_lines, sign), "")
    pattern = F.lit(f"c|a.{{0,{window - 1}}}?[bc]")

    def found(s):
        return bound(F.regexp_substr(s, pattern), lambda m: bound(F.regexp_instr(s, pattern), lambda a: F.when(m.isNotNull(), F.struct(a.alias("a"), (a + F.length(m) - 1).alias("b")))))

    return bound(signs, found)


def _holds(source: Column, parts) -> Column:
    out = F.contains(source, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(source, F.lit(p))
    return out


def text_findings(source: Column) -> dict[str, Column]:
    """By category the first finding of the text layer, null where there is none."""
    found = {}
    for category in PRIORITY:
        own = F.coalesce(*(F.when(_holds(source, [part]) & source.rlike("(?U)" + p), F.lit(f"pattern {p}")) for p, part in zip(PATTERNS[category], REQUIRED[category], strict=True)))
        if category in NEIGHBOURS:
            a, b, window = NEIGHBOURS[category]
            there = _holds(source, REQUIRED_NEIGHBOURS[category][0]) & _holds(source, REQUIRED_NEIGHBOURS[category][1])
            said = bound(first_pair(lines(source), "(?U)" + a, "(?U)" + b, window), lambda p: F.concat(F.lit("lines "), p["a"].cast("string"), F.lit(" and "), p["b"].cast("string")))
            own = F.coalesce(own, F.when(there, said))
        found[category] = own
    return found


def _first_hit(details: dict[str, Column]) -> Column:
    """(category, detail) of the most urgent category with a detail; null where none has one."""
    every = F.array(*(F.struct(F.lit(k).alias("category"), details[k].alias("detail")) for k in PRIORITY))
    return F.get(F.filter(every, lambda x: x["detail"].isNotNull()), F.lit(0))


def _reported(frame: DataFrame, hit: Column) -> DataFrame:
    marked = frame.withColumn("__hit", hit)
    return marked.withColumns({"tripped": F.col("__hit").isNotNull(), "category": F.col("__hit.category"), "detail": F.col("__hit.detail")}).drop("__hit")


def scan_text(frame: DataFrame, source: str = "source") -> DataFrame:
    """Adds tripped, category and detail by the text rules alone. A null source trips nothing."""
    return _reported(frame, _first_hit(text_findings(F.coalesce(F.col(source), F.lit("")))))


def scan(frame: DataFrame, source: str = "source") -> DataFrame:
    """Adds tripped, category, detail and ast_parse_ok (whether the tree layer could run)."""
    ship(frame.sparkSession)
    tree = F.udf(pyast.guardrail_facts, "parse_ok boolean, code_execution string, credentials string", useArrow=True)
    marked = frame.withColumn("__tree", tree(F.col(source)))
    found, by_tree = text_findings(F.coalesce(F.col(source), F.lit(""))), {CODE: "code_execution", CREDENTIALS: "credentials"}
    hit = _first_hit({k: F.coalesce(c, F.col("__tree")[by_tree[k]]) if k in by_tree else c for k, c in found.items()})
    return _reported(marked, hit).withColumn("ast_parse_ok", F.col("__tree.parse_ok")).drop("__tree")
