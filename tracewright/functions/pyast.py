"""Facts about Python source from its syntax tree. Plain Python without Spark: executors call it per row."""

from __future__ import annotations

import ast
import builtins
import sys
import traceback
from collections.abc import Iterator
from contextlib import contextmanager

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*FUNCTIONS, ast.Lambda)


def parse(source: str | None) -> tuple[ast.Module | None, str | None]:
    """The tree, or why there is none."""
    try:
        return ast.parse(source or ""), None
    except FAILURES as e:
        return None, f"{type(e).__name__}: {e}"


#: What parsing a source, or writing out its tree, may raise; it belongs to the row of that source.
FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)


@contextmanager
def deep(frames: int = 200_000):
    """Room for the recursion of ast.unparse over trees as deep as the parser makes them."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, frames))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def unparsed(node: ast.AST) -> str:
    with deep():
        return ast.unparse(node)


def dotted(node: ast.AST) -> str | None:
    """a.b.c for a chain of attributes on a name; None for other expressions."""
    names = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *names]) if isinstance(node, ast.Name) else None


def failure(e: Exception) -> dict:
    """Type, message, traceback, and for a SyntaxError its place."""
    place = {k: getattr(e, k, None) for k in ("lineno", "offset")}
    return {"error": f"{type(e).__name__}: {e}", "error_type": type(e).__name__, "traceback": "".join(traceback.format_exception(e)), **place}


# --- chunks ---------------------------------------------------------------------------------------------------------


class Chunker:
    """The functions, classes and methods of one file as rows."""

    def __init__(self, path: str, source: str, tree: ast.Module):
        self.path, self.lines, self.tree = path, source.splitlines(), tree
        self.imports = [self.import_text(n) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]

    @staticmethod
    def import_text(node: ast.Import | ast.ImportFrom) -> str:
        names = ", ".join(a.name + (f" as {a.asname}" if a.asname else "") for a in node.names)
        return f"import {names}" if isinstance(node, ast.Import) else f"from {'.' * node.level}{node.module or ''} import {names}"

    def span(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last])

    def whole(self, node) -> str:
        """With its decorators."""
        return self.span(min([node.lineno, *(d.lineno for d in node.decorator_list[:1])]), node.end_lineno)

    def row(self, node, kind: str, chunk_id: str, owner: str | None, context: str | None) -> dict:
        is_class = kind == "class"
        signature = None
        if not is_class:
            word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            gives = f"-> {unparsed(node.returns)}" if node.returns is not None else ""
            signature = f"{word} {node.name}({unparsed(node.args)}) {gives}:"
        return {
            "chunk_id": chunk_id, "type": kind, "name": node.name, "class_name": owner, "file_path": self.path, "start_line": node.lineno, "end_line": node.end_lineno,
            "source": self.whole(node), "class_context": context, "signature": signature, "docstring": ast.get_docstring(node), "decorators": [self.span(d.lineno, d.end_lineno) for d in node.decorator_list],
            "bases": [unparsed(b) for b in node.bases] if is_class else None,
            "class_attributes": [self.span(x.lineno, x.end_lineno) for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign))] if is_class else None,
            "imports": self.imports,
        }

    def rows(self) -> Iterator[dict]:
        for node in self.tree.body:
            if isinstance(node, FUNCTIONS):
                yield self.row(node, "function", f"{self.path} :: {node.name}", None, None)
            elif isinstance(node, ast.ClassDef):
                methods = [x for x in node.body if isinstance(x, FUNCTIONS)]
                context = next((self.whole(m) for m in methods if m.name == "__init__"), None)
                yield self.row(node, "class", f"{self.path}::{node.name}", None, context)
                for m in methods:
                    yield self.row(m, "method", f"{self.path} ::{node.name}.{m.name}", node.name, context)


def chunks(path: str, source: str | None) -> tuple[list[dict], dict | None]:
    """Chunks of a file, or no chunks and what failed."""
    try:
        return list(Chunker(path, source or "", ast.parse(source or "")).rows()), None
    except FAILURES as e:
        return [], failure(e)


# --- signatures -----------------------------------------------------------------------------------------------------


def signatures(source: str | None) -> dict[str, str]:
    """Arguments by qualified name (Class.method); empty where the source doesn't parse. Later definitions win."""
    tree, _ = parse(source)
    return {name: unparsed(node.args) for name, node in named(tree)} if tree is not None else {}


def named(tree: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    """Functions in breadth-first order with their qualified names."""
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    for node, prefix in todo:
        if isinstance(node, FUNCTIONS):
            yield prefix[:-1], node
        for child in ast.iter_child_nodes(node):
            scope = isinstance(child, (*FUNCTIONS, ast.ClassDef))
            todo.append((child, f"{prefix}{child.name}." if scope else prefix))


# --- guardrail ------------------------------------------------------------------------------------------------------

# Fixed values.
DANGEROUS_CALLS = ("eval", "exec", "os.system", "pickle.loads", "__import__")
ENVIRONMENT = ("os.environ", "os.getenv")
OUTGOING = ("requests.get", "requests.post", "urllib.request.urlopen", "socket.socket", "print", "logging.info", "logging.warning", "logging.error", "logging.debug")
ENVIRONMENT_WINDOW = 10


def guardrail_facts(source: str | None) -> dict:
    """parse_ok, and the first finding of each category by the tree (None where there is none)."""
    tree, _ = parse(source)
    found = {"parse_ok": tree is not None, "code_execution": None, "credentials": None}
    reads, sends = [], []
    for node in ast.walk(tree) if tree is not None else ():
        if isinstance(node, ast.Attribute) and dotted(node) in ENVIRONMENT:
            reads.append(node.lineno)
        if not isinstance(node, ast.Call) or (name := dotted(node.func)) is None:
            continue
        shell = name.startswith("subprocess.") and any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        if found["code_execution"] is None and (name in DANGEROUS_CALLS or shell):
            found["code_execution"] = f"call of {name}{' with shell=True' if shell else ''} at line {node.lineno}"
        if name in ENVIRONMENT:
            reads.append(node.lineno)
        if name in OUTGOING:
            sends.append(node.lineno)
    near = min(((a, b) for a in reads for b in sends if a <= b <= a + ENVIRONMENT_WINDOW), default=None)
    if near:
        found["credentials"] = f"environment read at line {near[0]}, sent at line {near[1]}"
    return found


# --- error handling -------------------------------------------------------------------------------------------------

# Fixed values.
SEVERITY = {"critical": 3, "error": 2, "exception": 2, "warning": 1, "debug": 0, "info": 0}
LOGGER_NAMES = ("log", "logger", "logging")
RISKY_METHODS = {
    "get", "post", "put", "delete", "patch", "request", "urlopen", "fetch",
    "open", "read", "write",
    "run", "call", "check_call", "check_output", "popen",
    "loads", "load",
}
RISKY_OWNERS = ("requests", "httpx", "urllib", "subprocess", "json", "yaml", "client", "session", "conn")


def own_nodes(roots: list[ast.AST], stop: tuple[type, ...]) -> Iterator[ast.AST]:
    """The roots and nodes below them in source order, not entering nodes of the stop types (these are given, their insides not)."""
    todo = roots[::-1]
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, stop):
            todo += list(ast.iter_child_nodes(node))[::-1]


def raises_in_body(block: ast.Try) -> bool:
    return any(isinstance(n, ast.Raise) for n in own_nodes(block.body, (ast.Try, *SCOPES)))


def called(node: ast.Call) -> dict | None:
    """(owner, name) of a call: owner is the last part of what the name is taken from, null for a plain name."""
    if isinstance(node.func, ast.Name):
        return {"owner": None, "name": node.func.id}
    if not isinstance(node.func, ast.Attribute):
        return None
    value = node.func.value
    return {"owner": value.id if isinstance(value, ast.Name) else value.attr if isinstance(value, ast.Attribute) else "", "name": node.func.attr}


def caught(handler: ast.ExceptHandler) -> list[str]:
    """Distinct names that a handler catches, as written and sorted; * for a bare one."""
    if handler.type is None:
        return ["*"]
    each = handler.type.elts if isinstance(handler.type, ast.Tuple) else [handler.type]
    return sorted({(dotted(e) or "<unresolved>") if isinstance(e, (ast.Name, ast.Attribute)) else "<unresolved>" for e in each})


def calls_of(nodes: list[ast.AST]) -> list[dict]:
    return [c for c in (called(n) for n in nodes if isinstance(n, ast.Call)) if c]


def handler_facts(handler: ast.ExceptHandler) -> dict:
    inside = list(ast.walk(handler))
    return {"line": handler.lineno, "caught": caught(handler), "raises": any(isinstance(n, ast.Raise) for n in inside), "calls": calls_of(inside)}


def function_facts(source: str | None) -> tuple[list[dict], str | None]:
    """Of each function, in breadth-first order: its names and lines, what it calls, and its try blocks (not those of
    functions inside) with their handlers; or none and the parse error."""
    tree, error = parse(source)
    if tree is None:
        return [], error
    out = []
    for place, (qualname, node) in enumerate(named(tree)):
        inside = list(ast.walk(node))
        calls = {(c["owner"], c["name"]) for c in calls_of(inside)}
        has_try = any(isinstance(n, ast.Try) for n in inside)
        tries = [n for n in own_nodes(list(ast.iter_child_nodes(node)), SCOPES) if isinstance(n, ast.Try)] if has_try else []
        out.append({
            "place": place, "name": node.name, "qualname": qualname, "line": node.lineno, "end_line": node.end_lineno, "has_try": has_try, "calls": [{"owner": o, "name": n} for o, n in sorted(calls, key=repr)],
            "tries": [{"line": t.lineno, "raises": raises_in_body(t), "handlers": [handler_facts(h) for h in t.handlers]} for t in tries],
        })
    return out, None


def exception_ancestors() -> dict[str, list[str]]:
    """Builtin exceptions by name, each with the names of all classes that it is one of (itself and aliases among them)."""
    known = {n: c for n, c in vars(builtins).items() if isinstance(c, type) and issubclass(c, BaseException)}
    return {n: sorted(m for m, d in known.items() if issubclass(c, d)) for n, c in sorted(known.items())}
