"""Names that Python source binds, uses and imports, as flat facts. Plain Python without Spark: executors call it per row."""

from __future__ import annotations

import ast

from tracewright.functions.pyast import FUNCTIONS, parse

COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class Names:
    """Facts of one module. Scopes are numbered, the module is 0; each has the chain of scopes that a name in it is looked
    up in, its own first (class scopes are seen from within only)."""

    def __init__(self, tree: ast.Module):
        self.scopes = [{"scope": 0, "kind": "module", "chain": [0]}]
        self.bindings: list[dict] = []
        self.uses: set[tuple[int, str]] = set()
        self.imports: list[dict] = []
        self.elsewhere: dict[tuple[int, str], int] = {}  # global and nonlocal names: the scope that they belong to
        self.todo: list[tuple[ast.AST, int]] = [(n, 0) for n in reversed(tree.body)]
        while self.todo:
            self.visit(*self.todo.pop())

    def enter(self, kind: str, outer: int) -> int:
        above = self.scopes[outer]["chain"]
        self.scopes.append({"scope": len(self.scopes), "kind": kind, "chain": [len(self.scopes), *(above if self.scopes[outer]["kind"] != "class" else above[1:])]})
        return len(self.scopes) - 1

    def later(self, nodes, scope: int) -> None:
        self.todo += [(n, scope) for n in reversed(list(nodes)) if n is not None]

    def bind(self, scope: int, name: str, node: ast.AST, what: str = "other", label: str | None = None) -> None:
        home = self.elsewhere.get((scope, name), scope)
        self.bindings.append({"scope": home, "name": name, "line": node.lineno, "col": node.col_offset + 1, "what": what if home == scope else "other", "label": label or name})

    def function(self, node, scope: int) -> None:
        a = node.args
        self.later([*getattr(node, "decorator_list", ()), *a.defaults, *a.kw_defaults], scope)
        inner = self.enter("function", scope)
        for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg):
            if arg is not None:
                self.bind(inner, arg.arg, arg)
                self.annotation(arg.annotation, scope)
        self.annotation(getattr(node, "returns", None), scope)
        self.later(node.body if isinstance(node.body, list) else [node.body], inner)

    def annotation(self, node: ast.AST | None, scope: int) -> None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            quoted, _ = parse(node.value)
            node = quoted.body[0].value if quoted and len(quoted.body) == 1 and isinstance(quoted.body[0], ast.Expr) else None
        self.later([node], scope)

    def target(self, node: ast.AST, scope: int, what: str) -> None:
        if isinstance(node, ast.Name):
            self.bind(scope, node.id, node, what)
        else:  # names in tuples are bound, those of attributes and subscripts used
            self.later([node], scope)

    def exported(self, value: ast.AST | None) -> None:
        self.uses |= {(0, n.value) for n in ast.walk(value) if isinstance(n, ast.Constant) and isinstance(n.value, str)} if value is not None else set()

    def visit(self, node: ast.AST, scope: int) -> None:
        if isinstance(node, FUNCTIONS):
            self.bind(scope, node.name, node)
            self.function(node, scope)
        elif isinstance(node, ast.Lambda):
            self.function(node, scope)
        elif isinstance(node, ast.ClassDef):
            self.bind(scope, node.name, node)
            self.later([*node.decorator_list, *node.bases, *(k.value for k in node.keywords)], scope)
            self.later(node.body, self.enter("class", scope))
        elif isinstance(node, COMPREHENSIONS):
            first, inner = node.generators[0], self.enter("comprehension", scope)
            self.later([first.iter], scope)
            self.later([first.target, *first.ifs, *node.generators[1:], *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])], inner)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            self.imported(node, scope)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            chain = self.scopes[scope]["chain"]
            home = 0 if isinstance(node, ast.Global) or len(chain) < 2 else next((s for s in chain[1:] if any(b["scope"] == s and b["name"] in node.names for b in self.bindings)), chain[1])
            self.elsewhere |= {(scope, name): home for name in node.names}
        elif isinstance(node, ast.Assign):
            self.later([node.value], scope)
            for t in node.targets:
                self.target(t, scope, "assign")
                if isinstance(t, ast.Name) and t.id == "__all__":
                    self.exported(node.value)
        elif isinstance(node, ast.AnnAssign):
            self.annotation(node.annotation, scope)
            self.later([node.value], scope)
            self.target(node.target, scope, "assign" if node.value is not None else "other")
        elif isinstance(node, ast.AugAssign):
            if isinstance(node.target, ast.Name):
                self.uses.add((scope, node.target.id))
                if node.target.id == "__all__":
                    self.exported(node.value)
            self.target(node.target, scope, "other")
            self.later([node.value], scope)
        elif isinstance(node, ast.NamedExpr):
            home = next(s for s in self.scopes[scope]["chain"] if self.scopes[s]["kind"] != "comprehension")
            self.target(node.target, home, "other")
            self.later([node.value], scope)
        elif isinstance(node, ast.withitem):
            self.later([node.context_expr], scope)
            if node.optional_vars is not None:
                self.target(node.optional_vars, scope, "assign")
        elif isinstance(node, ast.ExceptHandler):
            if node.name:
                self.bind(scope, node.name, node, "except")
            self.later([node.type, *node.body], scope)
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                self.bind(scope, node.id, node)
            else:
                self.uses.add((scope, node.id))
        else:
            name = getattr(node, "name", None) if isinstance(node, (ast.MatchAs, ast.MatchStar)) else getattr(node, "rest", None)
            if isinstance(name, str):
                self.bind(scope, name, node)
            self.later(ast.iter_child_nodes(node), scope)

    def imported(self, node: ast.Import | ast.ImportFrom, scope: int) -> None:
        source = "" if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
        for a in node.names:
            full = a.name if isinstance(node, ast.Import) else f"{source}{'' if source.endswith('.') else '.'}{a.name}"
            self.imports.append({"scope": scope, "line": node.lineno, "level": getattr(node, "level", 0), "module": a.name if isinstance(node, ast.Import) else node.module or "", "name": None if isinstance(node, ast.Import) else a.name, "bound": a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name)})
            if a.name != "*":
                what = "other" if source == "__future__" else "import"
                self.bind(scope, a.asname or a.name.split(".")[0], node, what, full if a.asname in (None, a.name) else f"{full} as {a.asname}")


def name_facts(source: str | None) -> dict:
    """scopes, bindings, uses and imports of a source, or none and the parse error."""
    tree, error = parse(source)
    if tree is None:
        return {"scopes": [], "bindings": [], "uses": [], "imports": [], "error": error}
    names = Names(tree)
    return {"scopes": names.scopes, "bindings": names.bindings, "uses": [{"scope": s, "name": n} for s, n in sorted(names.uses)], "imports": names.imports, "error": None}
