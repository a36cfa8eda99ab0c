"""Unused names and unresolved imports, by hand."""


from tracewright.operators import names, patches

CASES = {
    "imports": ("import os\nimport sys as s\nimport a.b\nfrom m import x, y as z\nfrom . import r\nfrom .p import q\nprint(os, z)\n", ["'sys as s'", "'a.b'", "'m.x'", "'.r'", "'.p.q'"]),
    "all": ("from m import x, y\nimport t\n__all__ = ['x']\n__all__ += ['t']\n", ["'m.y'"]),
    "future": ("from __future__ import annotations\nfrom m import *\n", []),
    "closure": ("import a\ndef f(p):\n    b = 1\n    c = 2\n    def g():\n        return a, b\n    return g\n", ["'c'"]),
    "class": ("class A:\n    import a\n    x = 1\n    def m(self):\n        return a\n", ["'a'"]),
    "shadowed": ("import a\ndef f():\n    import a\n    return a\n", ["'a'"]),
    "rebound": ("def f():\n    x = 1\n    x = 2\n    return x\n", []),
    "only assigned twice": ("def f():\n    x = 1\n    x = 2\n", ["'x'", "'x'"]),
    "tuples, loops, walrus, _": ("def f(v):\n    a, b = v\n    for c in v:\n        pass\n    (d := 1)\n    _ = 2\n    e: int = 3\n    g: int\n", ["'e'"]),
    "augmented": ("def f():\n    n = 0\n    n += 1\n", []),
    "with and except": ("def f():\n    with open('x') as h:\n        pass\n    try:\n        pass\n    except E as e:\n        pass\n    except F as g:\n        print(g)\n", ["'h'", "'e'"]),
    "locals": ("def f():\n    x = 1\n    return locals()\n", []),
    "global": ("import a\ndef f():\n    global a, t\n    a = 1\n    t = 2\n", ["'a'"]),
    "nonlocal": ("def f():\n    x = 0\n    def g():\n        nonlocal x\n        x = 1\n    return g\n", ["'x'"]),
    "comprehension": ("import a, b\ndef f(v):\n    x = 1\n    return [a for y in v if x], {b: y for y in v}\n", []),
    "annotations": ("import a, b, c\ndef f(x: a, y: 'b.T') -> 'c':\n    return x\n", []),
    "decorators and defaults": ("import a, b, c\n@a.d\ndef f(x=b):\n    pass\nclass K(c.B):\n    pass\n", []),
    "strings and attributes": ("import a\ndef f(o):\n    o.x = 1\n    o['k'] = 2\n    return f'{a}'\n", []),
    "match": ("import a\ndef f(v):\n    match v:\n        case a.X(y):\n            return 1\n        case [*r]:\n            return 2\n", []),
    "lambda": ("import a\nf = lambda q, r=a: q\n", []),
    "deleted": ("import a\ndel a\n", []),
    "no python": ("def f(:", []),
}


def test_unused_names(spark):
    frame = spark.createDataFrame([(k, "m.py", source) for k, (source, _) in CASES.items()], "patch_id string, file_path string, new_source string")
    got = {k: [] for k in CASES}
    for r in names.unused_names(frame).orderBy("line", "col").collect():
        got[r["patch_id"]].append(f"'{r['message'].split(chr(39))[1]}'")
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_unused_names_of_added_lines(spark):
    source = "import os\nimport re\ndef f():\n    x = 1\n    y = 2\n"
    rows = [("p", "m.py", source, "@@ -1 +2,3 @@"), ("q", "m.py", source, "@@ -1 +3 @@"), ("r", "m.py", None, "@@ +1,9 @@"), ("p", "n.py", "import os", "@@ -1,0 +1 @@")]
    got = {r["patch_id"]: (r["passed"], r["detail"]) for r in patches.no_unused_code(spark.createDataFrame(rows, "patch_id string, file_path string, new_source string, diff_text string")).collect()}
    assert got == {"p": (False, "m.py:2:'re' imported but unused; m.py:4:local variable 'x' is assigned to but never used; n.py:1:'os' imported but unused"), "q": (True, ""), "r": (True, "")}


TREE = {
    "lib/setup.py": "",
    "lib/pkg/__init__.py": "from .a import one\nfrom .a import two as deux\nfrom .stars import *\nfrom . import sub\nimport pkg.sub.deep\n",
    "lib/pkg/a.py": "def one(): pass\ntwo = 2\nfrom .loop import lost\nimport json\n",
    "lib/pkg/loop.py": "from .a import lost\n",
    "lib/pkg/stars.py": "from .more import *\nfrom ..pkg import a as again\n",
    "lib/pkg/more.py": "for hidden in (): pass\nclass K: pass\n",
    "lib/pkg/lazy.py": "def __getattr__(name): return 1\n",
    "lib/pkg/sub/__init__.py": "try:\n    from fast import go\nexcept ImportError:\n    from .slow import go\n",
    "lib/pkg/sub/deep.py": "",
    "lib/pkg/sub/slow.py": "def go(): pass\n",
    "other/tool.py": "x = 1\n",
    "lib/ns/inner.py": "y = 1\n",
}
USERS = {
    "good": ("from pkg import one, deux, K, hidden, sub, again\nfrom pkg.sub import go, deep\nimport pkg.a\nimport pkg.sub.deep as d\nfrom pkg.lazy import anything\nfrom pkg.a import json\nfrom ns.inner import y\nimport ns\n", True, ""),
    "bad": ("from pkg import three\nimport pkg.nowhere\nfrom pkg.a import lost\nfrom pkg.gone import x\nfrom pkg import one\nfrom pkg.gone import *\n", False, "pkg.a.lost; pkg.gone.*; pkg.gone.x; pkg.nowhere; pkg.three"),
    "outside": ("import os, numpy.linalg\nfrom tool import x\n", None, ""),
    "relative": ("from . import inner\nfrom .inner import y, z\nfrom ..pkg import a\nfrom ...far import x\n", False, "...x; ns.inner.z"),
    "broken": ("def f(:", False, None),
    "none": ("x = 1\n", None, ""),
}


def test_imports_resolve(spark):
    rows = []
    for k, (source, _, _) in USERS.items():
        rows += [(k, path, text, False) for path, text in TREE.items()] + [(k, "lib/ns/user.py", source, True)]
    rows += [("tool", "other/tool.py", "x = 1\n", False), ("tool", "other/main.py", "import other.tool\nfrom other.tool import x, y\n", True), ("pyless", "README.md", "import x", True)]
    tree = spark.createDataFrame(rows, "patch_id string, file_path string, source string, changed boolean")
    got = {r["patch_id"]: (r["passed"], r["detail"]) for r in names.imports_resolve(tree).collect()}
    shown = {r["patch_id"]: [] for r in tree.select("patch_id").distinct().collect()}
    for r in names.unresolved_imports(tree).collect():
        shown[r["patch_id"]].append(r["imported"])
    for k, (_, passed, detail) in USERS.items():
        assert got[k][0] is passed, (k, got[k])
        if detail is not None:
            assert "; ".join(sorted(shown[k])) == detail, k
    assert got["broken"][1].startswith("lib/ns/user.py: SyntaxError")
    assert got["tool"] == (False, "other/main.py:2: other.tool.y") and got["pyless"] == (None, "")
