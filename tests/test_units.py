"""Units from sources against the language's own parser, on in-line files."""
import ast

import pytest

from concordia.functions import scan
from concordia.functions.scan import exclusive_scan
from concordia.operators.units import code_structure, extract_units, signature_params, unit_stats
from concordia.sources.text import scan_lines
from pyspark.sql import functions as F

FLAG = "Parameters"
SOURCES = {
    "multi.py": '''import os
class Wide(
    Base,  # a comment with ( and """ in it
    metaclass=Meta("x:", [1, (2, {3: 4})]),
):
    """Wide one.

    class of its own kind:
    def prose(not, code):

    Parameters
    ----------
    a : int
        First (unclosed.
    """

    def __init__(
        self,
        a, b=g((1, (2, (3, q))), b2), *,
        c: "Dict[str, int]" = {"k": (1, 2)},  # d=4,
        e=lambda x, y: (x, y),
        **kw
    ):
        self.a = a

    @deco("""
class Fake:
    def fake(self): pass
""")
    def shown(self, x=")", y='(',
              z=1):
        r\'\'\'Raw "quoted" doc.

        Parameters
        -----
        x : str
        \'\'\'
        return x

    def bare(self): return 1

    async def later(self):
        def inner(x, /, y):
            return x
        return inner
''',
    "strings.py": '''TEXT = """
def not_a_unit(a):
    \\"""
    Parameters
    -----
"""
OTHER = "\\"" + \'\'\'# "
class No:\'\'\'
def single(a): "Doc with Parameters"
def oneline(a, b=[1,
    2]): """One. Parameters
-----"""
if True:
    def guarded(p, *, q={"a": {"b": [")"]}}) -> "Dict[str, (int)]":
        "short Parameters"
        x = \\
            1
        def nested(r): pass

def long_default(a = 1 + \\
        2, b = "," , c = f(",", (")")), d = not_a, e: Callable[[int], str] = None):
    # a comment first

    """Documented.
    Parameters
    -----
        a : int
      b
    """
class Empty: pass
class WithDoc:

    """Doc
    Parameters
    -----"""; x = 1
    class Inner:
        def m(self, a): ...
def after(a): pass
''',
    "plain.py": "x = 1\n\n\n" + "\n".join(f"def f{i}(a{i}, b=({i}, {i})):\n    return 1" for i in range(150)) + "\n",
}


def truth(path, content):
    """Rows of E1 and E3 and the counters by the parser."""
    flag = FLAG + "\n-----"
    units, params, stats = set(), set(), [0] * 6
    tree = ast.parse(content)
    for node in ast.walk(tree):
        for child in ast.iter_child_nodes(node):
            child.parent = node
    for node in ast.walk(tree):
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef)):
            continue
        doc = ast.get_docstring(node) or ""
        has = flag in doc
        member = isinstance(node, ast.FunctionDef) and isinstance(node.parent, ast.ClassDef)
        kind = "class" if isinstance(node, ast.ClassDef) else "member" if member else "function"
        if kind != "member" or node.name != "__init__":
            at = {"class": 0, "member": 2, "function": 4}[kind]
            stats[at] += 1
            stats[at + 1] += has
            if has or kind == "member":
                parent = node.parent.name if isinstance(node.parent, ast.ClassDef) else None
                units.add((path, kind, node.name, parent, has, doc if has else None))
        if kind == "function" or member and node.name == "__init__":
            names = [a.arg for a in node.args.posonlyargs + node.args.args + node.args.kwonlyargs if a.arg != "self"]
            params |= {(path, node.parent.name if member else node.name, i, n) for i, n in enumerate(names)}
    return units, params, stats


@pytest.fixture(params=[128, 4])
def structure(spark, monkeypatch, request):
    monkeypatch.setattr(scan, "CHUNK", request.param)
    monkeypatch.setattr(scan.exclusive_scan, "__defaults__", tuple(request.param if d == 128 else d for d in scan.exclusive_scan.__defaults__))
    src = spark.createDataFrame([("p", k, v) for k, v in SOURCES.items()], "project string, path string, content string")
    style = spark.createDataFrame([("p", FLAG)], "project string, flag string")
    return code_structure(scan_lines(src, ["project", "path"], "content"), style).cache()


def test_against_the_parser(structure):
    want = [truth(k, v) for k, v in SOURCES.items()]
    units = {(r.path, r.kind, r.name, r.parent, r.with_doc, r.docstring) for r in extract_units(structure).collect()}
    assert units == set().union(*(u for u, _, _ in want))
    params = {(r.path, r.unit, r.pos, r.name) for r in signature_params(structure).collect()}
    assert params == set().union(*(p for _, p, _ in want))
    got = [tuple(r)[1:] for r in unit_stats(structure).collect()]
    assert got == [tuple(map(sum, zip(*(s for _, _, s in want))))]


def test_scan(spark):
    df = spark.createDataFrame([(k, i, i * (k or 7), "x") for k in (1, 2, None) for i in range(1, 40 * (k or 3))], "k int, i int, v long, more string")
    got = exclusive_scan(df, ["k"], "i", "v", F.lit(0).cast("long"), lambda a, b: a + b, chunk=3)
    assert got.columns == ["k", "i", "v", "more", "before"]
    rows = got.collect()
    assert len(rows) == df.count() and all(r.before == (r.k or 7) * r.i * (r.i - 1) // 2 for r in rows)
    assert exclusive_scan(df.limit(0), ["k"], "i", "v", F.lit(0).cast("long"), lambda a, b: a + b).count() == 0
