"""Docstring section parsing: behaviours of the line state machine, on in-line docstrings."""
import random

import pytest

from concordia.functions import scan, vocab
from concordia.operators.extract import parse_sections
from concordia.sources.text import scan_lines


def parse(spark, docs):
    df = spark.createDataFrame([(i, "p", flag, text) for i, (flag, text) in enumerate(docs)],
                               "unit long, project string, flag string, text string")
    rows = parse_sections(scan_lines(df, ["unit", "project", "flag"])).collect()
    out = {}
    for r in rows:
        out.setdefault(r["unit"], []).append((r["section"], r["name"], r["descr"]))
    return {k: sorted(v) for k, v in out.items()}


def test_numpy_adjacent_headers_alternate(spark):
    doc = "Title\nParameters\nAttributes\na : int\n    first\nReturns\n-------\nr : x"
    # 'Attributes' is swallowed as the line after 'Parameters'; 'r' sits in Returns
    assert parse(spark, [("Parameters", doc)])[0] == [("param", "a", "int first")]


def test_numpy_orphan_colon_line_joins_next_key(spark):
    doc = ("Parameters\n----------\na : int\n    x\nAttributes\n----------\n"
           "    note: orphan\nb : str")
    assert parse(spark, [("Parameters", doc)])[0] == [("attr", "b", "note: orphan str"), ("param", "a", "int x")]


def test_google_raises_and_note_swallow_a_line(spark):
    doc = "Args:\n    x: int\n        the x\nRaises:\n    ValueError: bad\nNote:\n    y: not a param"
    assert parse(spark, [("Args:", doc)])[0] == [("param", "x", "int the x")]


def test_unknown_dialect_yields_nothing(spark):
    assert parse(spark, [("Args", "Args:\n    x: int")]) == {}


def plain(flag, text):
    """The line state machine as a loop."""
    out, section, swallow, first, key, waiting = [], None, False, None, None, []
    heads = vocab.NUMPY_HEADERS if flag in ("Parameters", "Parameters:") else vocab.GOOGLE_HEADERS if flag == "Args:" else {}
    for line in text.split("\n"):
        if swallow:
            swallow = False
            continue
        hit = next((h for h in heads if line.startswith(h) and not (heads is vocab.NUMPY_HEADERS and h == "return" and ":" in line)), None)
        if hit:
            section, key = heads[hit], None
            swallow = heads is vocab.NUMPY_HEADERS or any(line.startswith(h) for h in vocab.GOOGLE_SKIP_NEXT)
        elif section in ("param", "attr"):
            if ":" in line:
                indent = len(line) - len(line.lstrip(" "))
                first = indent if first is None else first
                if indent == first:
                    name, rest = line.split(":", 1)
                    key = [section, name.strip(), [*waiting, rest.strip()]]
                    out.append(key)
                    waiting = []
                elif key:
                    key[2].append(line.strip())
                else:
                    waiting.append(line.strip())
            elif key:
                key[2].append(line.strip())
    return sorted((s, n, " ".join(d).strip()) for s, n, d in out)


@pytest.mark.parametrize("chunk", [3, 128])
def test_against_a_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan.exclusive_scan, "__defaults__", tuple(chunk if d == 128 else d for d in scan.exclusive_scan.__defaults__))
    r = random.Random(5)
    heads = [*vocab.NUMPY_HEADERS, *vocab.GOOGLE_HEADERS]
    line = lambda: r.choice([r.choice(heads), r.choice(heads) + " x", "----", "", "a : int", "b: x", "  c: y", "    note: z", "  plain", "    deep"])
    docs = [(r.choice(["Parameters", "Parameters:", "Args:", "Other"]), "\n".join(line() for _ in range(r.randrange(1, 40)))) for _ in range(60)]
    got = parse(spark, docs)
    for i, (flag, text) in enumerate(docs):
        assert got.get(i, []) == plain(flag, text), (flag, text)
