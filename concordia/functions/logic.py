"""Rule logic as column expressions (C2, and the program folded by L4).

A rule whose literals were replaced by ``{}`` holds only marks of logic: ``->``, ``^`` and
``&&`` mean AND, ``||`` means OR, ``!(`` negates up to the first ``)`` after it, and a chain
without parentheses groups from the right, ``a op1 (b op2 c)``. Three column steps:

1. ``mark_text``: one character per mark, spans of negation as ``[ ]``. A ``)`` ends the
   negations that wait for one, in order, so counting them is enough.
2. ``program``: since chains group from the right, the marks are read from the last to the
   first. A frame per open group holds the program of what was read of it and the operator
   that waits for a left operand; a left operand completes ``left rest op``.
3. ``clauses`` runs the program on sets of clauses, ``similarity.fold_similarity`` on scores.

Codes of a program (postfix): ``k >= 0`` literal k, ``AND``, ``OR``, ``NOT``, and
``NEGATED - k`` for a literal negated by itself.

Defined cases: null text gives null; operands side by side without an operator mean the
first of them; an operator without an operand, an empty group and an unclosed group have no
program. Fragments between ANDs that hold letters or digits are dropped, other characters
ignored. No limit on length or clauses: the clauses of one rule are as many as its normal
form has, and are held by one row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AND, OR, NOT, NEGATED = -1, -2, -3, -1000

_FRAME = "struct<square:boolean,rest:array<int>,op:int,left:array<int>>"
_STATE = f"struct<frames:array<{_FRAME}>,slot:int,bad:boolean>"
_CLAUSES = "array<array<int>>"


def mark_text(templated: Column) -> Column:
    """One character per mark of logic: ``^ | ( ) [ ]`` and ``{}`` for a literal."""
    plain = F.regexp_replace(F.replace(templated, F.lit(" "), F.lit("")), r"!\(", "[")
    marks = F.regexp_extract_all(plain, F.lit(r"(?s)[^)\[]+|[)\[]"), 0)
    zero = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        ends = (m == ")") & (s["open"] > 0)
        return F.struct((s["open"] + F.when(m == "[", 1).when(ends, -1).otherwise(0)).alias("open"),
                        F.concat(s["out"], F.array(F.when(ends, "]").otherwise(m))).alias("out"))

    closed = F.aggregate(marks, zero, step, lambda s: F.array_join(s["out"], ""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(closed, r"\(\{\}\)", "{}"), "->|&&", "^"), r"\|\|", "|")
    return F.array_join(F.filter(F.split(text, r"\^"), lambda part: ~part.rlike(r"[\p{L}\p{N}]")), "^")


def logic_text(marks: Column) -> Column:
    """The marks with their literals numbered: ``{0}^{1}``."""
    parts = F.split(marks, r"\{\}")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(F.lit("{"), (i - 1).cast("string"), F.lit("}"), p))), "")


def program(marks: Column) -> Column:
    """Postfix program of the marks, null where they cannot be read."""
    signs = F.regexp_extract_all(marks, F.lit(r"\{\}|[\[\]()^|]"), 0)
    none = F.array().cast("array<int>")

    zero = F.lit(0)

    def frame(square, rest, op, left):
        return F.struct(square.alias("square"), rest.alias("rest"), op.alias("op"), left.alias("left")).cast(_FRAME)

    def state(frames, slot, bad=F.lit(False)):
        return F.struct(frames.alias("frames"), slot.alias("slot"), bad.alias("bad")).cast(_STATE)

    def top_and_below(frames):
        return F.element_at(frames, -1), F.slice(frames, 1, F.size(frames) - 1)

    def whole(f):
        return (F.size(f["rest"]) > 0) & (f["op"] == 0)

    def value(f):  # ``left`` is the first of operands side by side, empty without such
        return F.when(F.size(f["left"]) > 0, f["left"]).otherwise(f["rest"])

    def with_operand(frames, operand):
        top, below = top_and_below(frames)
        joined = F.concat(operand, top["rest"], F.array(top["op"]))
        return F.concat(below, F.array(
            F.when(F.size(top["rest"]) == 0, frame(top["square"], operand, zero, none))
            .when(top["op"] == 0, frame(top["square"], top["rest"], zero, operand))
            .otherwise(frame(top["square"], joined, zero, F.when(F.size(top["left"]) > 0, operand).otherwise(none)))))

    def step(s, t):
        frames, slot = s["frames"], s["slot"]
        top, below = top_and_below(frames)
        inner = value(top)
        negated = F.when((F.size(inner) == 1) & (F.get(inner, zero) >= 0), F.transform(inner, lambda c: F.lit(NEGATED) - c)).otherwise(
            F.concat(inner, F.array(F.lit(NOT))))
        code = F.when(t == "^", F.lit(AND)).otherwise(F.lit(OR))
        pairs = t.isin("(", "[") & (F.size(frames) > 1) & (top["square"] == (t == "["))
        return (F.when(s["bad"], s)
                .when(t == "{}", state(with_operand(frames, F.array(slot - 1)), slot - 1))
                .when(t.isin(")", "]"), state(F.concat(frames, F.array(frame(t == "]", none, zero, none))), slot))
                .when(pairs & whole(top), state(with_operand(below, F.when(t == "[", negated).otherwise(inner)), slot))
                .when(t.isin("^", "|") & whole(top),
                      state(F.concat(below, F.array(frame(top["square"], top["rest"], code, top["left"]))), slot))
                .otherwise(state(frames, slot, F.lit(True))))

    def finish(s):
        last = F.element_at(s["frames"], -1)
        return F.when(~s["bad"] & (F.size(s["frames"]) == 1) & whole(last), value(last))

    start = state(F.array(frame(F.lit(False), none, zero, none)), F.size(F.filter(signs, lambda t: t == "{}")))
    return F.aggregate(F.reverse(signs), start, step, finish)


def readable_as_score(marks: Column, prog: Column) -> Column:
    """The fold of scores reads a negation of one literal or of a negation, not of a chain,
    and no characters but marks."""
    chain_negated = F.exists(F.zip_with(prog, F.slice(prog, 2, F.greatest(F.size(prog), F.lit(1))),
                                        lambda a, b: a.isin(AND, OR) & (F.coalesce(b, F.lit(0)) == NOT)), lambda x: x)
    return ~chain_negated & ~F.regexp_replace(marks, r"\{\}", "").rlike(r"[^\[\]()^|]")


def clauses(prog: Column) -> Column:
    """The program's disjunctive normal form: clauses of signed literals (``k + 1``, negated
    ``-(k + 1)``), literals in order, without contradictions and repeated clauses."""
    no_literal = F.array().cast("array<int>")

    def conjoin(x, y):
        return F.array_sort(F.array_distinct(F.concat(x, y)), lambda l, r: F.abs(l) - F.abs(r))

    def distinct(found):  # repeated arrays are found by their text, in linear time
        possible = F.filter(found, lambda c: ~F.exists(c, lambda x: F.array_contains(c, -x)))
        texts = F.array_distinct(F.transform(possible, lambda c: F.array_join(c.cast("array<string>"), ",")))
        return F.transform(texts, lambda t: F.split(t, ",").cast("array<int>"))

    def both(a, b):
        return distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: conjoin(x, y)))))

    def negation(a):
        one_each = lambda acc, clause: F.when(F.size(acc) == 0, acc).otherwise(
            both(acc, F.transform(clause, lambda x: F.array(-x))))
        first = F.transform(F.get(a, F.lit(0)), lambda x: F.array(-x))
        return F.aggregate(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), first, one_each)

    def step(stack, code):
        last, previous = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        result = (F.when(code >= 0, F.array(F.array(code + 1)))
                  .when(code <= NEGATED, F.array(F.array(code - F.lit(NEGATED) - 1)))
                  .when(code == AND, both(previous, last))
                  .when(code == OR, distinct(F.concat(previous, last)))
                  .otherwise(negation(last)))
        operands = F.when((code >= 0) | (code <= NEGATED), 0).when(code == NOT, 1).otherwise(2)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - operands), F.array(result))

    return F.aggregate(prog, F.array().cast(f"array<{_CLAUSES}>"), step, lambda st: F.get(st, F.lit(0)))
