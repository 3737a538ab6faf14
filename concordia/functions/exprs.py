"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.vocab import OPERATOR_VECTORS

# Literal ``name op value`` inside rule and path texts.  ``[A-Za-z0-9_]`` is spelled out
# because ``\w`` differs between Python (Unicode), Java and RE2 (ASCII).
W = "[A-Za-z0-9_]"
OPS_RE = "(=|!=|<=|>=|<|>)"
LITERAL_RE = ("(" + W + r"+)\s*" + OPS_RE
              + r"\s*(?:'([^']*)'|(-?[0-9]+(?:\.[0-9]+)?|" + W + "+))")
# When a rule assigns a call result (``x = f(...)``) the value may itself be a call.
CALL_DETECT_RE = r"\b" + W + r"+\s*=\s*(?:" + W + r"+\.)?" + W + r"+\s*\("
CALL_LITERAL_RE = ("(" + W + r"+)\s*" + OPS_RE + r"\s*('([^']*)'|-?[0-9]+(?:\.[0-9]+)?|"
                   + W + r"+\([^()]*?(?:\([^()]*?\)[^()]*?)*\)|" + W + "+)")
# What every text that casts to a double begins with (``nan`` and ``inf`` are numbers).
MAYBE_NUMBER_RE = r"^[\x00-\x20]*([0-9.+\-]|[nN][aA][nN]|[iI][nN][fF])"
NUMBER_RE = r"^-?[0-9]+(\.[0-9]+)?$"


def is_number(c: Column) -> Column:
    """Text that reads as a number (``float(text)`` would succeed). Names, the common case, are told
    by their first sign: a cast that fails costs an exception a row."""
    return F.when(c.rlike(MAYBE_NUMBER_RE), c.try_cast("double").isNotNull()).otherwise(F.lit(False))


def op_cosine_table() -> dict[tuple[str, str], float]:
    """Cosine of every operator pair, computed exactly as dot / (|a| * |b|) in doubles."""
    table = {}
    for a, va in OPERATOR_VECTORS.items():
        for b, vb in OPERATOR_VECTORS.items():
            dot = sum(x * y for x, y in zip(va, vb))
            na = math.sqrt(sum(x * x for x in va))
            nb = math.sqrt(sum(x * x for x in vb))
            table[(a, b)] = 0.0 if na == 0 or nb == 0 else dot / (na * nb)
    return table


def op_cosine(op1: Column, op2: Column) -> Column:
    """Map lookup (no join) of the operator-pair cosine."""
    entries = []
    for (a, b), v in op_cosine_table().items():
        entries += [F.lit(a + " " + b), F.lit(float(v))]
    return F.element_at(F.create_map(*entries), F.concat_ws(" ", op1, op2))


def norm_levenshtein(a: Column, b: Column) -> Column:
    """1 - lev(a, b) / max(len); two empty strings score 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))


_TWO_62 = float(2 ** 62)


def py_round2(v: Column) -> Column:
    """Round a double in [0, 2) to 2 decimals exactly like Python's ``round(v, 2)``:
    half-even on the exact binary value (not on its shortest decimal spelling).

    Fast path in doubles: unless v * 100 lies within 1e-9 of a midpoint k + 0.5, plain
    rounding of v * 100 is already exact.  Near a midpoint the exact test runs: v * 2**62
    is an exact integer for v >= 2**-10, compared with the midpoint in exact decimals.
    Below 0.001 the result is 0."""
    r = v * F.lit(100.0)
    k = F.floor(r)
    frac = r - k
    scaled = (v * F.lit(_TWO_62)).cast("long").cast("decimal(38,0)") * F.lit(100).cast("decimal(38,0)")
    midpoint = (k * 2 + 1).cast("decimal(38,0)") * F.lit(2 ** 61).cast("decimal(38,0)")
    exact_up = F.when(scaled > midpoint, True).when(scaled < midpoint, False).otherwise(k % 2 == 1)
    up = F.when(F.abs(frac - F.lit(0.5)) > F.lit(1e-9), frac > F.lit(0.5)).otherwise(exact_up)
    rounded = (k + F.when(up, 1).otherwise(0)).cast("double") / F.lit(100.0)
    return F.when(v.isNull(), None).when(v < 0.001, F.lit(0.0)).otherwise(rounded)


def hundredths(v: Column) -> Column:
    """Integer score in hundredths (scores are compared as integers across engines)."""
    return F.round(v * 100).cast("int")
