"""Observed paths: text parsing (C5), parenthesis repair (C4), parenthesised parts.

A path is ``cond -> cond -> ... -> terminal``.  The terminal is either a final state
``"(a = 0) ^ (b = 'x')"`` whose literals join the conditions, or an error marker
``'(p)_(q)_ERROR_END'`` naming the parameters that raised.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import logic
from concordia.session import materialize
from concordia.operators.rules import few_templates, literals_from_text, literals_in_row, normalize_constants, templated_expr, typed_literals


def _balanced(text: Column) -> Column:
    """Depth never below zero and zero at the end: an integer fold over the parentheses."""
    marks = F.split(F.regexp_replace(text, "[^()]", ""), "")
    end = F.aggregate(marks, F.lit(0), lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d))
    return end == 0


FLAT_RE = r"^[^()]*+(?:\([^()]*+\)[^()]*+)*+\z"  # no pair inside of a pair, no parenthesis alone
INNER_RE, MASKS, MASK_ROUNDS = r"\(([^()]*)\)", "\x01\x02", 3  # a pair without pairs inside; its mask


def balance_parens(text: Column) -> Column:
    """C4: delete every ``)`` without an opener and every ``(`` without a closer.

    Texts of pairs without pairs inside, side by side, are told by one look and stay. In others
    pairs are masked from the inside, a level a round; what is left then has no partner. Texts
    nested deeper than the rounds, or holding the masks, go to `_balance_by_folds`."""
    masked = F.when(~text.rlike(FLAT_RE), text)
    for _ in range(MASK_ROUNDS):
        masked = F.regexp_replace(masked, INNER_RE, MASKS[0] + "$1" + MASKS[1])
    # a transform of one element, so that the rounds run once for both of their uses
    done = F.transform(F.array(masked), lambda m: F.when(m.rlike(INNER_RE) | text.rlike("[" + MASKS + "]"), _balance_by_folds(text))
                       .otherwise(F.translate(m, MASKS + "()", "()")))
    return F.when(text.rlike(FLAT_RE), text).otherwise(F.get(done, F.lit(0)))


def _balance_by_folds(text: Column) -> Column:
    """The same for any depth: balanced texts are recognised by an integer fold. For the others two
    passes go over the runs between parentheses (no recursion, so no text is too long): the first
    leaves out closers at depth zero, the second, from the end, openers."""
    runs = F.regexp_extract_all(text, F.lit("[^()]+|[()]"), 0)

    def kept(items: Column, opener: str, closer: str) -> Column:
        start = F.struct(F.lit(0).alias("d"), F.array().cast("array<string>").alias("s"))
        add = lambda acc, c, step: F.struct((acc["d"] + step).alias("d"), F.concat(acc["s"], F.array(c)).alias("s"))
        return F.aggregate(items, start, lambda acc, c: F.when(c == opener, add(acc, c, 1)).when(
            c == closer, F.when(acc["d"] > 0, add(acc, c, -1)).otherwise(acc)).otherwise(add(acc, c, 0)), lambda acc: acc["s"])

    both = F.reverse(kept(F.reverse(kept(runs, "(", ")")), ")", "("))
    return F.when(_balanced(text), text).otherwise(F.array_join(both, ""))


def path_parts(paths: DataFrame, keys: Sequence[str] = ("unit", "path_no"), text: str = "text") -> DataFrame:
    """``keys + (line, kind, error_params, conditions)``.

    ``line`` is the stripped, paren-repaired text (value checks look into it);
    ``conditions`` is the blank-free literal text the literals are read from."""
    staged = paths.select(*keys, F.trim(F.col(text)).alias("__t"))
    return (staged.select(*keys, balance_parens(F.col("__t")).alias("line"))
            .withColumn("__nb", F.regexp_replace(F.col("line"), " ", ""))
            .withColumn("__last", F.when(F.col("__nb").contains("->"), F.substring_index("__nb", "->", -1))
                        .otherwise(F.expr("substring(__nb, 2)")))
            .withColumn("__cond", F.when(F.col("__nb").contains("->"),
                                         F.expr("substring(__nb, 1, length(__nb) - length(__last) - 2)"))
                        .otherwise(F.expr("substring(__nb, 1, length(__nb) - 1)")))
            .select(*keys, "line",
                    F.when(F.col("__last").contains("_END"), F.lit("error")).otherwise(F.lit("normal")).alias("kind"),
                    F.when(F.col("__last").contains("_END"), F.expr(
                        "transform(filter(split(trim(BOTH '\\' ' FROM __last), '\\\\)_'), x -> x LIKE '%(%'), "
                        "x -> trim(BOTH '()' FROM x))")).otherwise(F.array().cast("array<string>"))
                    .alias("error_params"),
                    F.when(F.col("__last").contains("_END"), F.col("__cond")).otherwise(
                        F.concat(F.col("__cond"), F.lit("->"),
                                 F.expr("trim(BOTH '\" \\n' FROM __last)"))).alias("conditions")))


# The marks of OR and NOT in a condition text.
LOGIC_RE = r"\|\||!\("


def path_literals(parts: DataFrame, keys: Sequence[str] = ("unit", "path_no"), with_logic: bool = False) -> DataFrame:
    """Typed literals of every path (``pos`` in text order) with ``in_error``: the literal
    names one of the path's error parameters; ``with_logic`` adds ``logical``: the path's
    conditions hold OR or NOT (see ``path_clauses``)."""
    extra = ["error_params", "logical"] if with_logic else ["error_params"]
    parts = parts.withColumn("logical", F.col("conditions").rlike(LOGIC_RE)) if with_logic else parts
    lits = literals_from_text(parts.select(*keys, "conditions", *extra), "conditions", [*keys, *extra], "pos")
    lits = lits.withColumn("in_error", F.array_contains(F.col("error_params"), F.col("var"))).drop("error_params")
    return typed_literals(lits)


def path_clauses(parts: DataFrame, keys: Sequence[str] = ("unit", "path_no"), negate: bool = False) -> DataFrame:
    """The logic of every path whose conditions hold OR or NOT, read like a rule's, as the rows
    ``keys + (pclause, pos, negated)`` of its disjunctive normal form, or of that of its
    negation. A path without them is one clause of all its literals and has no rows here;
    a path that cannot be read has none either (``path_logic_error``)."""
    dnf = _logic(parts, keys, negate).select(*keys, F.posexplode("dnf").alias("pclause", "lits"))
    return dnf.select(*keys, "pclause", F.explode("lits").alias("signed")).select(
        *keys, "pclause", (F.abs("signed") - 1).alias("pos"), (F.col("signed") < 0).alias("negated"))


def path_logic_error(parts: DataFrame, keys: Sequence[str] = ("unit", "path_no")) -> DataFrame:
    """``keys`` of the paths with OR or NOT whose logic cannot be read."""
    return _logic(parts, keys).where("dnf is null").select(*keys)


def _templated(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys + templated`` of the paths with OR or NOT."""
    staged = parts.where(F.col("conditions").rlike(LOGIC_RE)).select(*keys, normalize_constants(F.col("conditions")).alias("norm"))
    return staged.select(*keys, templated_expr(F.col("norm")).alias("templated"))


def _read_templates(templated: DataFrame, *negate: bool) -> DataFrame:
    """``templated`` and its normal form ``dnf``, or that of its negation ``not_dnf``, once for each
    distinct template; a single literal stands for itself."""
    shapes = materialize(templated.select("templated").distinct())  # few; each is read once
    single = F.size(F.split("templated", r"\{\}")) == 2
    prog = F.when(single, F.array(F.lit(0))).otherwise(logic.program(logic.mark_text(F.col("templated"))))
    progs = materialize(shapes.select("templated", prog.alias("prog")))
    return materialize(progs.select("templated", *(
        logic.clauses(F.concat("prog", F.array(F.lit(logic.NOT))) if n else F.col("prog")).alias("not_dnf" if n else "dnf") for n in negate)))


def _logic(parts: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """``keys + dnf`` of the paths with OR or NOT, read once a template."""
    templated = _templated(parts, keys)
    return templated.join(_read_templates(templated, negate).withColumnRenamed("not_dnf", "dnf"), "templated").select(*keys, "dnf")


def path_rows(parts: DataFrame, keys: Sequence[str] = ("unit", "path_no")) -> DataFrame:
    """A row a path (cut): the columns of ``path_parts``, its typed literals (``lits``, in text order),
    ``logical`` and ``alone``: no other path has its keys, so what is asked of the path can be read
    in this row; literals of paths with the same keys belong together."""
    single = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = parts.withColumn("alone", single & known)  # sorted without the literals
    return materialize(literals_in_row(rows, "conditions", "lits").withColumn("logical", F.col("conditions").rlike(LOGIC_RE)))


def with_logic(rows: DataFrame, keys: Sequence[str] = ("unit", "path_no"), negate: Sequence[bool] = (False,)) -> DataFrame:
    """``path_rows`` with the normal forms of those with OR or NOT (``dnf``, ``not_dnf``; null: none or unreadable)."""
    names = ["not_dnf" if n else "dnf" for n in negate]
    marked, nothing = F.coalesce("logical", F.lit(False)), F.lit(None).cast("array<array<int>>")
    plain, found = rows.where(~marked).withColumns(dict.fromkeys(names, nothing)), rows.where(marked)
    if found.isEmpty():
        return plain
    read = _read_templates(_templated(found, keys), *negate)
    staged = found.withColumn("__norm", normalize_constants(F.col("conditions"))).withColumn("templated", templated_expr(F.col("__norm")))
    # paths of one template are many: they are never sorted for this join
    found = staged.join(read.hint("broadcast" if few_templates(read) else "shuffle_hash"), "templated", "left")
    return plain.unionByName(found.select(*plain.columns))


def row_literals(rows: DataFrame, keys: Sequence[str] = ("unit", "path_no")) -> DataFrame:
    """``path_literals`` (with ``logical``) out of ``path_rows``."""
    lits = rows.select(*keys, "logical", "error_params", F.posexplode("lits").alias("pos", "x"))
    return lits.select(*keys, "logical", F.col("pos").cast("int").alias("pos"), "x.*", F.array_contains("error_params", F.col("x.var")).alias("in_error"))


def paren_contents(df: DataFrame, text: str, out: str = "contents") -> DataFrame:
    """Every non-greedy ``(...)`` content of ``text``."""
    return df.withColumn(out, F.regexp_extract_all(F.col(text), F.lit(r"\((.*?)\)"), 1))
