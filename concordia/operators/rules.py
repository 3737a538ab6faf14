"""Rule tables: screening (C7), literals (C1), typing (C3), clauses (C2), fuzzy variables (C8),
literal relations (C10) and quarantine (V8).

A rule is a text such as ``(strategy = 'uniform') -> (sample_weight != 'None')``.
Everything here is a per-row column expression; the logic of a rule is read by
``concordia.functions.logic``.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import logic, vocab
from concordia.functions.exprs import CALL_DETECT_RE, CALL_LITERAL_RE, LITERAL_RE, W, is_number
from concordia.session import materialize

TEMPLATES = 20_000  # at most so many distinct templates, and of so many bytes, are broadcast
TEMPLATE_BYTES = 4 << 20
QUOTED_CONSTANT_RE = "[\"'](None|False|True)[\"']"


def quoted_words_re(words: Iterable[str]) -> str:
    """Regex finding any of ``words`` (lower-cased) between single quotes."""
    return "'(?:" + "|".join(re.escape(w.lower()) for w in words) + ")'"


def _contains_quoted(text: Column, words: Iterable[str]) -> Column:
    """Some word occurs quoted in the lower-cased text (one regex, text referenced once)."""
    return F.lower(text).rlike(quoted_words_re(words))


def screen_expr(text: Column,
                unsolved_words: Sequence[str] = vocab.UNSOLVED_WORDS,
                fuzzy_words: Sequence[str] = vocab.FUZZY_NONEXISTENCE + vocab.FUZZY_EXISTENCE) -> Column:
    """C7 verdict of one rule text: no_arrow | unsolvable | fuzzy | crisp."""
    return (F.when(~text.contains("->"), F.lit("no_arrow"))
            .when(_contains_quoted(text, unsolved_words), F.lit("unsolvable"))
            .when(_contains_quoted(text, fuzzy_words), F.lit("fuzzy"))
            .otherwise(F.lit("crisp")))


def screen_rules(rules: DataFrame, text: str = "text", **word_lists) -> DataFrame:
    """Add ``screen`` to every rule."""
    return rules.withColumn("screen", screen_expr(F.col(text), **word_lists))


def normalize_constants(text: Column) -> Column:
    """None / True / False become quoted string constants, quoted or not (quotes around
    them are dropped, then every occurrence is quoted: one pass, as the three words
    never overlap). Texts without these words stay unread."""
    t = F.regexp_replace(text, QUOTED_CONSTANT_RE, "$1")
    any_word = text.contains("None") | text.contains("False") | text.contains("True")
    return F.when(any_word, F.regexp_replace(t, "(None|False|True)", "'$1'")).otherwise(text)


def has_call(norm: Column) -> Column:
    return norm.rlike(W + r"\s*\(") & norm.rlike(CALL_DETECT_RE)  # few texts have a name before a parenthesis


def templated_expr(norm: Column) -> Column:
    """The rule with every literal replaced by ``{}`` (input of ``skeleton_columns``);
    ``norm`` is the staged output of ``normalize_constants``."""
    return (F.when(has_call(norm), F.regexp_replace(norm, CALL_LITERAL_RE, "{}"))
            .otherwise(F.regexp_replace(norm, LITERAL_RE, "{}")))


MARK, GROUP, ESCAPE = "\x01", "\x02", "\x03"  # before a literal, after each of its groups; before a sign that stands for one of the three
ESCAPED = ((ESCAPE, ESCAPE + "\x04"), (MARK, ESCAPE + "\x05"), (GROUP, ESCAPE + "\x06"))
MARKED = MARK + "".join(f"${i}{GROUP}" for i in range(1, 5))


def _marked_literals(norm: Column) -> Column:
    """Literal matches of a (staged) normalised text, one text each: its four groups, GROUP after
    each. The text is read once, by a replacement that marks the groups, instead of once a group;
    signs of its own that equal the marks are replaced by signs that are no part of a name, a blank
    or an operator either (`_unescaped`)."""
    safe = norm
    for sign, code in ESCAPED:
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    text = F.when(norm.rlike(f"[{MARK}{GROUP}{ESCAPE}]"), safe).otherwise(norm)
    found = F.when(has_call(norm), F.regexp_replace(text, CALL_LITERAL_RE, MARKED)).otherwise(F.regexp_replace(text, LITERAL_RE, MARKED))
    pieces = F.split(found, MARK)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _unescaped(group: Column) -> Column:
    text = group
    for sign, code in reversed(ESCAPED):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return F.when(group.contains(ESCAPE), text).otherwise(group)


def _read_groups(groups: Column) -> Column:
    """The four groups of a literal match as a struct with what is asked of them more than once."""
    g1, g2, g3, g4 = (F.get(groups, F.lit(i)) for i in range(4))
    return F.struct(g1.alias("g1"), g2.alias("g2"), _unescaped(g3).alias("g3"), _unescaped(g4).alias("g4"),
                    is_number(g1).alias("num_left"), ((g4 != "") & ~is_number(g4)).alias("bare_word"))


def _literal_columns(m: Column) -> dict[str, Column]:
    """``var, op, sval, nval, lit_error`` of a literal match (`_read_groups`)."""
    num_left, bare_word = m["num_left"], m["bare_word"]
    return {"var": F.when(num_left, m["g4"]).otherwise(m["g1"]),
            "op": F.when(num_left, _mirror(m["g2"])).otherwise(m["g2"]),
            "sval": F.when(num_left, F.lit("")).when(bare_word, m["g4"]).otherwise(m["g3"]),
            "nval": F.when(num_left, m["g1"]).when(bare_word, F.lit("")).otherwise(m["g4"]),
            "lit_error": F.when(num_left & m["g2"].isin("=", "!="), F.lit("numeric_left_equality"))}


def _mirror(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in vocab.MIRROR_OP.items():
        out = F.when(op == a, F.lit(b)).otherwise(out)
    return out


def literals_from_text(df: DataFrame, text: str, keys: Sequence[str], pos: str = "slot") -> DataFrame:
    """Explode the literals of ``text`` into ``keys + (pos, var, op, sval, nval, lit_error)``.

    A numeric left side is mirrored (``3 < x`` becomes ``x > 3``); with ``=`` or ``!=`` it
    cannot be mirrored and the literal is an error.  A bare word value becomes a string.
    """
    staged = df.select(*keys, normalize_constants(F.col(text)).alias("__norm"))
    g = (staged.select(*keys, F.posexplode(_marked_literals(F.col("__norm"))).alias(pos, "m"))
         .select(*keys, F.col(pos).cast("int").alias(pos), F.split("m", GROUP).alias("m"))
         .select(*keys, pos, _read_groups(F.col("m")).alias("m")))
    return g.select(*keys, pos, *(c.alias(n) for n, c in _literal_columns(F.col("m")).items()))


def literals_in_row(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the typed literals of ``text`` (C1, C3) as an array of structs, in text order."""
    # a step each, so that what a later step uses several times is found once
    def typed(x: Column) -> Column:
        return F.struct(*(x[n].alias(n) for n in ("var", "op", "sval", "nval", "lit_error")),
                        *typed_columns(x["var"], x["op"], x["sval"], x["nval"], x["sort"]))

    def sorted_(x: Column) -> Column:
        return F.struct(*(x[n].alias(n) for n in ("var", "op", "sval", "nval", "lit_error")),
                        literal_sort(x["var"], x["op"], x["sval"], x["nval"]).alias("sort"))

    lits = F.transform(F.transform("__m", lambda m: F.split(m, GROUP)), _read_groups)
    lits = F.transform(lits, lambda m: F.struct(*(c.alias(n) for n, c in _literal_columns(m).items())))
    return (df.withColumn("__norm", normalize_constants(F.col(text))).withColumn("__m", _marked_literals(F.col("__norm")))
            .withColumn(out, F.transform(F.transform(lits, sorted_), typed)).drop("__norm", "__m"))


def rule_literals(rules: DataFrame, keys: Sequence[str] = ("unit", "rule_id"), text: str = "text") -> DataFrame:
    """One row per literal of every rule, in text order (``slot`` = 0, 1, ...)."""
    return literals_from_text(rules, text, list(keys), "slot")


def literal_sort(var: Column, op: Column, sval: Column, nval: Column) -> Column:
    """C3 sort of a literal: S string, R real, B opaque (always true), V variable-to-variable
    (undecided), E no value (malformed)."""
    opaque = F.lit(False)
    for p in vocab.OPAQUE_PREFIXES:
        opaque = opaque | var.startswith(p)
    return (F.when(opaque, F.lit("B"))
            .when(op.isin("=", "!="), F.when(sval != "", F.when(sval.isin("True", "False"), F.lit("R")).otherwise(F.lit("S")))
                  .when(nval != "", F.lit("R")).otherwise(F.lit("E")))
            .when(nval != "", F.lit("R"))
            .when(sval != "", F.lit("V"))
            .otherwise(F.lit("E")))


def typed_columns(var: Column, op: Column, sval: Column, nval: Column, sort: Column | None = None) -> list[Column]:
    """C3 typing of a literal; ``sort`` is its `literal_sort` where that is a column already.

    ``rop``/``num``/``sv`` give the relation actually imposed: ``= True`` is ``!= 0``, ``= False``
    is ``= 0``; a name used with strings and with numbers is two independent variables (sorts differ)."""
    sort = literal_sort(var, op, sval, nval) if sort is None else sort
    eqish = op.isin("=", "!=")
    boolean = sval.isin("True", "False")
    rop = F.when(eqish & (sval == "True"), F.when(op == "=", F.lit("!=")).otherwise(F.lit("=")))\
        .otherwise(op)
    num = (F.when(eqish & boolean, F.lit(0.0))
           .when(sort == "R", nval.cast("double") + F.lit(0.0)))
    sv = F.when(sort == "S", sval)
    return [sort.alias("sort"), rop.alias("rop"), num.alias("num"), sv.alias("sv")]


def typed_literals(lits: DataFrame) -> DataFrame:
    """Add sort / rop / num / sv to a literal table."""
    return lits.select("*", *typed_columns(F.col("var"), F.col("op"), F.col("sval"), F.col("nval")))


def symbols_expr(var: Column, sval: Column, chars: Sequence[str] = vocab.SYMBOL_CHARS) -> Column:
    cond = F.lit(False)
    for ch in chars:
        cond = cond | var.contains(ch) | sval.contains(ch)
    return cond


def few_templates(distinct: DataFrame) -> bool:
    """Whether a (cut) table of templates is small enough to go to every task."""
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("templated")), F.lit(0)).alias("bytes")).first()
    return size.n <= TEMPLATES and size.bytes <= TEMPLATE_BYTES


def skeleton_columns(templated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logic of every row of ``keys + (templated,)``: logic, n_slots, dnf, rpn, skeleton error.

    The logic depends on the template alone, of which there are few: it is read once for each
    distinct one and joined back. A text of one literal is a condition whatever surrounds it,
    but has no similarity program. The rows are never sorted for that join: a template may have
    most of them."""
    marks, prog, n = F.col("__marks"), F.col("__prog"), F.col("n_slots")
    distinct = materialize(templated.where(F.col("templated").isNotNull()).select("templated").distinct())
    few = few_templates(distinct)
    read = (distinct
            .withColumn("__marks", logic.mark_text(F.col("templated")))
            .withColumn("n_slots", F.size(F.split("templated", r"\{\}")) - 1)
            .withColumn("__prog", F.when(n > 1, logic.program(marks))))
    fold = F.when(logic.readable_as_score(marks, prog), prog)
    error = (F.when(n == 0, "no_literal").when(n == 1, "single_literal")
             .when(prog.isNull(), "skeleton").when(fold.isNull(), "fold").otherwise(""))
    # cut, so that no later plan has to analyse these deep expressions again
    shapes = materialize(read.select("templated", logic.logic_text(marks).alias("logic"), "n_slots",
                         F.when(n == 1, F.array(F.array(F.lit(1)))).otherwise(logic.clauses(prog)).alias("dnf"),
                         fold.alias("rpn"), error.alias("skeleton_error")))
    found = F.coalesce("skeleton_error", F.lit("null"))
    return templated.join(shapes.hint("broadcast" if few else "shuffle_hash"), "templated", "left").select(
        *keys, "logic", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "dnf", "rpn",
        F.when(found != "", found).alias("skeleton_error"))


def rule_skeletons(rules: DataFrame, text: str = "text", keys: Sequence[str] = ("unit", "rule_id")) -> DataFrame:
    """Logic of every rule: logic, n_slots, dnf, rpn, skeleton error."""
    staged = rules.select(*keys, normalize_constants(F.col(text)).alias("__norm"))
    return skeleton_columns(staged.select(*keys, templated_expr(F.col("__norm")).alias("templated")), keys)


def rule_clauses(rules: DataFrame, text: str = "text", keys: Sequence[str] = ("unit", "rule_id")) -> DataFrame:
    """DNF of every rule as rows ``keys + (clause_id, pos, slot, negated)``."""
    sk = rule_skeletons(rules, text, keys).where(F.col("dnf").isNotNull())
    c = sk.select(*keys, F.posexplode("dnf").alias("clause_id", "lits"))
    return c.select(*keys, F.col("clause_id").cast("int").alias("clause_id"),
                    F.posexplode("lits").alias("pos", "signed")).select(
        *keys, "clause_id", F.col("pos").cast("int").alias("pos"),
        (F.abs(F.col("signed")) - 1).alias("slot"), (F.col("signed") < 0).alias("negated"))


def names_in_source(names: DataFrame, sources: DataFrame, keys: Sequence[str] = ("unit", "rule_id")) -> DataFrame:
    """``keys + in_source``: whether every name of a rule (rows ``keys + name``) occurs in a
    source text of its unit (``unit, text``). A unit's name is looked for once, whatever number of
    rules has it; a unit without a source holds no name."""
    asked = names.select("unit", "name").distinct()
    found = (asked.join(sources.select("unit", "text"), "unit").where(F.col("text").contains(F.col("name")))
             .select("unit", "name").distinct().withColumn("found", F.lit(True)))
    return (names.join(found, ["unit", "name"], "left")
            .groupBy(*keys).agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("in_source")))


def fuzzy_vars(rules: DataFrame, text: str = "text", keys: Sequence[str] = ("unit", "rule_id"),
               existence: Sequence[str] = vocab.FUZZY_EXISTENCE,
               nonexistence: Sequence[str] = vocab.FUZZY_NONEXISTENCE) -> DataFrame:
    """Variables of a fuzzy rule's right side compared with an existence word.

    ``exist_flag`` starts true for existence words and false for non-existence words and
    flips when the right side contains ``!=``.  Rules whose right side names no such
    variable are returned with an empty ``vars`` array."""
    staged = rules.select(*keys, F.element_at(F.split(F.col(text), "->"), 2).alias("__right"))
    right = F.col("__right")

    def words_re(words: Sequence[str]) -> str:
        alts = "|".join(re.escape(w) for w in words)
        return "(" + W + r"+)\s*(?:=|!=)\s*['\"](?:" + alts + ")['\"]"

    is_exist = _contains_quoted(right, existence)
    is_nonexist = _contains_quoted(right, nonexistence)
    flag0 = F.when(is_exist, F.lit(True)).when(is_nonexist, F.lit(False))
    vars_ = (F.when(is_exist, F.regexp_extract_all(right, F.lit(words_re(existence)), 1))
             .when(is_nonexist, F.regexp_extract_all(right, F.lit(words_re(nonexistence)), 1)))
    flag = F.when(right.contains("!="), ~flag0).otherwise(flag0)
    return staged.select(*keys, F.coalesce(vars_, F.array().cast("array<string>")).alias("vars"),
                        flag.alias("exist_flag"))


def list_relations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Do two name lists intersect, and is ``a`` contained in ``b``."""
    return df.withColumn("intersects", F.arrays_overlap(F.col(a), F.col(b))).withColumn(
        "contained", F.size(F.array_except(F.col(a), F.col(b))) == 0)
