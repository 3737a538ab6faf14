"""Parameter tables from docstrings: cleaning (E6), comma expansion (E7), overlay.

Rows are ``(project, unit, member, section, pos, name, descr)``; ``pos`` is the entry's order in
the docstring (a later entry with the same name replaces an earlier one). The three keys name
what a docstring belongs to: two projects may hold units of one name, and ``member`` is the
method of a class, empty for the class or function itself."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.session import partitions

# FIXED VALUES: projects whose "(a, b)" names become one joined name "a_and_b".
AND_PROJECTS = ("scipy", "example")
UNIT = ["project", "unit", "member"]
SUB_BITS = 32  # order key: pos, then the position inside an expanded name, each below 2^31


def clean_param_rows(params: DataFrame) -> DataFrame:
    """Names cut before a non-leading ``(``; names with ``*``, ``.``, ``[``, ``]`` or a
    blank without a comma dropped; ``\\s*,\\s*`` normalised to ``, `` in descriptions;
    units without any parameter entry dropped; a repeated name keeps its first place and
    the text of its last entry."""
    if "member" not in params.columns:  # documents of units only
        params = params.withColumn("member", F.lit(""))
    paren = F.locate("(", F.col("name"))
    name = F.when(paren > 1, F.trim(F.expr("substring(name, 1, locate('(', name) - 1)"))).otherwise(F.col("name"))
    with_args = params.where(F.col("section") == "param").select(*UNIT).distinct()
    cleaned = (params.join(with_args.hint("merge"), UNIT, "left_semi")  # both by unit, as the groups below
               .withColumn("name", name)
               .withColumn("descr", F.regexp_replace("descr", r"\s*,\s*", ", ")))
    bad = (F.col("name").contains("*") | F.col("name").contains(".") | F.col("name").contains("[")
           | F.col("name").contains("]") | (F.col("name").contains(" ") & ~F.col("name").contains(",")))
    kept = cleaned.where(~bad)
    return (kept.groupBy(*UNIT, "section", "name")
            .agg(F.max_by("descr", "pos").alias("descr"), F.min("pos").alias("pos")))


def expand_comma_names(params: DataFrame, and_projects: Sequence[str] = AND_PROJECTS) -> DataFrame:
    """One row per alias of a comma name: ``{a,b}_sfx`` -> a_sfx, b_sfx; ``(a, b)`` ->
    a, b (or ``a_and_b`` for the configured projects); otherwise split on commas.
    ``order`` keeps the docstring order (pos, then position inside the name)."""
    braces = F.regexp_extract("name", r"\{([^{}]+)\}_([a-zA-Z0-9_]+)", 1)
    suffix = F.regexp_extract("name", r"\{([^{}]+)\}_([a-zA-Z0-9_]+)", 2)
    parens = F.regexp_extract("name", r"\(([^()]+)\)", 1)
    trim_all = lambda arr: F.transform(arr, lambda x: F.trim(x))
    aliases = (F.when(~F.col("name").contains(","), F.array(F.col("name")))
               .when(braces != "", F.transform(trim_all(F.split(braces, ",")), lambda x: F.trim(F.concat(x, F.lit("_"), suffix))))
               .when(parens != "", F.when(F.col("project").isin(list(and_projects)),
                                          F.array(F.array_join(trim_all(F.split(parens, ",")), "_and_")))
                     .otherwise(trim_all(F.split(parens, ","))))
               .otherwise(trim_all(F.split(F.col("name"), ","))))
    exploded = params.select(*UNIT, "section", "pos", "descr",
                             F.posexplode(aliases).alias("sub", "alias"))
    ranked = exploded.select(*UNIT, "section", F.col("alias").alias("name"), "descr",
                             (F.shiftleft(F.col("pos").cast("long"), SUB_BITS) + F.col("sub")).alias("order"))
    return (ranked.groupBy(*UNIT, "section", "name")
            .agg(F.max_by("descr", "order").alias("descr"), F.min("order").alias("order")))


def overlay_params(params: DataFrame) -> DataFrame:
    """The 'pa' map: parameters overlaid by attributes of the same name."""
    prio = F.when(F.col("section") == "attr", F.lit(1)).otherwise(F.lit(0))
    return params.groupBy(*UNIT, "name").agg(F.max_by("descr", F.struct(prio, "order")).alias("descr"))


def param_table(raw: DataFrame, and_projects: Sequence[str] = AND_PROJECTS) -> DataFrame:
    """E6 then E7, in partitions by unit that both keep."""
    raw = raw.repartition(partitions(raw), *(c for c in UNIT if c in raw.columns))
    return expand_comma_names(clean_param_rows(raw), and_projects)


# ---- section parsers (E4 numpy, E5 google) --------------------------------------------------------------
from concordia.functions import vocab  # noqa: E402
from concordia.functions.scan import exclusive_scan  # noqa: E402
from pyspark.sql import Column  # noqa: E402

_WS = "[ \\t\\r\\n\\f\\x0B]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^" + _WS + "+|" + _WS + "+$", "")


def _header_kind(line: Column, style: Column) -> tuple[Column, Column]:
    """(kind, skips_next) of a header line for the doc's dialect; kind is 'param',
    'attr' or 'none' (a section that is not read), null when the line is no header."""
    numpy = F.lit(None).cast("string")
    for h, kind in reversed(list(vocab.NUMPY_HEADERS.items())):
        cond = line.startswith(h)
        if h == "return":
            cond = cond & ~line.contains(":")
        numpy = F.when(cond, F.lit(kind or "none")).otherwise(numpy)
    google = F.lit(None).cast("string")
    for h, kind in reversed(list(vocab.GOOGLE_HEADERS.items())):
        google = F.when(line.startswith(h), F.lit(kind or "none")).otherwise(google)
    is_numpy = style.isin("Parameters", "Parameters:")
    kind = F.when(is_numpy, numpy).when(style == "Args:", google)
    g_skip = F.lit(False)
    for h in vocab.GOOGLE_SKIP_NEXT:
        g_skip = g_skip | line.startswith(h)
    skips = F.when(is_numpy, kind.isNotNull()).otherwise(kind.isNotNull() & g_skip)
    return kind, skips


def parse_sections(lines: DataFrame, style: str = "flag") -> DataFrame:
    """Docstring lines (unit, project, flag, line_no, line) to parameter rows
    ``unit, project, section, pos, name, descr`` (pos = line of the key).

    A header line switches the section ('param', 'attr', or one that is not read) and,
    for numpy headers and google Raises:/Note:, swallows the next line (so of adjacent
    such headers every second one is swallowed).  In a read section a line with ``:``
    at the document's first key indent starts a key; deeper ``:`` lines and plain lines
    continue it.  Deeper ``:`` lines met while no key is open wait for the next key.
    Dialects other than 'Parameters', 'Parameters:' and 'Args:' yield nothing.

    A line is a transition of the reader (`_step`), and transitions compose, so lines are read
    by two associative scans in chunks (`functions.scan`): the longest docstring is spread
    over tasks, and no window spans a document. Only one entry's lines come together."""
    keys, none = ["project", "unit"], F.lit(None)
    number = F.col("line_no").cast("long")
    kind, skips = _header_kind(F.col("line"), F.col(style))
    indent = F.length("line") - F.length(F.regexp_replace("line", "^ +", ""))
    read = lines.select("unit", "project", "line_no", "line", kind.alias("hkind"), F.coalesce(skips, F.lit(False)).alias("hskip"),
                        F.col("line").contains(":").alias("colon"), indent.alias("indent"))
    top = read.agg(F.max("line_no")).first()[0] or 0
    steps = read.withColumn("step", F.array(*(_step(state, number) for state in range(4))))
    still = F.array(*(F.struct(F.lit(state).alias("end"), none.cast(HEADER).alias("hdr"), none.cast("int").alias("first")) for state in range(4)))
    known = exclusive_scan(steps, keys, "line_no", "step", still, _then, top=top).withColumn("at", F.get("before", F.lit(0)))
    swallowed = (F.col("at.end") % 2) == 1
    content = F.col("hkind").isNull() & ~swallowed & (F.col("at.end") >= 2)
    found = known.select(*keys, "line_no", "line", content.alias("content"), "colon", F.col("at.hdr").alias("hdr"),
                         F.coalesce(content & F.col("colon") & (F.col("indent") == F.coalesce("at.first", "indent")), F.lit(False)).alias("is_key"))
    # keys before a line, and the line of the last one
    counted = found.withColumn("key", F.struct(F.col("is_key").cast("long").alias("n"), F.when(F.col("is_key"), number).alias("line")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), none.cast("long").alias("line"))
    owned = exclusive_scan(counted, keys, "line_no", "key", zero, lambda a, b: F.struct(
        (a["n"] + b["n"]).alias("n"), F.coalesce(b["line"], a["line"]).alias("line")), top=top)
    is_open = F.col("before.line") > F.col("hdr.line")  # content always has a header before it
    owner = (F.when(F.col("is_key"), F.col("before.n") + 1)
             .when(F.col("content") & is_open, F.col("before.n"))
             .when(F.col("content") & F.col("colon"), F.col("before.n") + 1))
    part = F.when(F.col("is_key"), _strip(F.expr("substring(line, instr(line, ':') + 1)"))).otherwise(_strip(F.col("line")))
    entry = F.when(F.col("is_key"), F.struct(F.col("line_no").alias("pos"), F.col("hdr.kind").alias("section"),
                                             _strip(F.substring_index("line", ":", 1)).alias("name")))
    parts = owned.select(*keys, owner.alias("owner"), entry.alias("entry"), F.struct("line_no", part.alias("part")).alias("p"))
    entries = (parts.where(F.col("owner").isNotNull()).groupBy(*keys, "owner")
               .agg(F.max("entry").alias("entry"), F.sort_array(F.collect_list("p")).alias("ps"))
               .where(F.col("entry").isNotNull()))  # lines that wait for a key that never comes
    joined = F.regexp_replace(_strip(F.array_join(F.transform("ps", lambda x: x["part"]), " ")), r"\s*,\s*", ", ")
    return entries.select("unit", "project", "entry.section", F.col("entry.pos").cast("int").alias("pos"), "entry.name", joined.alias("descr"))


HEADER = "struct<line: bigint, kind: string>"


def _step(state: int, number: Column) -> Column:
    """What a line does to a reader in ``state``: the state after it, the header it is, if any,
    and the indent of its key, if it is content with a colon. States: 1 is added where the
    line is swallowed, 2 where the section is read."""
    swallowed, read = state % 2 == 1, state >= 2
    no_header, no_indent = F.lit(None).cast(HEADER), F.lit(None).cast("int")
    if swallowed:
        return F.struct(F.lit(2 * read).alias("end"), no_header.alias("hdr"), no_indent.alias("first"))
    header = F.col("hkind").isNotNull()
    return F.struct(
        F.when(header, F.col("hskip").cast("int") + 2 * F.col("hkind").isin("param", "attr").cast("int")).otherwise(2 * read).alias("end"),
        F.when(header, F.struct(number.alias("line"), F.col("hkind").alias("kind"))).alias("hdr"),
        (F.when(~header & F.col("colon"), F.col("indent")) if read else no_indent).alias("first"))


def _then(a: Column, b: Column) -> Column:
    """Transition of two runs of lines, the second after the first."""
    def step(x: Column) -> Column:
        y = F.get(b, x["end"])
        return F.struct(y["end"].alias("end"), F.coalesce(y["hdr"], x["hdr"]).alias("hdr"), F.coalesce(x["first"], y["first"]).alias("first"))
    return F.transform(a, step)
