"""Units from source files (E1), their counters (E2) and declared parameters.

Physical lines are joined to logical ones first. What a line does to the reader is a
transition: for each of three states at its start (code, inside either kind of triple
quotes) the state at its end, the change of bracket depth and whether a backslash continues
it. Transitions compose, so an associative scan (`functions.scan`) gives every line its state
at the start without any task reading a whole file. A logical line begins where the state is
code, depth 0 and not continued; headers and block openers are logical lines, so headers
over several lines, deep defaults and prose inside of strings are read as the language does.

The direct parent of a header is the last opener before it with a smaller indent: a scan
again, of the openers that later lines can still see (each indented more than the one before).
A docstring is a string that makes up the first logical line of the body, cleaned of its
indentation; escapes in it are not evaluated. Names are ASCII. ``async def`` is a header
that is never a unit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions.scan import exclusive_scan
from concordia.session import materialize

HEADER_RE = r"^( *)(async +def|def|class) +([A-Za-z_][A-Za-z0-9_]*)"
TRIPLES = ('"""', "'''")
CODE = 0
# complete strings and comments of a line, or an open triple quote (kept as group 1) with the rest
TOKENS_RE = (r'"""[\s\S]*?"""' r"|'''[\s\S]*?'''" r"|(\"\"\"|''')[\s\S]*$" r'|"[^"]*"' r"|'[^']*'" r"|#.*$")
SIGNS_RE = "[\"'#\\\\]"  # what a line needs to differ from its code
QUOTE_MARK = "\x01"  # stands for a complete string in code


def doc_flag(flag: Column) -> Column:
    """The text a docstring must contain: 'Parameters' must be followed by an underline."""
    return F.when(flag == "Parameters", F.lit("Parameters\n-----")).otherwise(flag)


def _with_code(lines: DataFrame, states: dict[str, Column | int]) -> DataFrame:
    """Add a column a state: code of ``line`` where it starts in that state: strings as marks,
    comments gone, an open triple quote at the end; for a line inside of a string what follows its
    end, else null.

    Each step is a column of its own: as one expression every use of a step would repeat all
    steps before it, and driver and tasks would hold and run thousands of them. Lines without any
    sign that matters (most of them) are their own code, and no step runs for them."""
    plain = ~F.col("line").rlike(SIGNS_RE)
    steps = lines.withColumn("__bare", F.when(~plain, F.regexp_replace("line", r"\\.", "  ")))  # an escaped sign neither opens nor closes

    def at(state: Column | int, code: Column, *after: Column) -> Column:
        if isinstance(state, int):
            return (code, *after)[state]
        return F.when(state == CODE, code).when(state == 1, after[0]).otherwise(after[1])

    rest = [F.when(F.instr("__bare", q) > 0, F.substring("__bare", F.instr("__bare", q) + 3, F.length("__bare"))) for q in TRIPLES]
    marked, comment = {}, {}
    for name, state in states.items():
        text = f"__text_{name}"
        steps = steps.withColumn(text, at(state, F.col("__bare"), *rest))
        marked[f"__marked_{name}"] = F.regexp_replace(text, TOKENS_RE, QUOTE_MARK + "$1")
        comment[f"__last_{name}"] = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({TOKENS_RE})"), F.lit(1)), F.lit(-1))
    steps = steps.withColumns(marked | comment)
    code = {}
    for name, state in states.items():
        last = F.col(f"__last_{name}")
        # a mark before an open triple quote belongs to it; comments leave a mark at the end
        cut = F.regexp_replace(f"__marked_{name}", QUOTE_MARK + r"(\"\"\"|''')$", "$1")
        commented = F.coalesce(last.startswith("#") & F.col(f"__text_{name}").endswith(last), F.lit(False))
        found = F.when(commented, F.regexp_replace(cut, QUOTE_MARK + "$", "")).otherwise(cut)
        first = at(state, F.lit(""), F.lit(QUOTE_MARK), F.lit(QUOTE_MARK))
        code[name] = F.when(plain, at(state, F.col("line"), F.lit(None), F.lit(None))).otherwise(F.concat(first, found))
    return steps.withColumns(code).select(*lines.columns, *states)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _step(code: Column, state: int) -> Column:
    """What a line of this code does when it starts in ``state``."""
    to = (F.when(code.isNull(), state).when(code.endswith(TRIPLES[0]), 1).when(code.endswith(TRIPLES[1]), 2).otherwise(CODE))
    depth = F.when(code.rlike(r"[()\[\]{}]"), _count(code, "([{") - _count(code, ")]}")).otherwise(F.lit(0).cast("long"))
    goes_on = F.coalesce(code.endswith("\\"), F.lit(False))
    return F.struct(to.cast("int").alias("to"), depth.alias("depth"), goes_on.alias("goes_on"))


def _then(a: Column, b: Column) -> Column:
    """Transition ``a`` followed by ``b``."""
    def one(x: Column) -> Column:
        y = F.get(b, x["to"])
        return F.struct(y["to"].alias("to"), (x["depth"] + y["depth"]).alias("depth"), y["goes_on"].alias("goes_on"))
    return F.transform(a, one)


def logical_lines(lines: DataFrame) -> DataFrame:
    """``project, path, line_no, line, code, begins, logical``: each physical line with its code,
    whether it begins a logical line, and the number of the line where its logical line begins."""
    keys = ["project", "path"]
    still = F.array(*(F.struct(F.lit(s).alias("to"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("goes_on")) for s in range(3)))
    top = lines.agg(F.max("line_no")).first()[0] or 0
    coded = _with_code(lines.select(*keys, "line_no", "line"), {f"__code{s}": s for s in range(3)})
    # the codes go along, so that none is made twice; most lines are their own code, and have none inside of a string
    steps = coded.select(*keys, "line_no", "line", F.when(F.col("__code0") != F.col("line"), F.col("__code0")).alias("__code0"), "__code1", "__code2",
                         F.array(*(_step(F.col(f"__code{s}"), s) for s in range(3))).alias("step"))
    state = exclusive_scan(steps, keys, "line_no", "step", still, _then, top=top).withColumn("at", F.get("before", F.lit(CODE)))
    code = F.when(F.col("at.to") == CODE, F.coalesce("__code0", "line")).when(F.col("at.to") == 1, F.col("__code1")).otherwise(F.col("__code2"))
    read = state.select(*keys, "line_no", "line", F.col("at.to").alias("state"),
                        ((F.col("at.to") == CODE) & (F.col("at.depth") <= 0) & ~F.col("at.goes_on")).alias("open"), code.alias("code"))
    begins = F.col("open") & (F.trim("code") != "")
    first = read.withColumn("begins", begins).withColumn("first", F.when(begins, F.col("line_no")))
    nothing = F.lit(None).cast(first.schema["first"].dataType)
    return (exclusive_scan(first, keys, "line_no", "first", nothing, lambda a, b: F.coalesce(b, a), top=top)
            .select(*keys, "line_no", "line", "state", F.coalesce("code", F.lit("")).alias("code"), "begins",
                    F.coalesce("first", "before").alias("logical"), F.col("before").alias("previous")))


def _clean(df: DataFrame, text: str) -> DataFrame:
    """The docstring in column ``text`` without quotes and common indentation, blank lines at its
    ends dropped; the margin is a column, found once a docstring."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^\s*[rRuU]?(\"\"\"|'''|\"|')", ""), r"(\"\"\"|'''|\"|')\s*;?\s*(#[^\n]*)?$", "")
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    ls, tail = F.col("__ls"), F.slice("__ls", F.lit(2), F.size("__ls"))
    margin = F.coalesce(F.array_min(F.transform(F.filter(tail, lambda x: F.trim(x) != ""), indent)), F.lit(0))
    body = F.concat(F.array(F.ltrim(F.element_at(ls, 1))), F.transform(
        tail, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(F.substring(x, F.col("__margin") + 1, F.length(x)))))
    return (df.withColumn("__ls", F.split(inner, "\n")).withColumn("__margin", margin)
            .withColumn(text, F.regexp_replace(F.regexp_replace(F.array_join(body, "\n"), r"^\n+", ""), r"\s+$", ""))
            .drop("__ls", "__margin"))


def _doc_part(opening: Column) -> Column:
    """What a line holds of a docstring: from an open triple quote on, up to a closing one, or the
    string that the line begins with; the whole line inside."""
    line, bare = F.col("line"), F.regexp_replace("line", r"\\.", "  ")
    first = F.regexp_extract(bare, r"""^\s*[rRuU]?("\""[\s\S]*?"\""|'''[\s\S]*?'''|"[^"]*"|'[^']*')""", 0)
    end = F.when(F.col("state") == 1, F.instr(bare, TRIPLES[0])).otherwise(F.instr(bare, TRIPLES[1]))
    return (F.when(opening, F.regexp_extract(line, r"""([rRuU]?("\""|''')(?:(?!\2).)*+)$""", 1))
            .when((F.col("state") != CODE) & F.col("code").startswith(QUOTE_MARK), F.substring(line, F.lit(1), end + 2))
            .when(F.col("state") == CODE, F.substring(line, F.lit(1), F.length(first))).otherwise(line))


def code_structure(lines: DataFrame, doc_style: DataFrame) -> DataFrame:
    """Every header with kind, parent, docstring and code:
    ``project, path, line_no, hkind, name, kind, parent, docstring, with_doc, header``."""
    keys = ["project", "path"]
    # every side of these joins grows with the sources, and texts are much larger than their
    # compressed shuffle blocks: merge joins, so that none is broadcast through the driver
    read = materialize(logical_lines(lines))
    starts = read.where("begins").select(
        *keys, "line_no", "previous", "line", "code", (F.length("line") - F.length(F.ltrim("line"))).alias("indent"),
        F.regexp_replace(F.regexp_extract("code", HEADER_RE, 2), " +", " ").alias("hkind"), F.regexp_extract("code", HEADER_RE, 3).alias("name"))
    # logical lines that open a block: the last code of theirs ends with a colon
    tails = (read.where(F.col("logical").isNotNull() & (F.trim("code") != "")).groupBy(*keys, F.col("logical").alias("line_no"))
             .agg(F.max_by("code", "line_no").alias("tail")))
    heads_code = (read.join(starts.where("hkind <> ''").select(*keys, F.col("line_no").alias("logical")).hint("merge"), [*keys, "logical"])
                  .groupBy(*keys, F.col("logical").alias("line_no"))
                  .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "code"))),
                                                lambda x: F.regexp_replace(x["code"], r"\\$", "")), " ").alias("header")))
    known = materialize(starts.join(tails.hint("merge"), [*keys, "line_no"], "left").where("hkind <> '' or tail rlike ':\\\\s*$'"))
    opens = F.col("tail").rlike(r":\s*$")
    see = F.when(opens, F.array(F.struct("indent", F.col("hkind").alias("kind"), "name"))).otherwise(
        F.slice(F.array(F.struct("indent", F.col("hkind").alias("kind"), "name")), 1, 0))
    visible = known.withColumn("see", see)
    zero = F.from_json(F.lit("[]"), visible.schema["see"].dataType)
    stack = exclusive_scan(visible, keys, "line_no", "see", zero, lambda a, b: F.when(F.size(b) == 0, a).otherwise(
        F.concat(F.filter(a, lambda x: x["indent"] < F.element_at(b, 1)["indent"]), b)))
    heads = materialize(stack.where("hkind <> ''").withColumn("p", F.try_element_at(F.filter("before", lambda x: x["indent"] < F.col("indent")), F.lit(-1)))
             .select(*keys, "line_no", "hkind", "name", "line", F.col("p.kind").alias("p_kind"), F.col("p.name").alias("p_name"))
             .join(heads_code.hint("merge"), [*keys, "line_no"]))
    # a string that begins the first logical line after a header, or the rest of the header's own
    mark_or_open = f"({QUOTE_MARK}\\s*(;.*)?|\"\"\"|''')$"
    body = starts.where(F.col("code").rlike(f"^\\s*[rRuU]?{mark_or_open}")).select(
        *keys, F.col("previous").alias("owner"), F.col("line_no").alias("logical"))
    body = body.join(heads.select(*keys, F.col("line_no").alias("owner")).hint("merge"), [*keys, "owner"], "left_semi")
    over_lines = heads.where(F.col("header").rlike(f":\\s*[rRuU]?(\"\"\"|''')\\s*{QUOTE_MARK}\\s*;?\\s*$"))
    body = body.union(over_lines.select(*keys, F.col("line_no").alias("owner"), F.col("line_no").alias("logical")))
    opening = (F.col("state") == CODE) & (F.col("code").endswith(TRIPLES[0]) | F.col("code").endswith(TRIPLES[1]))
    docs = (read.where(F.col("begins") | (F.col("state") != CODE) | opening).join(body.hint("merge"), [*keys, "logical"])
            .where((F.col("logical") != F.col("owner")) | (F.col("state") != CODE) | opening)
            .groupBy(*keys, F.col("owner").alias("line_no"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", _doc_part(opening).alias("part")))), lambda x: x["part"]), "\n").alias("text")))
    own = F.when(F.col("header").rlike(f":\\s*[rRuU]?{QUOTE_MARK}\\s*;?\\s*$"),
                 F.regexp_extract("line", r"""^.*[)\]A-Za-z0-9_"']\s*:\s*([rRuU]?("\""|'''|"|').*\2)\s*;?\s*$""", 1))
    kind = (F.when(F.col("hkind") == "class", F.lit("class"))
            .when(F.col("hkind") == "async def", F.lit("async"))
            .when(F.col("p_kind") == "class", F.lit("member"))
            .otherwise(F.lit("function")))
    out = (heads.join(docs.hint("merge"), [*keys, "line_no"], "left").join(doc_style, "project", "left")
           .select("project", "path", "line_no", "hkind", "name", kind.alias("kind"),
                   F.when(F.col("p_kind") == "class", F.col("p_name")).alias("parent"),
                   F.coalesce(own, F.col("text")).alias("docstring"), "header", "flag"))
    return _clean(out, "docstring").withColumn("with_doc", F.coalesce(F.col("docstring").contains(doc_flag(F.col("flag"))), F.lit(False)))


def extract_units(structure: DataFrame) -> DataFrame:
    """The unit table: classes and independent functions whose docstring carries the
    project's flag, and every member except ``__init__`` (its docstring only with the flag)."""
    keep = (((F.col("kind").isin("class", "function")) & F.col("with_doc"))
            | ((F.col("kind") == "member") & (F.col("name") != "__init__")))
    return structure.where(keep).select(
        "project", "path", "line_no", "kind", "name", "parent", "with_doc",
        F.when(F.col("with_doc"), F.col("docstring")).alias("docstring"))


def unit_stats(structure: DataFrame) -> DataFrame:
    """Six counters per project over every header found."""
    k, d = F.col("kind"), F.col("with_doc")
    member = (k == "member") & (F.col("name") != "__init__")
    return structure.groupBy("project").agg(
        F.count_if(k == "class").alias("class"),
        F.count_if((k == "class") & d).alias("class_with_doc"),
        F.count_if(member).alias("member"),
        F.count_if(member & d).alias("member_with_doc"),
        F.count_if(k == "function").alias("function"),
        F.count_if((k == "function") & d).alias("function_with_doc"))


def _parameters(header: Column) -> Column:
    """Names of a header's parameters, by a fold over its brackets, commas, colons and the text
    between them: only text at depth 1 counts, commas of a lambda's own list do not."""
    tokens = F.regexp_extract_all(header, F.lit(r"([()\[\]{},:]|[^()\[\]{},:]+)"), F.lit(1))
    none = F.slice(F.array(F.lit("")), 1, 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inner"), F.lit(False).alias("done"), F.lit(True).alias("fresh"), none.alias("names"))

    def step(acc: Column, t: Column) -> Column:
        opening, closing = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        depth = acc["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0)
        top = (acc["depth"] == 1) & ~acc["done"]
        starts_lambda = top & t.rlike(r"(^|[^A-Za-z0-9_])lambda($|[^A-Za-z0-9_])")
        inner = F.when(starts_lambda, True).when(top & (t == ":"), False).otherwise(acc["inner"])
        comma = top & (t == ",") & ~acc["inner"]
        name = F.regexp_extract(t, r"^\s*([*]{0,2}\s*[A-Za-z_][A-Za-z0-9_]*)", 1)
        take = top & acc["fresh"] & (name != "")
        return F.struct(depth.alias("depth"), inner.alias("inner"), (acc["done"] | (closing & (depth == 0))).alias("done"),
                        F.when(comma | (opening & (acc["depth"] == 0)), True).when(top & (F.trim(t) != ""), False).otherwise(acc["fresh"]).alias("fresh"),
                        F.when(take, F.concat(acc["names"], F.array(name))).otherwise(acc["names"]).alias("names"))

    return F.aggregate(tokens, start, step, lambda acc: acc["names"])


def signature_params(structure: DataFrame) -> DataFrame:
    """Declared parameters ``project, path, unit, pos, name``: a class gets the names
    of its ``__init__``, a function its own; positional and keyword-only names, without
    ``self``, ``*args``, ``**kw`` and markers; defaults and annotations dropped."""
    src = structure.where((F.col("kind") == "function")
                          | ((F.col("kind") == "member") & (F.col("name") == "__init__")))
    unit = F.when(F.col("kind") == "member", F.col("parent")).otherwise(F.col("name"))
    kept = F.filter(_parameters(F.col("header")), lambda n: (n != "self") & ~n.startswith("*"))
    return src.select("project", "path", unit.alias("unit"), F.posexplode(kept).alias("pos", "name")).select(
        "project", "path", "unit", F.col("pos").cast("int").alias("pos"), "name")
