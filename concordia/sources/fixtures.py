"""Derived relations ("fixtures") built from the driver tables.

Each fixture is one SQL text that reads the same in Spark SQL and DuckDB, so the Spark
jobs and the DuckDB oracle see identical inputs and the inputs grow with the scale
factor.  Placeholders ``{table}`` name driver tables or other fixtures; in Spark they
are bound to DataFrames (``spark.sql(text, **frames)``), for DuckDB they become CTE
names.  A backtick inside a template stands for a single quote (``chr(39)``), which
keeps the texts free of dialect-specific escaping.
"""
from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from concordia.sources.tables import DRIVER_TABLES, table

# Rule templates over the path variables returnflag / linestatus / quantity / discount.
# <f> <s> <q> <d> are filled from each order; one rule per order, template = key % 16.
RULE_TEMPLATES = (
    "(returnflag = `<f>`) -> (linestatus = `<s>`)",                       # crisp AND
    "(returnflag = `<f>`) && (quantity > <q>) -> (discount < <d>)",        # two-literal left
    "((returnflag = `<f>`) || (linestatus = `<s>`)) -> (discount >= <d>)",  # OR group
    "!(linestatus = `<s>`) -> (quantity <= <q>)",                          # NOT
    "(quantity > <q>) -> (discount < <d>)",                                # inequality
    "(returnflag = `R`) && (returnflag = `A`) -> (linestatus = `<s>`)",    # self-contradictory
    "(returnflag = `<f>`) -> (discount = False)",                          # False value
    "(linestatus != None) -> (quantity = True)",                           # None / True values
    "(returnflg = `<f>`) -> (linestatus = `<s>`)",                         # misspelt name
    "(returnflag = `<f>`) -> (price = `exist`)",                           # fuzzy existence
    "(linestatus = `<s>`) -> (discount != `ignore`)",                      # fuzzy non-existence, !=
    "(returnflag = `float32`) -> (linestatus = `<s>`)",                    # unsolvable word
    "(returnflag = `[<f>]`) -> (linestatus = `<s>`)",                      # symbol value
    "(<q> < quantity) -> (discount <= <d>)",                               # numeric left side
    "(returnflag = `<f>`) && (linestatus = `<s>`)",                        # no arrow
    "(<q> = quantity) -> (linestatus = `<s>`)",                            # malformed: numeric-left '='
)


def _case(col: str, texts: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE {col} {whens} END"


FIXTURE_SQL: dict[str, str] = {}

# fx_paths: one observed state per distinct lineitem shape of an order.  Discounts of 9
# or more end in an error terminal naming the parameters that raised.
FIXTURE_SQL["fx_paths"] = """
WITH s AS (
  SELECT DISTINCT l_orderkey AS unit, l_returnflag AS f, l_linestatus AS st,
         CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d
  FROM {lineitem}
), t AS (
  SELECT unit, replace(
    CASE WHEN d >= 9 THEN
      '(returnflag = `' || f || '`) -> (linestatus = `' || st || '`) -> (quantity = '
        || CAST(q AS STRING) || ') -> (discount = ' || CAST(d AS STRING)
        || ') -> `(returnflag)_(discount)_ERROR_END`'
    ELSE
      '(returnflag = `' || f || '`) -> (linestatus = `' || st || '`) -> (quantity = '
        || CAST(q AS STRING) || ') -> "(discount = ' || CAST(d AS STRING)
        || ') ^ (price = `existence_flag`)"'
    END, '`', chr(39)) AS text
  FROM s
)
SELECT unit, CAST(row_number() OVER (PARTITION BY unit ORDER BY text) AS INT) AS path_no, text
FROM t
"""

# fx_rules: one documented rule per order.
FIXTURE_SQL["fx_rules"] = """
WITH o AS (
  SELECT o_orderkey AS unit,
         CAST(o_orderkey % 16 AS INT) AS template,
         CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'A' ELSE 'N' END AS f,
         CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS s,
         CAST(o_custkey % 50 + 1 AS STRING) AS q,
         CAST(o_orderkey % 11 AS STRING) AS d
  FROM {orders}
)
SELECT unit, unit AS rule_id, template,
  replace(replace(replace(replace(replace(""" + _case("template", RULE_TEMPLATES) + """,
    '<f>', f), '<s>', s), '<q>', q), '<d>', d), '`', chr(39)) AS text
FROM o
"""


_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def dependencies(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(FIXTURE_SQL[name])))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` over the driver tables under ``sf_dir``."""
    frames = {}
    for dep in dependencies(name):
        frames[dep] = table(spark, sf_dir, dep) if dep in DRIVER_TABLES else fixture(spark, sf_dir, dep)
    return spark.sql(FIXTURE_SQL[name], **frames)


@lru_cache(maxsize=None)
def _ordered(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in DRIVER_TABLES:
            return
        for d in dependencies(n):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return tuple(out)


def duckdb_ctes(*names: str) -> str:
    """``name AS (...)`` CTE list (without WITH) for DuckDB, dependencies first."""
    parts = []
    for n in _ordered(tuple(names)):
        deps = {d: d for d in dependencies(n)}
        parts.append(f"{n} AS ({FIXTURE_SQL[n].format(**deps)})")
    return ",\n".join(parts)


# fx_unit_sources: the source of each order's unit. Some lack the name discount, some have no source.
FIXTURE_SQL["fx_unit_sources"] = """
SELECT o_orderkey AS unit,
  replace(replace('def check_' || CAST(o_orderkey AS STRING) || '(returnflag, linestatus, quantity=' || CAST(o_custkey % 50 AS STRING)
    || CASE WHEN o_custkey % 13 = 0 THEN '' ELSE ', discount=0' END || '):~    if returnflag == `R` and not linestatus:~'
    || '        raise ValueError(`flag`)~    return quantity * price~', '~', chr(10)), '`', chr(39)) AS text
FROM {orders} WHERE o_custkey % 29 <> 0
"""

# fx_run_logs: one log per event. Errors and clicks end in a finding block (clicks without a results
# line before it), other logs hold a fence without a title; every 150th log is long.
FIXTURE_SQL["fx_run_logs"] = """
SELECT 'c' || CAST(event_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) AS file,
  replace('=== PROJECT: c' || CAST(user_id AS STRING) || ' ===~CLASS: ' || CAST(CAST(floor(value) AS INT) AS STRING) || '~Library: none yet~'
    || repeat('a step of the run~', CASE WHEN event_id % 150 = 0 THEN 300 ELSE 2 END)
    || CASE event_type WHEN 'error' THEN 'normal results: [False, False]~~~' WHEN 'view' THEN 'normal results: [True, False, True]~' ELSE '' END
    || CASE WHEN event_type IN ('error', 'click') THEN
         chr(27) || '[91m[ BAD CONSTRAINT' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' WITH ERROR' ELSE ' WITH FUZZY' END || ' ]' || chr(27) || '[0m~'
         || repeat('#', 50) || '~'
         || CASE WHEN event_id % 3 = 1 THEN 'Type: Raise Error~path: (a = ' || CAST(user_id AS STRING) || ') -> (b: c)~' ELSE '' END
         || 'Library: c' || CAST(user_id AS STRING) || '~'
         || CASE WHEN user_id % 4 = 0 THEN 'Function: f' || CAST(event_id AS STRING) ELSE 'Class: K' || CAST(user_id AS STRING) || '~Memberfunc: fit' END
         || '~Constraint: (a = ' || CAST(user_id AS STRING) || ') -> (b = 2)~path file: /info/c' || CAST(user_id AS STRING) || '/x_path.txt~'
         || repeat('#', 50) || '~Library: after the block~~BAD CONSTRAINT~'
       ELSE repeat('#', 50) || '~Constraint: of no block~' END, '~', chr(10)) AS text
FROM {events}
"""

# fx_verdicts: predicted vs oracle consistency per labelled document; family 1..72 x variant 0..2.
FIXTURE_SQL["fx_verdicts"] = """
SELECT doc_id,
       'c' || CAST(CAST(doc_id % 72 + 1 AS INT) AS STRING) || '-' || CAST(CAST(floor(doc_id / 72) % 3 AS INT) AS STRING) AS case_id,
       CAST(doc_id % 72 + 1 AS INT) AS family,
       CAST(floor(doc_id / 72) % 3 AS INT) AS variant,
       quality = 1 AS predicted,
       toxic = 0 AS oracle
FROM {labels}
"""

# fx_records: extraction records per method (0, 1, 2).
FIXTURE_SQL["fx_records"] = """
SELECT doc_id, CAST(doc_id % 3 AS INT) AS method, quality AS consistent,
       CASE WHEN toxic = 1 THEN 'miss' END AS note
FROM {labels}
"""

# fx_logs: one run log per user; each event prints one line in (ts, event_id) order.
FIXTURE_SQL["fx_logs"] = """
SELECT 'c' || CAST(user_id AS STRING) || '-' || CAST(user_id % 3 AS STRING) AS file,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no,
       CASE event_type
         WHEN 'error' THEN 'BAD CONSTRAINT'
         WHEN 'click' THEN 'CLASS: ' || CAST(CAST(floor(value) AS INT) AS STRING)
         WHEN 'view' THEN 'INSIDE FUNCTION: ' || CAST(CAST(floor(value) AS INT) AS STRING)
         WHEN 'purchase' THEN 'INDEPENDENT FUNCTION: ' || CAST(CAST(floor(value) AS INT) AS STRING)
         ELSE 'Before Filter: ' || CAST(CAST(floor(value) AS INT) AS STRING)
       END AS line
FROM {events}
"""

# fx_params: parsed docstring entries (the output shape of the section parsers), one
# block per part; names exercise cleaning, comma expansion, overlay and cross-references.
FIXTURE_SQL["fx_params"] = """
WITH p AS (SELECT p_partkey AS unit, p_type AS project, p_size, p_brand,
                  CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM {part}),
own AS (
SELECT unit, project, 'param' AS section, CAST(0 AS INT) AS pos, 'size' AS name,
       'int, default=' || CAST(p_size AS STRING) || '. Number of items'
         || CASE WHEN p_size % 3 = 0 THEN ' , like `brand`' ELSE '' END AS descr FROM p
UNION ALL SELECT unit, project, 'param', CAST(1 AS INT), 'brand', 'str. Brand ' || p_brand || ' ,bounded by lo.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(2 AS INT), 'lo, hi', 'float. Range limits of the size.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(3 AS INT), '(a, b)', 'pair. Two ends.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(4 AS INT), '{{x,y}}_lim', 'float. Axis limits.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(5 AS INT), '**kw', 'dict. Extra options for brand.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(6 AS INT), 'shape (n,)', 'tuple. Output shape.' FROM p
UNION ALL SELECT unit, project, 'param', CAST(7 AS INT), 'opts.verbose', 'bool. Verbose output.' FROM p
UNION ALL SELECT unit, project, 'attr', CAST(8 AS INT), 'price_', 'float. Retail price ' || CAST(cents AS STRING) || ' cents.' FROM p
UNION ALL SELECT unit, project, 'attr', CAST(9 AS INT), 'size', 'int. Size set from the `brand` table.' FROM p WHERE unit % 4 = 0),
mirror AS (
SELECT unit, 'MIRROR' AS project, 'param' AS section, CAST(0 AS INT) AS pos, 'alpha' AS name,
       'int. ' || CASE WHEN p_size % 2 = 0 THEN 'Less than gamma.' ELSE 'Free.' END AS descr FROM p WHERE unit % 3 = 0
UNION ALL SELECT unit, 'MIRROR', 'param', CAST(1 AS INT), 'gamma', 'float. Upper limit, not the size.' FROM p WHERE unit % 3 = 0
UNION ALL SELECT unit, 'MIRROR', 'param', CAST(2 AS INT), repeat('a, ', 1200) || 'last', 'Many aliases of one entry.' FROM p WHERE unit = 3
UNION ALL SELECT unit, 'MIRROR', 'param', CAST(3 AS INT), 'last', 'A later entry.' FROM p WHERE unit = 3),
members AS (
SELECT unit, project, 'resize' AS member, 'param' AS section, CAST(0 AS INT) AS pos, 'factor' AS name,
       'float. Scales ' || CASE WHEN p_size % 2 = 0 THEN 'like `by` does.' ELSE 'all.' END AS descr FROM p WHERE unit % 2 = 0
UNION ALL SELECT unit, project, 'resize', 'param', CAST(1 AS INT), 'by', 'str. Unit of the factor.' FROM p WHERE unit % 2 = 0 AND p_size % 5 <> 0
UNION ALL SELECT unit, project, 'price', 'param', CAST(0 AS INT), 'cents', 'int. No other name.' FROM p WHERE unit % 5 = 0)
SELECT project, unit, '' AS member, section, pos, name, descr FROM own
UNION ALL SELECT project, unit, '', section, pos, name, descr FROM mirror
UNION ALL SELECT project, unit, member, section, pos, name, descr FROM members
"""

# fx_signatures: declared parameters of every part's constructor, of the mirrored units and of
# the members.
FIXTURE_SQL["fx_signatures"] = """
SELECT p_type AS project, p_partkey AS unit, '' AS member,
  split('self,size' || CASE WHEN p_size % 5 = 0 THEN '' ELSE ',brand' END || ',lo,hi,*args'
        || CASE WHEN p_size % 7 = 0 THEN ',extra' ELSE '' END
        || CASE WHEN p_partkey % 11 = 0 THEN ',cls' ELSE '' END, ',') AS params
FROM {part}
UNION ALL SELECT 'MIRROR', p_partkey, '', split('self,alpha,gamma' || CASE WHEN p_size % 4 = 0 THEN ',delta' ELSE '' END, ',')
FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_type, p_partkey, 'resize', split('self,factor,by', ',') FROM {part} WHERE p_partkey % 2 = 0
"""

# fx_edges: decision trees: region -> nation -> supplier, rooted at each region.
FIXTURE_SQL["fx_edges"] = """
SELECT 'r' || CAST(n_regionkey AS STRING) AS unit, 'r' || CAST(n_regionkey AS STRING) AS parent,
       'n' || CAST(n_nationkey AS STRING) AS child, CAST(n_nationkey % 2 AS INT) AS label
FROM {nation}
UNION ALL
SELECT 'r' || CAST(n.n_regionkey AS STRING), 'n' || CAST(s.s_nationkey AS STRING),
       's' || CAST(s.s_suppkey AS STRING), CAST(s.s_suppkey % 2 AS INT)
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""

# fx_rule_text: annotated answers, one per supplier, in the shapes a rule can come in.
FIXTURE_SQL["fx_rule_text"] = """
SELECT s_suppkey AS unit, replace(CASE s_suppkey % 5
  WHEN 0 THEN '1. Text Constraint: x needs y.' || chr(10) || 'Logical Format: (nation = `' || CAST(s_nationkey AS STRING) || '`) -> (acct != `None`).*'
  WHEN 1 THEN 'Logical format:' || chr(10) || '```(size > ' || CAST(s_nationkey AS STRING) || ') -> (brand = `b`)```' || chr(10) || 'done'
  WHEN 2 THEN 'Logical Format:' || chr(10) || '```' || chr(10) || '(key = ' || CAST(s_suppkey AS STRING) || ') -> (nation != `x`)`.' || chr(10) || '```'
  WHEN 3 THEN 'Logical Format: (a = 1) and nothing follows'
  ELSE 'Intro' || chr(10) || 'Logical format: **(q = `' || s_name || '`) -> (r = 2)**' END, '`', chr(39)) AS text
FROM {supplier}
"""

# fx_cases: benchmark cases (id, class or 'NA', function, rule, oracle) from labelled documents.
FIXTURE_SQL["fx_cases"] = """
SELECT doc_id,
       'c' || CAST(CAST(doc_id % 72 + 1 AS INT) AS STRING) || '-' || CAST(CAST(floor(doc_id / 72) % 3 AS INT) AS STRING) AS id,
       CASE WHEN doc_id % 4 = 0 THEN 'NA' ELSE 'Class' || CAST(doc_id % 72 + 1 AS STRING) END AS class,
       'func' || CAST(CAST(floor(doc_id / 72) % 3 AS INT) AS STRING) AS func,
       'Logical format: (quality = ' || CAST(quality AS STRING) || ') -> (toxic = ' || CAST(toxic AS STRING) || ')' AS constraints,
       CASE WHEN toxic = 0 THEN 'True' ELSE 'False' END AS oracle
FROM {labels}
"""

# doc_style: docstring dialect per project (half numpy 'Parameters', half google 'Args:').
FIXTURE_SQL["doc_style"] = """
SELECT DISTINCT p_type AS project,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'PROMO') THEN 'Parameters' ELSE 'Args:' END AS flag
FROM {part}
"""

# fx_docs: one docstring per part in its project's dialect; the numpy form uses underlined
# headers, the google form indented keys; both carry a Returns section whose keyed line
# must be ignored, and every 4th part documents ``size`` again as an attribute.
FIXTURE_SQL["fx_docs"] = """
WITH p AS (
  SELECT p.p_partkey AS unit, p.p_type AS project, s.flag, p.p_name, p.p_brand,
         CAST(p.p_size AS STRING) AS sz, CAST(round(p.p_retailprice * 100) AS BIGINT) AS cents,
         p.p_size % 3 = 0 AS mention, p.p_partkey % 4 = 0 AS dup
  FROM {part} p JOIN {doc_style} s ON p.p_type = s.project)
SELECT unit, project, flag, replace(CASE WHEN flag = 'Parameters' THEN
     p_name || ' made by ' || p_brand || '.' || '~' || '~' || 'Parameters~----------'
  || '~size : int, default=' || sz || '~    Number of items' || CASE WHEN mention THEN ' ,like `brand`' ELSE '' END
  || '~brand : str~    Brand name ,bounded by lo.'
  || '~    Note: brands repeat.'
  || '~lo, hi : float~    Range limits of the size.'
  || '~(a, b) : pair~    Two ends.'
  || '~{{x,y}}_lim : float~    Axis limits.'
  || '~**kw : dict~    Extra options.'
  || '~~Attributes~----------~price_ : float~    Retail price ' || CAST(cents AS STRING) || ' cents.'
  || CASE WHEN dup THEN '~size : int~    Size set from the `brand` table.' ELSE '' END
  || '~~Returns~-------~out : ndarray~    The result.'
  ELSE
     p_name || ' made by ' || p_brand || '.~~Args:'
  || '~    size: int, default=' || sz || '~        Number of items' || CASE WHEN mention THEN ' ,like `brand`' ELSE '' END
  || '~    brand: str~        Brand name ,bounded by lo.'
  || '~        Note: brands repeat.'
  || '~    lo, hi: float~        Range limits of the size.'
  || '~    (a, b): pair~        Two ends.'
  || '~    {{x,y}}_lim: float~        Axis limits.'
  || '~    **kw: dict~        Extra options.'
  || '~Attributes:~    price_: float~        Retail price ' || CAST(cents AS STRING) || ' cents.'
  || CASE WHEN dup THEN '~    size: int~        Size set from the `brand` table.' ELSE '' END
  || '~Returns:~    out: ndarray~Raises:~    ValueError: on bad input.~    out2: never parsed'
  END, '~', chr(10)) AS docstring
FROM p
"""

# fx_sources: one source file per part (project = p_type): a class with a docstring (some of its
# lines begin like headers), an __init__ over several lines with brackets nested in its defaults and
# in comments, a decorated member with a docstring, a plain member, an async member holding a
# nested function, a string that holds a class, and an independent function with a nested helper.
# Every 10th file has a '{' in its name (such files are never scanned).
FIXTURE_SQL["fx_sources"] = """
SELECT p_type AS project,
  '/' || p_type || '/part_' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 10 = 0 THEN '{{x}}' ELSE '' END || '.py' AS path,
  replace(replace(
     'class Part' || CAST(p_partkey AS STRING) || ':~'
  || '    QQQ' || p_name || ' made by ' || p_brand || '.~'
  || CASE WHEN p_size % 3 <> 0 THEN '~    Parameters~    ----------~    size : int~        Number of items.~' ELSE '' END
  || '    class of its own (unclosed:~    def prose(not, code):~    QQQ~~'
  || '    def __init__(~            self, size,  # first ( of two~            brand=pick((1, (2, (3, [4, 5])), lo2), hi2),~'
  || '            *args, lo=(0, 1),~            name="a, b=(", **kw):~        self.size = size~~'
  || '    @property~    def price(self):~        QQQRetail price.~~        Parameters~        ----------~        cents : int~            Price in cents.~        QQQ~'
  || '        return ' || CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING) || '~~'
  || '    def resize(self, factor: float = 1.0):~        return self.size * factor~~'
  || '    async def fetch(self):~        def inner(x):~            return x~        return inner(1)~~~'
  || 'NOTE = QQQ~class Fake:~    def fake(self, never):~        QQQ~~'
  || 'def helper_' || CAST(p_partkey AS STRING) || '(a, b=2, *, c):~'
  || CASE WHEN p_size % 2 = 0 THEN '    QQQHelper.~~    Parameters~    ----------~    a : int~        First.~    QQQ~'
          ELSE '    QQQHelper without sections.QQQ~' END
  || '    def nested(d):~        return d~    return nested(a) + b~', '~', chr(10)), 'QQQ', chr(34) || chr(34) || chr(34)) AS content
FROM {part}
"""

# fx_logic_paths, fx_logic_rules: per order five paths with OR, NOT and comparisons of two variables,
# and one rule; <q> and <d> are small constants of the order.
LOGIC_PATHS = (
    "(a = <q>) || (b = <d>) -> ~(c = 0)~",
    "!(a < <q>) -> (b <= c) -> ~(c = <d>)~",
    "(a < b) -> (b < c) -> ~(c = <q>)~",
    "!(a = <q> || b > <d>) -> ~(c != 1)~",
    "((a > <q>) || (b < <d>)) && (c = 1) -> ~(a != 2)~",
)
LOGIC_RULES = (
    "(a = <q>) -> (b > <d>)",
    "(a >= b) -> (c < a)",
    "(b < 2) || (c >= <d>) -> (a = 1)",
    "!(c = <d>) -> (a > c)",
)
_FILL = "replace(replace(replace({0}, '<q>', CAST(o_custkey % 5 AS STRING)), '<d>', CAST(o_orderkey % 4 AS STRING)), '~', chr(34))"
FIXTURE_SQL["fx_logic_paths"] = " UNION ALL ".join(
    f"SELECT o_orderkey AS unit, CAST({i} AS INT) AS path_no, " + _FILL.format(f"'{t}'") + " AS text FROM {orders}" for i, t in enumerate(LOGIC_PATHS))
FIXTURE_SQL["fx_logic_rules"] = ("SELECT o_orderkey AS unit, o_orderkey AS rule_id, "
                                 + _FILL.format(_case("CAST(o_orderkey % 4 AS INT)", LOGIC_RULES)) + " AS text FROM {orders}")
