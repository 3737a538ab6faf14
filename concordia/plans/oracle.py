"""DuckDB oracle SQL for the audit operators.

Each oracle is an independent formulation of the operator in plain SQL over the same
fixture relations (``concordia.sources.fixtures``), so a Spark result can be checked
row for row.  Where the Spark plan is clever, the oracle is blunt on purpose:
satisfiability is decided by testing candidate points (every constant of a variable,
just above and below it, and a fresh string), not by interval summaries; the
similarity fold is max-over-clauses of min-over-literals; the DNF is read from the
rule's top-level items.  Oracle limits (documented): rule texts without call
values, skeletons whose groups are flat and single-operator, unnested negation.
"""
from __future__ import annotations

from concordia.functions import vocab
from concordia.functions.exprs import LITERAL_RE, op_cosine_table
from concordia.sources.fixtures import duckdb_ctes


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


LIT = q(LITERAL_RE)


def norm_sql(col: str) -> str:
    t = f"regexp_replace({col}, {q(chr(91) + chr(34) + chr(39) + ']' + '(None|False|True)' + '[' + chr(34) + chr(39) + ']')}, '\\1', 'g')"
    for w in ("None", "False", "True"):
        t = f"replace({t}, '{w}', '''{w}''')"
    return t


def words_any_sql(text: str, words) -> str:
    arr = "[" + ", ".join(q("'" + w.lower() + "'") for w in words) + "]"
    return f"len(list_filter({arr}, lambda w: contains(lower({text}), w))) > 0"


def screen_sql(text: str = "text") -> str:
    return (f"CASE WHEN NOT contains({text}, '->') THEN 'no_arrow' "
            f"WHEN {words_any_sql(text, vocab.UNSOLVED_WORDS)} THEN 'unsolvable' "
            f"WHEN {words_any_sql(text, vocab.FUZZY_NONEXISTENCE + vocab.FUZZY_EXISTENCE)} THEN 'fuzzy' "
            f"ELSE 'crisp' END")


def literals_ctes(name: str, src: str, keys: list[str], text: str, pos: str = "slot") -> str:
    """CTEs ``{name}_g`` .. ``{name}``: literals of ``src.text`` with keys and ``pos``."""
    k = ", ".join(keys)
    return f"""
{name}_g AS (
  SELECT {k}, regexp_extract_all(nt, {LIT}, 1) AS g1, regexp_extract_all(nt, {LIT}, 2) AS g2,
         regexp_extract_all(nt, {LIT}, 3) AS g3, regexp_extract_all(nt, {LIT}, 4) AS g4
  FROM (SELECT {k}, {norm_sql(text)} AS nt FROM {src})),
{name}_i AS (SELECT {k}, g1, g2, g3, g4, unnest(generate_series(1, len(g1))) AS i FROM {name}_g),
{name}_x AS (
  SELECT {k}, CAST(i - 1 AS INTEGER) AS {pos}, g1[i] AS a, g2[i] AS o,
         coalesce(g3[i], '') AS qv, coalesce(g4[i], '') AS b FROM {name}_i),
{name} AS (
  SELECT {k}, {pos},
    CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN b ELSE a END AS var,
    CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN
      (CASE o WHEN '>' THEN '<' WHEN '<' THEN '>' WHEN '>=' THEN '<=' WHEN '<=' THEN '>=' END)
      ELSE o END AS op,
    CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN ''
         WHEN b <> '' AND try_cast(b AS DOUBLE) IS NULL THEN b ELSE qv END AS sval,
    CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL THEN a
         WHEN b <> '' AND try_cast(b AS DOUBLE) IS NULL THEN '' ELSE b END AS nval,
    CASE WHEN try_cast(a AS DOUBLE) IS NOT NULL AND o IN ('=', '!=') THEN 'numeric_left_equality' END AS lit_error
  FROM {name}_x)"""


def typed_select(alias: str = "") -> str:
    p = alias + "." if alias else ""
    opaque = " OR ".join(f"starts_with({p}var, '{x}')" for x in vocab.OPAQUE_PREFIXES)
    sort = (f"CASE WHEN {opaque} THEN 'B' "
            f"WHEN {p}op IN ('=', '!=') THEN (CASE WHEN {p}sval <> '' THEN "
            f"(CASE WHEN {p}sval IN ('True', 'False') THEN 'R' ELSE 'S' END) "
            f"WHEN {p}nval <> '' THEN 'R' ELSE 'E' END) "
            f"WHEN {p}nval <> '' THEN 'R' WHEN {p}sval <> '' THEN 'V' ELSE 'E' END")
    return (f"{sort} AS sort, "
            f"CASE WHEN {p}op IN ('=', '!=') AND {p}sval = 'True' THEN (CASE {p}op WHEN '=' THEN '!=' ELSE '=' END) "
            f"ELSE {p}op END AS rop, "
            f"CASE WHEN {p}op IN ('=', '!=') AND {p}sval IN ('True', 'False') THEN 0.0::DOUBLE "
            f"WHEN ({sort}) = 'R' THEN try_cast({p}nval AS DOUBLE) + 0.0::DOUBLE END AS num, "
            f"CASE WHEN ({sort}) = 'S' THEN {p}sval END AS sv")


def skeleton_select(nt: str) -> str:
    """logic (indexed skeleton) and n_slots from a normalised rule text."""
    tpl = f"regexp_replace({nt}, {LIT}, '{{}}', 'g')"
    s1 = f"replace(replace({tpl}, ' ', ''), '!(', '[')"
    s2 = f"regexp_replace({s1}, '\\[([^)]*)\\)', '[\\1]', 'g')"
    s3 = f"replace(replace(replace(replace({s2}, '({{}})', '{{}}'), '->', '^'), '||', '|'), '&&', '^')"
    s4 = f"array_to_string(list_filter(string_split({s3}, '^'), lambda f: NOT regexp_matches(f, '[A-Za-z0-9]')), '^')"
    return (f"string_split({s4}, '{{}}') AS sk_parts, "
            f"CAST((length({tpl}) - length(replace({tpl}, '{{}}', ''))) / 2 AS INTEGER) AS n_slots")


ITEM_DNF = """(CASE WHEN starts_with(t, '(') THEN
     (CASE WHEN contains(t, '|') THEN list_transform(regexp_extract_all(t, '\\{([0-9]+)\\}', 1), lambda s: [CAST(s AS INTEGER) + 1])
           ELSE [list_transform(regexp_extract_all(t, '\\{([0-9]+)\\}', 1), lambda s: CAST(s AS INTEGER) + 1)] END)
   WHEN starts_with(t, '[') THEN [[-(CAST(regexp_extract(t, '([0-9]+)', 1) AS INTEGER) + 1)]]
   ELSE [[CAST(regexp_extract(t, '([0-9]+)', 1) AS INTEGER) + 1]] END)"""


def dnf_ctes(name: str, src: str, keys: list[str]) -> str:
    """``{name}``: keys, logic, n_slots, dnf (list of signed-slot lists; null if unreadable)."""
    k = ", ".join(keys)
    tok = "'\\([^()]*\\)|\\[\\{[0-9]+\\}\\]|\\{[0-9]+\\}|\\^|\\|'"
    item = lambda expr: ITEM_DNF.replace("t,", f"{expr},").replace("(t)", f"({expr})")
    return f"""
{name}_a AS (
  SELECT {k}, n_slots, array_to_string(list_transform(generate_series(1, len(sk_parts)),
      lambda i: CASE WHEN i < len(sk_parts) THEN sk_parts[i] || '{{' || CAST(i - 1 AS VARCHAR) || '}}' ELSE sk_parts[i] END), '') AS logic
  FROM {src}),
{name}_b AS (
  SELECT {k}, n_slots, logic, regexp_extract_all(logic, {tok}, 0) AS toks FROM {name}_a),
{name}_c AS (
  SELECT {k}, n_slots, logic, toks,
         list_filter(toks, lambda x, i: i % 2 = 1) AS items, list_filter(toks, lambda x, i: i % 2 = 0) AS ops
  FROM {name}_b),
{name} AS (
  SELECT {k}, n_slots, logic,
    CASE WHEN n_slots >= 1 AND array_to_string(toks, '') = logic AND len(items) = len(ops) + 1 THEN
      list_reduce(
        list_reverse(list_transform(generate_series(1, len(items) - 1),
          lambda j: {{'d': {item('items[j]')}, 'op': ops[j]}})),
        lambda acc, x: CASE WHEN x.op = '^'
            THEN flatten(list_transform(x.d, lambda a: list_transform(acc, lambda b: list_concat(a, b))))
            ELSE list_concat(x.d, acc) END,
        {item('items[len(items)]')})
    END AS dnf
  FROM {name}_c)"""


def pyround2_sql(v: str) -> str:
    k = f"floor({v} * 100)"
    scaled = f"CAST(CAST({v} * CAST(4611686018427387904 AS DOUBLE) AS BIGINT) AS HUGEINT) * 100"
    mid = f"CAST(2 * {k} + 1 AS HUGEINT) * CAST(2305843009213693952 AS HUGEINT)"
    return (f"(CASE WHEN {v} < 0.001 THEN 0.0::DOUBLE ELSE CAST({k} + (CASE WHEN {scaled} > {mid} THEN 1 "
            f"WHEN {scaled} < {mid} THEN 0 ELSE CAST({k} AS BIGINT) % 2 END) AS DOUBLE) / 100.0 END)")


def nlev_sql(a: str, b: str) -> str:
    m = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {m} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b}) / {m} END)"


def opcos_values() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)}, CAST({q(repr(v))} AS DOUBLE))" for (a, b), v in op_cosine_table().items())
    return f"opcos(o1, o2, c) AS (VALUES {rows})"


def audit_with(final: str) -> str:
    """The audit's CTE chain followed by ``final`` (a SELECT over any of its CTEs)."""
    return _audit_ctes() + "\n" + final


def _audit_ctes() -> str:
    exist_re = "([A-Za-z0-9_]+)\\s*(?:=|!=)\\s*['\"](?:" + "|".join(vocab.FUZZY_EXISTENCE) + ")['\"]"
    nonexist_re = "([A-Za-z0-9_]+)\\s*(?:=|!=)\\s*['\"](?:" + "|".join(vocab.FUZZY_NONEXISTENCE) + ")['\"]"
    return f"""
WITH {duckdb_ctes('fx_rules', 'fx_paths', 'fx_unit_sources')},
{opcos_values()},
scr AS (SELECT unit, rule_id, text, {screen_sql('text')} AS screen FROM fx_rules),
live AS (
  SELECT unit, rule_id, screen,
         CASE WHEN screen = 'fuzzy' THEN split_part(text, '->', 1) ELSE text END AS ctext,
         CASE WHEN screen = 'fuzzy' THEN split_part(text, '->', 2) END AS rtext
  FROM scr WHERE screen IN ('crisp', 'fuzzy')),
{literals_ctes('rl0', 'live', ['unit', 'rule_id'], 'ctext', 'slot')},
rl AS (SELECT *, {typed_select()} FROM rl0),
{literals_ctes('rr', "(SELECT * FROM live WHERE screen = 'fuzzy')", ['unit', 'rule_id'], 'rtext', 'slot')},
sk0 AS (SELECT unit, rule_id, {skeleton_select(norm_sql('ctext'))} FROM live),
{dnf_ctes('sk', 'sk0', ['unit', 'rule_id'])},
fz AS (
  SELECT unit, rule_id,
    CASE WHEN {words_any_sql('rtext', vocab.FUZZY_EXISTENCE)} THEN regexp_extract_all(rtext, {q(exist_re)}, 1)
         WHEN {words_any_sql('rtext', vocab.FUZZY_NONEXISTENCE)} THEN regexp_extract_all(rtext, {q(nonexist_re)}, 1)
         ELSE [] END AS vars,
    CASE WHEN {words_any_sql('rtext', vocab.FUZZY_EXISTENCE)} THEN NOT contains(rtext, '!=')
         WHEN {words_any_sql('rtext', vocab.FUZZY_NONEXISTENCE)} THEN contains(rtext, '!=') END AS exist_flag
  FROM live WHERE screen = 'fuzzy'),
-- paths
pp AS (
  SELECT unit, path_no, line, replace(line, ' ', '') AS nb FROM (SELECT unit, path_no, trim(text) AS line FROM fx_paths)),
pq AS (
  SELECT unit, path_no, line,
    CASE WHEN contains(nb, '->') THEN regexp_extract(nb, '.*->(.*)$', 1) ELSE substr(nb, 2) END AS last,
    CASE WHEN contains(nb, '->') THEN regexp_extract(nb, '^(.*)->', 1) ELSE substr(nb, 1, length(nb) - 1) END AS cond
  FROM pp),
pinfo0 AS (
  SELECT unit, path_no, line,
    CASE WHEN contains(last, '_END') THEN 'error' ELSE 'normal' END AS kind,
    CASE WHEN contains(last, '_END') THEN
      list_transform(list_filter(string_split(trim(last, ''' '), ')_'), lambda x: contains(x, '(')), lambda x: trim(x, '()'))
      ELSE [] END AS error_params,
    CASE WHEN contains(last, '_END') THEN cond ELSE cond || '->' || trim(last, '" ' || chr(10)) END AS conditions
  FROM pq),
{literals_ctes('pl0', 'pinfo0', ['unit', 'path_no'], 'conditions', 'pos')},
pl AS (SELECT l.*, {typed_select('l')}, list_contains(i.error_params, l.var) AS in_error
       FROM pl0 l JOIN pinfo0 i USING (unit, path_no)),
pinfo AS (
  SELECT i.unit, i.path_no, i.line, i.kind,
    coalesce(list_distinct(list(l.var)), []) AS pnames,
    coalesce(list_distinct(list(l.var) FILTER (WHERE l.in_error)), []) AS err_names,
    coalesce(bool_or(l.sort = 'E' OR l.lit_error IS NOT NULL), false) AS path_error
  FROM pinfo0 i LEFT JOIN pl l USING (unit, path_no)
  GROUP BY i.unit, i.path_no, i.line, i.kind),
bad_units AS (SELECT DISTINCT unit FROM pinfo WHERE path_error),
-- best match of crisp literals
crl AS (SELECT l.* FROM rl l JOIN live v USING (unit, rule_id) WHERE v.screen = 'crisp'),
cands AS (SELECT unit, var, op, sval, nval, min(CAST(path_no AS BIGINT) * 1048576 + pos) AS first FROM pl GROUP BY ALL),
scored AS (
  SELECT r.unit, r.rule_id, r.slot, c.var AS m_var, c.op AS m_op, c.sval AS m_sval, c.nval AS m_nval, c.first,
    {pyround2_sql(f"(0.25::DOUBLE * {nlev_sql('r.var', 'c.var')} + 0.5::DOUBLE * o.c + 0.25::DOUBLE * {nlev_sql(q_val('r'), q_val('c'))})")} AS sim
  FROM crl r JOIN cands c USING (unit) JOIN opcos o ON o.o1 = r.op AND o.o2 = c.op
  WHERE NOT (r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit, rule_id, slot ORDER BY sim DESC, first) AS rn
                 FROM scored WHERE sim > 0) WHERE rn = 1),
mt AS (
  SELECT r.unit, r.rule_id, r.slot,
    CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(b.sim, 0.0::DOUBLE) END AS sim,
    CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.var ELSE b.m_var END AS var,
    CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.op
         WHEN r.sval IN ('True', 'False', 'None') THEN r.op ELSE b.m_op END AS op,
    CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.sval
         WHEN r.sval IN ('True', 'False', 'None') THEN r.sval ELSE b.m_sval END AS sval,
    CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.nval
         WHEN r.sval IN ('True', 'False', 'None') THEN r.nval ELSE b.m_nval END AS nval
  FROM crl r LEFT JOIN best b USING (unit, rule_id, slot)),
wt AS (SELECT *, {typed_select()} FROM mt WHERE var IS NOT NULL),
clauses AS (
  SELECT unit, rule_id, CAST(ci - 1 AS INTEGER) AS clause_id, dnf[ci] AS lits
  FROM (SELECT unit, rule_id, dnf, unnest(generate_series(1, len(dnf))) AS ci FROM sk WHERE dnf IS NOT NULL)),
clause_slots AS (
  SELECT unit, rule_id, clause_id, abs(v) - 1 AS slot, v < 0 AS negated
  FROM (SELECT unit, rule_id, clause_id, unnest(lits) AS v FROM clauses)),
simfold AS (
  SELECT unit, rule_id, max(m) AS similarity FROM (
    SELECT s.unit, s.rule_id, s.clause_id,
           min(CASE WHEN s.negated THEN m.sim * 0.85::DOUBLE ELSE m.sim END) AS m
    FROM clause_slots s JOIN mt m USING (unit, rule_id, slot) GROUP BY ALL) GROUP BY ALL),
-- per-rule state
lf AS (
  SELECT unit, rule_id, bool_or(lit_error IS NOT NULL) AS lit_err, bool_or(sort = 'E') AS empty_val,
    bool_or({' OR '.join(f"contains(var, {q(c)}) OR contains(sval, {q(c)})" for c in vocab.SYMBOL_CHARS)}) AS symbols,
    list_distinct(list(var)) AS l_names
  FROM rl GROUP BY ALL),
mf AS (SELECT unit, rule_id, bool_and(sim > 0) AS all_matched FROM mt GROUP BY ALL),
wf AS (
  SELECT unit, rule_id, list_distinct(list(var)) AS w_names,
    coalesce(list_distinct(list(sval) FILTER (WHERE sval <> '')), []) AS svals,
    bool_or(sort = 'E') AS w_empty
  FROM wt GROUP BY ALL),
rn AS (SELECT unit, rule_id, list_distinct(list(var)) AS r_names FROM rr GROUP BY ALL),
st0 AS (
  SELECT v.unit, v.rule_id, v.screen, sk.n_slots, sk.dnf, lf.lit_err, lf.empty_val, lf.symbols,
    mf.all_matched, sf.similarity, wf.svals, wf.w_empty, fz.vars, fz.exist_flag,
    CASE WHEN v.screen = 'crisp' THEN wf.w_names
         ELSE list_distinct(list_concat(coalesce(lf.l_names, []), coalesce(rn.r_names, []))) END AS names,
    b.unit IS NOT NULL AS unit_path_error
  FROM live v LEFT JOIN sk USING (unit, rule_id) LEFT JOIN lf USING (unit, rule_id)
  LEFT JOIN mf USING (unit, rule_id) LEFT JOIN simfold sf USING (unit, rule_id) LEFT JOIN wf USING (unit, rule_id)
  LEFT JOIN fz USING (unit, rule_id) LEFT JOIN rn USING (unit, rule_id) LEFT JOIN bad_units b USING (unit)),
insrc AS (
  SELECT unit, rule_id, bool_and(found) AS in_source FROM (
    SELECT n.unit, n.rule_id, n.name, coalesce(bool_or(contains(p.text, n.name)), false) AS found
    FROM (SELECT unit, rule_id, unnest(names) AS name FROM st0 WHERE names IS NOT NULL) n
    LEFT JOIN fx_unit_sources p USING (unit) GROUP BY ALL) GROUP BY ALL),
st AS (
  SELECT s.* EXCLUDE (similarity),
    CASE WHEN coalesce(s.all_matched, false) AND s.n_slots > 1 THEN s.similarity END AS similarity,
    coalesce(i.in_source, false) AS in_source,
    CASE WHEN s.screen = 'crisp' THEN (CASE
        WHEN coalesce(s.lit_err, false) AND s.n_slots > 1 THEN 'quarantine:numeric_left_equality'
        WHEN s.dnf IS NULL AND s.n_slots > 1 THEN 'quarantine:skeleton'
        WHEN coalesce(s.empty_val, false) AND s.n_slots > 1 THEN 'quarantine:empty_value'
        WHEN coalesce(s.symbols, false) THEN 'skip:symbols'
        WHEN s.unit_path_error THEN 'quarantine:path_parse'
        WHEN NOT coalesce(s.all_matched, false) AND s.n_slots > 0 THEN 'quarantine:no_match'
        WHEN s.n_slots <= 1 THEN 'skip:single_literal'
        WHEN s.similarity > 0.85 AND s.similarity < 1 THEN 'skip:similarity_gate'
        WHEN NOT coalesce(i.in_source, false) THEN 'skip:names_absent'
        WHEN coalesce(s.w_empty, false) THEN 'undecided:empty_value' END)
    ELSE (CASE
        WHEN s.exist_flag IS NULL THEN 'quarantine:fuzzy_word_left_only'
        WHEN coalesce(s.lit_err, false) AND s.n_slots > 1 THEN 'quarantine:numeric_left_equality'
        WHEN s.dnf IS NULL THEN 'quarantine:skeleton'
        WHEN coalesce(s.empty_val, false) AND s.n_slots > 1 THEN 'quarantine:empty_value'
        WHEN NOT coalesce(i.in_source, false) THEN 'skip:names_absent' END) END AS reason
  FROM st0 s LEFT JOIN insrc i USING (unit, rule_id)),
ready AS (SELECT * FROM st WHERE reason IS NULL),
-- satisfiability by candidate points
chk AS (
  SELECT w.unit, w.rule_id, w.slot, w.var, w.sort, w.rop, w.num, w.sv FROM wt w
    JOIN ready r USING (unit, rule_id) WHERE r.screen = 'crisp'
  UNION ALL
  SELECT l.unit, l.rule_id, l.slot, l.var, l.sort, l.rop, l.num, l.sv FROM rl l
    JOIN ready r USING (unit, rule_id) WHERE r.screen = 'fuzzy'),
rcl AS (SELECT c.unit, c.rule_id, c.clause_id FROM clauses c JOIN ready r USING (unit, rule_id)),
clit AS (
  SELECT s.unit, s.rule_id, s.clause_id, k.var, k.sort,
    CASE WHEN s.negated THEN (CASE k.rop WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '<' THEN '>=' WHEN '>=' THEN '<'
                                         WHEN '>' THEN '<=' WHEN '<=' THEN '>' END) ELSE k.rop END AS rop,
    k.num, k.sv, (k.sort = 'B' AND s.negated) AS falsum
  FROM clause_slots s JOIN chk k USING (unit, rule_id, slot) JOIN rcl USING (unit, rule_id, clause_id)),
pscope AS (
  SELECT unit, path_no, 'full' AS scope, var, sort, rop, num, sv FROM pl
  UNION ALL SELECT unit, path_no, 'err', var, sort, rop, num, sv FROM pl WHERE in_error),
scopes AS (SELECT DISTINCT unit, path_no, 'full' AS scope FROM pinfo
           UNION ALL SELECT DISTINCT unit, path_no, 'err' FROM pl WHERE in_error),
pairs AS (SELECT c.unit, c.rule_id, c.clause_id, s.path_no, s.scope FROM rcl c JOIN scopes s USING (unit)),
u AS (
  SELECT p.unit, p.rule_id, p.clause_id, p.path_no, p.scope, l.var, l.sort, l.rop, l.num, l.sv, l.falsum
  FROM pairs p JOIN clit l USING (unit, rule_id, clause_id) WHERE l.sort IN ('S', 'R', 'B')
  UNION ALL
  SELECT p.unit, p.rule_id, p.clause_id, p.path_no, p.scope, l.var, l.sort, l.rop, l.num, l.sv, false
  FROM pairs p JOIN pscope l USING (unit, path_no, scope) WHERE l.sort IN ('S', 'R', 'B')),
cand AS (
  SELECT DISTINCT unit, rule_id, clause_id, path_no, scope, var, sort, x, xs FROM (
    SELECT unit, rule_id, clause_id, path_no, scope, var, sort, num + d AS x, NULL AS xs
      FROM u, (VALUES (-0.000001::DOUBLE), (0.0::DOUBLE), (0.000001::DOUBLE)) e(d) WHERE sort = 'R'
    UNION ALL SELECT unit, rule_id, clause_id, path_no, scope, var, sort, NULL, sv FROM u WHERE sort = 'S'
    UNION ALL SELECT unit, rule_id, clause_id, path_no, scope, var, sort, NULL, chr(1) || 'fresh' FROM u WHERE sort = 'S'
    UNION ALL SELECT unit, rule_id, clause_id, path_no, scope, var, sort, NULL, NULL FROM u WHERE sort = 'B')),
holds AS (
  SELECT c.unit, c.rule_id, c.clause_id, c.path_no, c.scope, c.var, c.sort, c.x, c.xs,
    bool_and(CASE
      WHEN u.sort = 'B' THEN NOT u.falsum
      WHEN u.sort = 'S' THEN (CASE u.rop WHEN '=' THEN c.xs = u.sv ELSE c.xs <> u.sv END)
      ELSE (CASE u.rop WHEN '=' THEN c.x = u.num WHEN '!=' THEN c.x <> u.num WHEN '<' THEN c.x < u.num
                       WHEN '<=' THEN c.x <= u.num WHEN '>' THEN c.x > u.num ELSE c.x >= u.num END) END) AS ok
  FROM cand c JOIN u USING (unit, rule_id, clause_id, path_no, scope, var, sort)
  GROUP BY ALL),
grp AS (SELECT unit, rule_id, clause_id, path_no, scope, var, sort, bool_or(ok) AS ok FROM holds GROUP BY ALL),
clause_sat AS (
  SELECT p.unit, p.rule_id, p.clause_id, p.path_no, p.scope, coalesce(bool_and(g.ok), true) AS ok
  FROM pairs p LEFT JOIN grp g USING (unit, rule_id, clause_id, path_no, scope) GROUP BY ALL),
sat AS (
  SELECT unit, rule_id, path_no,
    coalesce(bool_or(ok) FILTER (WHERE scope = 'full'), false) AS sat_full,
    coalesce(bool_or(ok) FILTER (WHERE scope = 'err'), false) AS sat_err
  FROM clause_sat GROUP BY ALL),
res AS (
  SELECT r.unit, r.rule_id, r.screen, p.path_no, p.line, p.kind, p.path_error,
    len(list_filter(r.names, lambda n: NOT list_contains(p.pnames, n))) = 0 AS covered,
    len(list_filter(r.names, lambda n: NOT list_contains(p.err_names, n))) = 0 AS err_cover,
    len(list_filter(coalesce(r.svals, []), lambda v: NOT contains(p.line, v))) = 0 AS values_in,
    len(list_filter(r.names, lambda n: NOT contains(p.line, n))) = 0 AS text_cover,
    coalesce(r.vars, []) AS vars, r.exist_flag,
    trim(substr(p.line, 1, greatest(length(p.line) - length(regexp_extract(p.line, '.*->(.*)$', 1)) - 2, 0))) AS lp,
    trim(substr(p.line, length(p.line) - length(regexp_extract(p.line, '.*->(.*)$', 1)) - 1)) AS rp,
    coalesce(s.sat_full, false) AS sat_full, coalesce(s.sat_err, false) AS sat_err
  FROM ready r JOIN pinfo p USING (unit) LEFT JOIN sat s USING (unit, rule_id, path_no)),
res2 AS (
  SELECT unit, rule_id, screen, path_no, kind,
    CASE WHEN screen = 'crisp' THEN (CASE
        WHEN path_error THEN true WHEN NOT covered THEN false
        WHEN kind = 'error' THEN (CASE WHEN err_cover AND values_in THEN NOT sat_full END)
        ELSE sat_full END)
    ELSE (CASE WHEN NOT text_cover THEN NULL WHEN path_error THEN true WHEN NOT covered THEN false
        ELSE sat_full AND (CASE WHEN exist_flag THEN
            len(list_filter(vars, lambda v: NOT contains(lp, '(' || v || ' = ''existence_flag'''))) = 0
            OR len(list_filter(vars, lambda v: NOT contains(rp, '(' || v || ' = ''existence_flag'''))) = 0
            OR len(list_filter(vars, lambda v: NOT (contains(rp, '(' || v) AND NOT contains(rp, '(' || v || ' = 0')))) = 0
          ELSE
            len(list_filter(vars, lambda v: NOT contains(lp, '(' || v || ' != ''existence_flag'''))) = 0
            OR len(list_filter(vars, lambda v: contains(rp, '(' || v || ' = ''existence_flag'''))) = 0
            OR len(list_filter(vars, lambda v: NOT (NOT contains(rp, '(' || v) OR contains(rp, '(' || v || ' = 0')))) = 0
          END) END) END AS result,
    screen = 'crisp' AND NOT path_error AND covered AND kind = 'error' AND err_cover AND values_in AND sat_err AS hit
  FROM res),
vd AS (
  SELECT unit, rule_id, count(result) AS n_results,
    count(*) FILTER (WHERE result) AS n_true, bool_or(hit) AS hit,
    CASE WHEN bool_or(hit) THEN 'BAD_ERROR'
         WHEN count(result) > 0 AND count(*) FILTER (WHERE result) = 0 THEN
           (CASE WHEN any_value(screen) = 'fuzzy' THEN 'BAD_FUZZY' ELSE 'BAD' END)
         ELSE 'CONSISTENT' END AS verdict
  FROM res2 GROUP BY ALL),
allst AS (
  SELECT unit, rule_id, screen, reason, similarity FROM st
  UNION ALL
  SELECT unit, rule_id, screen, 'skip:' || screen, NULL FROM scr WHERE screen NOT IN ('crisp', 'fuzzy'))
"""



def q_val(alias: str) -> str:
    return f"(CASE WHEN {alias}.sval <> '' THEN {alias}.sval ELSE {alias}.nval END)"


AUDIT_FINAL = """SELECT a.unit, a.rule_id, a.screen,
  CASE WHEN starts_with(a.reason, 'skip:') THEN 'SKIPPED' WHEN starts_with(a.reason, 'quarantine:') THEN 'QUARANTINED'
       WHEN starts_with(a.reason, 'undecided:') THEN 'UNDECIDED' ELSE coalesce(v.verdict, 'CONSISTENT') END AS verdict,
  a.reason,
  CASE WHEN a.screen = 'crisp' THEN CAST(round(a.similarity * 100) AS INTEGER) END AS similarity,
  coalesce(v.n_results, 0) AS n_results, coalesce(v.n_true, 0) AS n_true
FROM allst a LEFT JOIN vd v USING (unit, rule_id)
"""


def audit_sql() -> str:
    """Oracle of the full audit (flagship): one row per rule."""
    return audit_with(AUDIT_FINAL)


def candidate_sat_ctes(p: str, u: str, pairs: str) -> str:
    """Candidate-point satisfiability CTEs ``{p}cand .. {p}clause`` over a literal union
    ``u`` (keys unit, rule_id, clause_id, path_no, scope) and its ``pairs``."""
    k = "unit, rule_id, clause_id, path_no, scope"
    return f"""
{p}cand AS (
  SELECT DISTINCT {k}, var, sort, x, xs FROM (
    SELECT {k}, var, sort, num + d AS x, NULL AS xs
      FROM {u}, (VALUES (-0.000001::DOUBLE), (0.0::DOUBLE), (0.000001::DOUBLE)) e(d) WHERE sort = 'R'
    UNION ALL SELECT {k}, var, sort, NULL, sv FROM {u} WHERE sort = 'S'
    UNION ALL SELECT {k}, var, sort, NULL, chr(1) || 'fresh' FROM {u} WHERE sort = 'S'
    UNION ALL SELECT {k}, var, sort, NULL, NULL FROM {u} WHERE sort = 'B')),
{p}holds AS (
  SELECT c.unit, c.rule_id, c.clause_id, c.path_no, c.scope, c.var, c.sort, c.x, c.xs,
    bool_and(CASE
      WHEN l.sort = 'B' THEN NOT l.falsum
      WHEN l.sort = 'S' THEN (CASE l.rop WHEN '=' THEN c.xs = l.sv ELSE c.xs <> l.sv END)
      ELSE (CASE l.rop WHEN '=' THEN c.x = l.num WHEN '!=' THEN c.x <> l.num WHEN '<' THEN c.x < l.num
                       WHEN '<=' THEN c.x <= l.num WHEN '>' THEN c.x > l.num ELSE c.x >= l.num END) END) AS ok
  FROM {p}cand c JOIN {u} l USING ({k}, var, sort) GROUP BY ALL),
{p}grp AS (SELECT {k}, var, sort, bool_or(ok) AS ok FROM {p}holds GROUP BY ALL),
{p}clause AS (
  SELECT q.unit, q.rule_id, q.clause_id, q.path_no, q.scope, coalesce(bool_and(g.ok), true) AS ok
  FROM {pairs} q LEFT JOIN {p}grp g USING ({k}) GROUP BY ALL)"""


NEG_OP_SQL = ("CASE rop WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '<' THEN '>=' WHEN '>=' THEN '<' "
              "WHEN '>' THEN '<=' WHEN '<=' THEN '>' END")

ENTAILS_SQL = audit_with(f"""
, nscope AS (SELECT unit, path_no, CAST(pos AS VARCHAR) AS scope, var, sort, {NEG_OP_SQL} AS rop, num, sv,
                    sort = 'B' AS falsum FROM pl WHERE sort IN ('S', 'R', 'B')),
crcl AS (SELECT c.unit, c.rule_id, c.clause_id FROM clauses c JOIN ready r USING (unit, rule_id) WHERE r.screen = 'crisp'),
npairs AS (SELECT c.unit, c.rule_id, c.clause_id, s.path_no, s.scope FROM crcl c
           JOIN (SELECT DISTINCT unit, path_no, scope FROM nscope) s USING (unit)),
nu AS (SELECT q.unit, q.rule_id, q.clause_id, q.path_no, q.scope, l.var, l.sort, l.rop, l.num, l.sv, l.falsum
       FROM npairs q JOIN clit l USING (unit, rule_id, clause_id) WHERE l.sort IN ('S', 'R', 'B')
       UNION ALL
       SELECT q.unit, q.rule_id, q.clause_id, q.path_no, q.scope, l.var, l.sort, l.rop, l.num, l.sv, l.falsum
       FROM npairs q JOIN nscope l USING (unit, path_no, scope)),
{candidate_sat_ctes('n', 'nu', 'npairs')},
refuted AS (SELECT DISTINCT unit, rule_id, path_no FROM nclause WHERE ok)
SELECT r.unit, r.rule_id, p.path_no,
  CASE WHEN len(list_filter(r.names, lambda n: NOT list_contains(p.pnames, n))) > 0 THEN true
       WHEN p.kind = 'error' THEN f.unit IS NOT NULL ELSE f.unit IS NULL END AS holds
FROM ready r JOIN pinfo p USING (unit) LEFT JOIN refuted f USING (unit, rule_id, path_no)
WHERE r.screen = 'crisp'""")
