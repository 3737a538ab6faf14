"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables under ``sf_dir``
(directly or through the fixture relations derived from them), so its work grows with
the scale factor."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators import decide, paths as P, rules as R, similarity as L
from concordia.plans import oracle as O
from concordia.plans.audit import KEYS, AuditPlan
from concordia.session import materialize, partitions, spread
from concordia.sources.fixtures import duckdb_ctes, fixture

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _plan(spark: SparkSession, sf_dir: str) -> AuditPlan:
    return AuditPlan(fixture(spark, sf_dir, "fx_rules"), fixture(spark, sf_dir, "fx_paths"), sources=fixture(spark, sf_dir, "fx_unit_sources"))


# ---- flagship ------------------------------------------------------------------------------------
@register("v6_audit_verdicts", O.audit_sql())
def q_audit(spark, sf_dir):
    return _plan(spark, sf_dir).report()


# ---- rule tables (C) ---------------------------------------------------------------------------------
_ALL_LITS = f"WITH {duckdb_ctes('fx_rules')}, {O.literals_ctes('al', 'fx_rules', ['unit', 'rule_id'], 'text', 'slot')}"


@register("c7_screen_rules", O.audit_with("SELECT unit, rule_id, screen FROM scr"))
def q_screen(spark, sf_dir):
    return R.screen_rules(fixture(spark, sf_dir, "fx_rules")).select(*KEYS, "screen")


@register("c1_rule_literals", _ALL_LITS + " SELECT * FROM al")
def q_literals(spark, sf_dir):
    return R.rule_literals(fixture(spark, sf_dir, "fx_rules"))


@register("c3_typed_literals", _ALL_LITS + f" SELECT *, {O.typed_select()} FROM al")
def q_typed(spark, sf_dir):
    return R.typed_literals(R.rule_literals(fixture(spark, sf_dir, "fx_rules")))


_CLAUSES_SQL = f"""WITH {duckdb_ctes('fx_rules')},
k0 AS (SELECT unit, rule_id, {O.skeleton_select(O.norm_sql('text'))} FROM fx_rules),
{O.dnf_ctes('k', 'k0', ['unit', 'rule_id'])},
kc AS (SELECT unit, rule_id, CAST(ci - 1 AS INTEGER) AS clause_id, dnf[ci] AS lits
       FROM (SELECT unit, rule_id, dnf, unnest(generate_series(1, len(dnf))) AS ci FROM k WHERE dnf IS NOT NULL))
SELECT unit, rule_id, clause_id, CAST(pi - 1 AS INTEGER) AS pos, abs(lits[pi]) - 1 AS slot, lits[pi] < 0 AS negated
FROM (SELECT *, unnest(generate_series(1, len(lits))) AS pi FROM kc)"""


@register("c2_rule_clauses", _CLAUSES_SQL)
def q_clauses(spark, sf_dir):
    return R.rule_clauses(fixture(spark, sf_dir, "fx_rules"))


@register("c5_path_parts", O.audit_with(
    "SELECT i.unit, i.path_no, p.line, i.kind, i.error_params, i.conditions "
    "FROM pinfo0 i JOIN pp p USING (unit, path_no)"))
def q_path_parts(spark, sf_dir):
    return P.path_parts(fixture(spark, sf_dir, "fx_paths"))


@register("c5_path_literals", O.audit_with("SELECT * FROM pl"))
def q_path_literals(spark, sf_dir):
    return P.path_literals(P.path_parts(fixture(spark, sf_dir, "fx_paths")))


@register("c8_fuzzy_vars", O.audit_with("SELECT unit, rule_id, vars, exist_flag FROM fz"))
def q_fuzzy_vars(spark, sf_dir):
    r = R.screen_rules(fixture(spark, sf_dir, "fx_rules")).where(F.col("screen") == "fuzzy")
    return R.fuzzy_vars(r)


@register("c9_names_in_source", O.audit_with("SELECT unit, rule_id, in_source FROM insrc"))
def q_names_in_source(spark, sf_dir):
    return _plan(spark, sf_dir).found


# ---- similarity (L) ------------------------------------------------------------------------------------
@register("l2_literal_similarity", O.audit_with(
    "SELECT unit, rule_id, slot, CAST(first // 1048576 AS BIGINT) AS path_no, CAST(first % 1048576 AS INTEGER) AS pos, "
    "CAST(round(sim * 100) AS INTEGER) AS sim100 FROM scored"))
def q_literal_similarity(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    crisp = plan.rlits.join(plan.state.where(F.col("screen") == "crisp").select(*KEYS), KEYS, "left_semi")
    crisp = crisp.where(~R.is_number(F.col("nval")))
    scored = L.score_candidates(crisp, L.unit_candidates(plan.plits), L.large_units(plan.plits))
    return scored.select(*KEYS, "slot", F.expr(f"first div {L.POSITION_BASE}").alias("path_no"),
                         F.expr(f"CAST(first % {L.POSITION_BASE} AS INT)").alias("pos"),
                         F.round(F.col("sim") * 100).cast("int").alias("sim100"))


@register("l3_best_match", O.audit_with("""
SELECT r.unit, r.rule_id, r.slot,
  CAST(round(100 * CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN 1.0 ELSE coalesce(b.sim, 0.0) END) AS INTEGER) AS sim100,
  CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.var ELSE b.m_var END AS m_var,
  CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.op ELSE b.m_op END AS m_op,
  CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.sval ELSE b.m_sval END AS m_sval,
  CASE WHEN r.nval <> '' AND try_cast(r.nval AS DOUBLE) IS NOT NULL THEN r.nval ELSE b.m_nval END AS m_nval
FROM crl r LEFT JOIN best b USING (unit, rule_id, slot)"""))
def q_best_match(spark, sf_dir):
    m = _plan(spark, sf_dir).matches
    return m.select(*KEYS, "slot", F.round(F.col("sim") * 100).cast("int").alias("sim100"),
                    "m_var", "m_op", "m_sval", "m_nval")


@register("l5_rewrite_rule", O.audit_with(
    "SELECT unit, rule_id, slot, CAST(round(sim * 100) AS INTEGER) AS sim100, var AS w_var, op AS w_op, "
    "sval AS w_sval, nval AS w_nval FROM mt"))
def q_rewrite(spark, sf_dir):
    w = _plan(spark, sf_dir).rewritten
    return w.select(*KEYS, "slot", F.round(F.col("sim") * 100).cast("int").alias("sim100"),
                    "w_var", "w_op", "w_sval", "w_nval")


@register("l4_rule_similarity", O.audit_with(
    "SELECT unit, rule_id, CAST(round(similarity * 100) AS INTEGER) AS similarity, "
    "coalesce(similarity > 0.85 AND similarity < 1, false) AS gated FROM st WHERE screen = 'crisp'"))
def q_rule_similarity(spark, sf_dir):
    st = _plan(spark, sf_dir).st.where(F.col("screen") == "crisp")
    return st.select(*KEYS, F.round(F.col("similarity") * 100).cast("int").alias("similarity"),
                     F.coalesce(L.similarity_gate(F.col("similarity")), F.lit(False)).alias("gated"))


# ---- decision (V) --------------------------------------------------------------------------------------
@register("v1_jointly_satisfiable", O.audit_with(
    "SELECT DISTINCT unit, rule_id, path_no, scope FROM clause_sat WHERE ok"))
def q_sat(spark, sf_dir):
    return _plan(spark, sf_dir).decision["sat"]


@register("v3_covers", O.audit_with("SELECT unit, rule_id, path_no, covered, err_cover, values_in FROM res"))
def q_covers(spark, sf_dir):
    return _plan(spark, sf_dir).decision["checks"]


@register("v4_error_hit", O.audit_with(
    "SELECT unit, rule_id, path_no, result, hit FROM res2 WHERE screen = 'crisp' AND kind = 'error'"))
def q_error_hit(spark, sf_dir):
    r = _plan(spark, sf_dir).decision["results"]
    return r.where((F.col("mode") == "crisp") & (F.col("kind") == "error")).select(*KEYS, "path_no", "result", "hit")


@register("v5_fuzzy_outcome", O.audit_with("SELECT unit, rule_id, path_no, result FROM res2 WHERE screen = 'fuzzy'"))
def q_fuzzy_outcome(spark, sf_dir):
    r = _plan(spark, sf_dir).decision["results"]
    return r.where(F.col("mode") == "fuzzy").select(*KEYS, "path_no", "result")


@register("v8_quarantine", O.audit_with(
    "SELECT s.unit, s.rule_id, r.text, s.reason FROM st s JOIN fx_rules r USING (unit, rule_id) "
    "WHERE starts_with(s.reason, 'quarantine:')"))
def q_quarantine(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return (plan.st.where(F.col("reason").startswith("quarantine:")).select(*KEYS, "reason")
            .join(plan.rules.select(*KEYS, "text"), KEYS).select(*KEYS, "text", "reason"))


@register("v7_findings_report", O.audit_with("""
, rep AS (""" + O.AUDIT_FINAL + """),
ex AS (
  SELECT r2.unit, r2.rule_id, min(r2.path_no) AS path_no
  FROM res2 r2 JOIN rep USING (unit, rule_id)
  WHERE starts_with(rep.verdict, 'BAD') AND (CASE WHEN rep.verdict = 'BAD_ERROR' THEN r2.hit ELSE r2.result = false END)
  GROUP BY ALL)
SELECT rep.unit, rep.rule_id, rep.verdict AS kind, f.text, ex.path_no, p.line
FROM rep JOIN fx_rules f USING (unit, rule_id) LEFT JOIN ex USING (unit, rule_id)
LEFT JOIN pinfo p ON p.unit = ex.unit AND p.path_no = ex.path_no
WHERE starts_with(rep.verdict, 'BAD')"""))
def q_findings(spark, sf_dir):
    return _plan(spark, sf_dir).findings()


# ---- evaluation (X) ----------------------------------------------------------------------------------
from concordia.operators import evaluate as X  # noqa: E402
from concordia.sources import text as S  # noqa: E402
from concordia.sources.tables import table  # noqa: E402

_X1_SQL = f"""WITH {duckdb_ctes('fx_verdicts')},
x1 AS (SELECT *, CASE WHEN predicted <> oracle THEN (CASE WHEN predicted THEN 'FN' ELSE 'FP' END)
                      WHEN predicted THEN 'consistent' ELSE 'inconsistent' END AS label FROM fx_verdicts),
x2 AS (SELECT count(*) AS total,
              count(*) FILTER (WHERE label = 'consistent') AS consistent,
              count(*) FILTER (WHERE label = 'inconsistent') AS inconsistent,
              count(*) FILTER (WHERE label = 'FP') AS fp,
              count(*) FILTER (WHERE label = 'FN') AS fn FROM x1)
"""


def _labels(spark, sf_dir):
    return X.label_outcomes(fixture(spark, sf_dir, "fx_verdicts"))


@register("x1_label_outcomes", _X1_SQL + "SELECT * FROM x1")
def q_x1(spark, sf_dir):
    return _labels(spark, sf_dir)


@register("x2_confusion_counts", _X1_SQL + "SELECT * FROM x2")
def q_x2(spark, sf_dir):
    return X.confusion_counts(_labels(spark, sf_dir))


@register("x3_quality_metrics", _X1_SQL + """SELECT *,
  CAST(inconsistent AS DOUBLE) / NULLIF(inconsistent + fp, 0) AS precision,
  CAST(inconsistent AS DOUBLE) / NULLIF(inconsistent + fn, 0) AS recall,
  CAST(inconsistent + consistent AS DOUBLE) / NULLIF(total, 0) AS accuracy FROM x2""")
def q_x3(spark, sf_dir):
    return X.quality_metrics(X.confusion_counts(_labels(spark, sf_dir)))


@register("x4_verdict_matrix", _X1_SQL + """SELECT family,
  min(label) FILTER (WHERE variant = 0) AS v0, min(label) FILTER (WHERE variant = 1) AS v1,
  min(label) FILTER (WHERE variant = 2) AS v2 FROM x1 GROUP BY family""")
def q_x4(spark, sf_dir):
    return X.verdict_matrix(_labels(spark, sf_dir))


@register("x5_method_comparison", f"""WITH {duckdb_ctes('fx_records')}
SELECT method,
  count(*) FILTER (WHERE coalesce(note, '') <> 'miss' AND consistent = 1) AS correct,
  count(*) FILTER (WHERE coalesce(note, '') <> 'miss' AND consistent = 0) AS incorrect,
  count(*) FILTER (WHERE note = 'miss') AS missing,
  count(*) FILTER (WHERE coalesce(note, '') <> 'miss' AND consistent = 1) / count(*) AS accuracy
FROM fx_records GROUP BY method""")
def q_x5(spark, sf_dir):
    return X.method_comparison(fixture(spark, sf_dir, "fx_records"))


@register("x6_confirmation_rate", """SELECT d.source,
  count(*) FILTER (WHERE l.quality = 1) AS confirmed, count(*) AS reported,
  count(*) FILTER (WHERE l.quality = 1) / count(*) AS rate
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def q_x6(spark, sf_dir):
    issues = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return X.confirmation_rate(issues)


# ---- text sources (S) ---------------------------------------------------------------------------------
@register("s2_scan_lines", """SELECT doc_id, CAST(i AS INTEGER) AS line_no,
  regexp_replace(parts[i], '[ \\t\\r\\f\\x0B]+$', '') AS line
FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def q_s2(spark, sf_dir):
    return S.scan_lines(table(spark, sf_dir, "documents"), "doc_id")


@register("s6_last_line", f"WITH {duckdb_ctes('fx_logs')} SELECT file, arg_max(line, line_no) AS last_line FROM fx_logs GROUP BY file")
def q_s6(spark, sf_dir):
    return S.last_line(fixture(spark, sf_dir, "fx_logs"), "file")


@register("s9_parse_run_log", f"""WITH {duckdb_ctes('fx_logs')},
p AS (SELECT file,
        CASE WHEN line = 'BAD CONSTRAINT' THEN line ELSE regexp_extract(line, {O.q(S.COUNTER_RE)}, 1) END AS metric,
        CASE WHEN line = 'BAD CONSTRAINT' THEN NULL ELSE CAST(regexp_extract(line, {O.q(S.COUNTER_RE)}, 2) AS BIGINT) END AS value
      FROM fx_logs)
SELECT file, metric, count(*) AS n_lines, CAST(sum(value) AS BIGINT) AS total FROM p WHERE metric <> '' GROUP BY ALL""")
def q_s9(spark, sf_dir):
    return S.parse_run_log(fixture(spark, sf_dir, "fx_logs"), "file")


def _field_sql(name: str) -> str:
    return f"nullif(regexp_extract(chr(10) || body, '\\n{name}: ([^\\n]*)', 1), '')"


@register("s9_findings", f"""WITH {duckdb_ctes('fx_run_logs')},
p AS (SELECT file, replace(replace(text, chr(27) || '[91m', ''), chr(27) || '[0m', '') AS t FROM fx_run_logs),
b AS (SELECT file, t, strpos(t, '[ BAD') AS head, split_part(substr(t, strpos(t, '[ BAD')), repeat('#', 50), 2) AS body,
        CASE WHEN contains(t, 'normal results: ') THEN string_split(regexp_extract(t, 'normal results: \\[([^\\]]*)\\]', 1), ', ') END AS flags
      FROM p WHERE contains(t, '[ BAD'))
SELECT file, CAST(len(string_split(substr(t, 1, head - 1), chr(10))) AS INTEGER) AS line_no,
  CASE WHEN contains(t, ' WITH ERROR ]') THEN 'BAD_ERROR' WHEN contains(t, ' WITH FUZZY ]') THEN 'BAD_FUZZY' ELSE 'BAD' END AS verdict,
  {", ".join(f"{_field_sql(n)} AS {c}" for n, c in S.FINDING_FIELDS.items())},
  CAST(len(flags) AS BIGINT) AS n_results, CAST(len(list_filter(flags, lambda x: x = 'True')) AS BIGINT) AS n_true
FROM b""")
def q_findings(spark, sf_dir):
    return S.parse_findings(S.scan_lines(fixture(spark, sf_dir, "fx_run_logs"), "file"))


# ---- parameter tables (E6-E8), alignment (A), cross references (G), requests (T) ------------------------
from concordia.operators import align as A, extract as E, requests as T, xref as G  # noqa: E402

_PARAMS_SQL = f"""WITH {duckdb_ctes('fx_params', 'fx_signatures')},
e6b AS (
  SELECT project, unit, member, section, pos,
    CASE WHEN strpos(name, '(') > 1 THEN trim(substr(name, 1, strpos(name, '(') - 1)) ELSE name END AS name,
    regexp_replace(descr, '\\s*,\\s*', ', ', 'g') AS descr
  FROM fx_params WHERE (project, unit, member) IN (SELECT (project, unit, member) FROM fx_params WHERE section = 'param')),
e6 AS (
  SELECT project, unit, member, section, name, arg_max(descr, pos) AS descr, min(pos) AS pos FROM e6b
  WHERE NOT (contains(name, '*') OR contains(name, '.') OR contains(name, '[') OR contains(name, ']')
             OR (contains(name, ' ') AND NOT contains(name, ',')))
  GROUP BY ALL),
e7a AS (
  SELECT project, unit, member, section, pos, descr,
    CASE WHEN NOT contains(name, ',') THEN [name]
      WHEN regexp_extract(name, '\\{{([^{{}}]+)\\}}_([a-zA-Z0-9_]+)', 1) <> '' THEN
        list_transform(string_split(regexp_extract(name, '\\{{([^{{}}]+)\\}}_([a-zA-Z0-9_]+)', 1), ','),
          lambda x: trim(trim(x) || '_' || regexp_extract(name, '\\{{([^{{}}]+)\\}}_([a-zA-Z0-9_]+)', 2)))
      WHEN regexp_extract(name, '\\(([^()]+)\\)', 1) <> '' THEN
        (CASE WHEN project IN ({', '.join(O.q(p) for p in E.AND_PROJECTS)}) THEN
           [array_to_string(list_transform(string_split(regexp_extract(name, '\\(([^()]+)\\)', 1), ','), lambda x: trim(x)), '_and_')]
         ELSE list_transform(string_split(regexp_extract(name, '\\(([^()]+)\\)', 1), ','), lambda x: trim(x)) END)
      ELSE list_transform(string_split(name, ','), lambda x: trim(x)) END AS aliases
  FROM e6),
e7b AS (SELECT project, unit, member, section, descr, aliases[k] AS name, CAST(pos AS BIGINT) * 4294967296 + (k - 1) AS ord
        FROM (SELECT *, unnest(generate_series(1, len(aliases))) AS k FROM e7a)),
e7 AS (SELECT project, unit, member, section, name, arg_max(descr, ord) AS descr, min(ord) AS "order" FROM e7b GROUP BY ALL),
e8 AS (SELECT project, unit, member, name,
         arg_max(descr, (CASE WHEN section = 'attr' THEN 1 ELSE 0 END, "order")) AS descr
       FROM e7 GROUP BY ALL),
doc AS (SELECT DISTINCT project, unit, member, name FROM e7 WHERE section = 'param' AND NOT contains(name, '*')
          AND NOT contains(name, 'kwargs') AND name <> 'cls'),
code AS (SELECT DISTINCT project, unit, member, name FROM (SELECT project, unit, member, unnest(params) AS name FROM fx_signatures)
         WHERE name <> 'self' AND NOT starts_with(name, '*') AND NOT contains(name, 'kwargs') AND name <> 'cls'),
sides AS (SELECT project, unit, member, name,
            coalesce(in_d, false) AS in_doc, coalesce(in_c, false) AS in_code
          FROM (SELECT *, true AS in_d FROM doc) d FULL OUTER JOIN (SELECT *, true AS in_c FROM code) c USING (project, unit, member, name)),
g1 AS (SELECT project, unit, member, s.name AS src, d.name AS dst FROM e8 s JOIN e8 d USING (project, unit, member)
       WHERE s.name <> d.name AND (CASE WHEN length(s.name) >= 3 THEN contains(d.descr, s.name)
                                        ELSE contains(d.descr, '`' || s.name || '`') END))
"""


def _params(spark, sf_dir):
    return E.param_table(fixture(spark, sf_dir, "fx_params"))


def _pa(spark, sf_dir):
    return E.overlay_params(_params(spark, sf_dir))


def _doc_code(spark, sf_dir):
    doc = _params(spark, sf_dir).where(F.col("section") == "param").select(*E.UNIT, "name")
    code = A.declared_names(fixture(spark, sf_dir, "fx_signatures"))
    return doc, code


@register("e6_clean_params", _PARAMS_SQL + "SELECT * FROM e6")
def q_e6(spark, sf_dir):
    return E.clean_param_rows(fixture(spark, sf_dir, "fx_params"))


@register("e7_expand_names", _PARAMS_SQL + "SELECT * FROM e7")
def q_e7(spark, sf_dir):
    return _params(spark, sf_dir)


@register("e8_overlay_params", _PARAMS_SQL + "SELECT * FROM e8")
def q_e8(spark, sf_dir):
    return _pa(spark, sf_dir)


@register("a1_drop_variadic", _PARAMS_SQL + """SELECT project, unit, member, CAST(k - 1 AS INTEGER) AS pos, params[k] AS name
FROM (SELECT project, unit, member, params, unnest(generate_series(1, len(params))) AS k FROM fx_signatures)
WHERE NOT contains(params[k], '*') AND NOT contains(params[k], 'kwargs') AND params[k] <> 'cls'""")
def q_a1(spark, sf_dir):
    sig = fixture(spark, sf_dir, "fx_signatures").select(*E.UNIT, F.posexplode("params").alias("pos", "name"))
    return A.drop_variadic(sig.select(*E.UNIT, F.col("pos").cast("int").alias("pos"), "name"))


@register("a2_param_mismatch", _PARAMS_SQL + """SELECT project, unit, member,
  coalesce(list_sort(list(name) FILTER (WHERE in_doc)), []) AS doc,
  coalesce(list_sort(list(name) FILTER (WHERE in_code)), []) AS code,
  coalesce(list_sort(list(name) FILTER (WHERE NOT (in_doc AND in_code))), []) AS difference
FROM sides GROUP BY project, unit, member HAVING count(*) FILTER (WHERE NOT (in_doc AND in_code)) > 0""")
def q_a2(spark, sf_dir):
    return A.param_mismatch(*_doc_code(spark, sf_dir))


@register("a3_mismatch_side", _PARAMS_SQL + """SELECT project, unit, member, name, CASE WHEN in_doc THEN 'doc' ELSE 'code' END AS side
FROM sides WHERE NOT (in_doc AND in_code)""")
def q_a3(spark, sf_dir):
    return A.mismatch_side(*_doc_code(spark, sf_dir))


@register("c10_list_relations", _PARAMS_SQL + """SELECT project, unit, member, list_has_any(d.names, c.names) AS intersects,
  len(list_filter(d.names, lambda x: NOT list_contains(c.names, x))) = 0 AS contained
FROM (SELECT project, unit, member, list(name) AS names FROM doc GROUP BY ALL) d
JOIN (SELECT project, unit, member, list(name) AS names FROM code GROUP BY ALL) c USING (project, unit, member)""")
def q_c10(spark, sf_dir):
    doc, code = _doc_code(spark, sf_dir)
    d = A.drop_variadic(doc).groupBy(*E.UNIT).agg(F.collect_set("name").alias("doc"))
    c = A.drop_variadic(code).groupBy(*E.UNIT).agg(F.collect_set("name").alias("code"))
    return R.list_relations(d.join(c, E.UNIT), "doc", "code").select(*E.UNIT, "intersects", "contained")


@register("g1_xref_edges", _PARAMS_SQL + "SELECT * FROM g1")
def q_g1(spark, sf_dir):
    return G.xref_edges(_pa(spark, sf_dir))


@register("g2_xref_degree", _PARAMS_SQL + "SELECT project, unit, member, src, count(*) AS n FROM g1 GROUP BY ALL")
def q_g2(spark, sf_dir):
    return G.xref_degree(G.xref_edges(_pa(spark, sf_dir)))


@register("g3_prune_units", _PARAMS_SQL + """SELECT DISTINCT project, unit, member, EXISTS (
  SELECT 1 FROM g1 WHERE g1.project = e8.project AND g1.unit = e8.unit AND g1.member = e8.member) AS has_map FROM e8
WHERE EXISTS (SELECT 1 FROM g1 WHERE g1.project = e8.project AND g1.unit = e8.unit AND g1.member = '')""")
def q_g3(spark, sf_dir):
    pa = _pa(spark, sf_dir)
    return G.prune_units(pa, G.xref_edges(pa))


@register("g4_prune_summary", _PARAMS_SQL + """SELECT project, count(*) FILTER (WHERE member = '') AS n_before,
  count(*) FILTER (WHERE member = '' AND kept) AS n_after, count(*) FILTER (WHERE member <> '') AS members_before,
  count(*) FILTER (WHERE member <> '' AND kept) AS members_after
FROM (SELECT DISTINCT project, unit, member, (project, unit) IN (SELECT (project, unit) FROM g1 WHERE member = '') AS kept FROM e8) GROUP BY project""")
def q_g4(spark, sf_dir):
    pa = _pa(spark, sf_dir)
    return G.prune_summary(pa, G.xref_edges(pa))


@register("t1_render_doc", _PARAMS_SQL + """, pn AS (
  SELECT project, unit, member, name, CASE WHEN section = 'param' THEN 0 ELSE 1 END AS r, "order" FROM e7 e
  WHERE section = 'param' OR NOT EXISTS (SELECT 1 FROM e7 x WHERE x.unit = e.unit AND x.project = e.project AND x.member = e.member AND x.section = 'param' AND x.name = e.name))
SELECT project, unit, member, t.text, p.param_list FROM (
  SELECT project, unit, member,
    (CASE WHEN count(*) FILTER (WHERE section = 'param') > 0 THEN 'Parameters' || chr(10) || '----------' ELSE '' END)
    || coalesce(string_agg(chr(10) || name || ':' || descr, '' ORDER BY "order") FILTER (WHERE section = 'param'), '')
    || (CASE WHEN count(*) FILTER (WHERE section = 'attr') > 0 THEN chr(10) || 'Attributes' || chr(10) || '----------' ELSE '' END)
    || coalesce(string_agg(chr(10) || name || ':' || descr, '' ORDER BY "order") FILTER (WHERE section = 'attr'), '') AS text
  FROM e7 GROUP BY project, unit, member) t
JOIN (SELECT project, unit, member, string_agg(name, ',' ORDER BY r, "order") AS param_list FROM pn GROUP BY ALL) p USING (project, unit, member)""")
def q_t1(spark, sf_dir):
    return T.render_doc(_params(spark, sf_dir))


@register("t2_chunk_text", f"""SELECT doc_id AS key, CAST(i AS INTEGER) AS i, n,
  '[START CHUNK ' || i || '/' || n || ']' || chr(10) || '### ' || CAST(doc_id AS VARCHAR) || ' ###' || chr(10)
  || substr(text, (i - 1) * {T.CHUNK_SIZE} + 1, {T.CHUNK_SIZE}) || chr(10) || '[END CHUNK ' || i || '/' || n || ']' AS chunk
FROM (SELECT doc_id, text, n, unnest(generate_series(1, n)) AS i
      FROM (SELECT doc_id, text, CAST(ceil(length(text) / {T.CHUNK_SIZE}) AS INTEGER) AS n
            FROM documents WHERE length(text) > {T.CHUNK_MIN_LEN}))""")
def q_t2(spark, sf_dir):
    return T.chunk_text(table(spark, sf_dir, "documents"), "doc_id")


@register("t3_build_messages", None)
def q_t3(spark, sf_dir):
    return T.build_messages(T.render_doc(_params(spark, sf_dir)))


# ---- repair / text helpers (C4, C6), L1, names (D), trees (P), more sources (S) --------------------------
from concordia.operators import names as D, trees as Tr  # noqa: E402
from concordia.sources import structured as ST  # noqa: E402

_INJECT = "CASE path_no % 3 WHEN 0 THEN ')' || text WHEN 1 THEN text || ' ((' ELSE text END"


def _reduce_sql(text: str, forward: bool) -> str:
    """DuckDB oracle of one repair pass (list_reduce over characters)."""
    if forward:
        return (f"list_reduce(string_split({text}, ''), lambda acc, c: CASE "
                "WHEN c = '(' THEN {'d': acc.d + 1, 's': acc.s || c} "
                "WHEN c = ')' THEN (CASE WHEN acc.d > 0 THEN {'d': acc.d - 1, 's': acc.s || c} ELSE acc END) "
                "ELSE {'d': acc.d, 's': acc.s || c} END, {'d': 0, 's': ''}).s")
    return (f"list_reduce(list_reverse(string_split({text}, '')), lambda acc, c: CASE "
            "WHEN c = ')' THEN {'d': acc.d + 1, 's': c || acc.s} "
            "WHEN c = '(' THEN (CASE WHEN acc.d > 0 THEN {'d': acc.d - 1, 's': c || acc.s} ELSE acc END) "
            "ELSE {'d': acc.d, 's': c || acc.s} END, {'d': 0, 's': ''}).s")


@register("c4_balance_parens", f"""WITH {duckdb_ctes('fx_paths')},
b AS (SELECT unit, path_no, {_INJECT} AS text FROM fx_paths)
SELECT unit, path_no, text, {_reduce_sql(_reduce_sql('text', True), False)} AS repaired FROM b""")
def q_c4(spark, sf_dir):
    b = fixture(spark, sf_dir, "fx_paths").select("unit", "path_no", F.expr(_INJECT).alias("text"))
    return b.select("unit", "path_no", "text", P.balance_parens(F.col("text")).alias("repaired"))


@register("c6_paren_contents", "SELECT doc_id, regexp_extract_all(text, '\\((.*?)\\)', 1) AS contents FROM documents")
def q_c6(spark, sf_dir):
    return P.paren_contents(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "contents")


@register("l1_norm_levenshtein", """SELECT a, b,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END AS score
FROM (SELECT DISTINCT p.p_name AS a, s.s_name AS b FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      JOIN supplier s ON l.l_suppkey = s.s_suppkey)""")
def q_l1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    pairs = (li.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
             .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("p_name").alias("a"), F.col("s_name").alias("b")).distinct())
    return L.norm_levenshtein_pairs(pairs, "a", "b")


@register("d1_name_universe", """SELECT unit, name, count(DISTINCT lst) AS n_lists FROM (
  SELECT DISTINCT c_nationkey AS unit, c_mktsegment AS name, 0 AS lst FROM customer
  UNION ALL SELECT DISTINCT s_nationkey, s_name, 1 FROM supplier
  UNION ALL SELECT DISTINCT n_nationkey, n_name, 2 FROM nation) GROUP BY ALL""")
def q_d1(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"))
    return D.name_universe(c, s, n)


@register("d2_undefined_names", _PARAMS_SQL + """SELECT DISTINCT project, unit, member, name FROM e7 u
WHERE u.section = 'param' AND NOT EXISTS (SELECT 1 FROM code c WHERE (c.project, c.unit, c.member, c.name) = (u.project, u.unit, u.member, u.name))
  AND NOT EXISTS (SELECT 1 FROM e7 a WHERE a.section = 'attr' AND (a.project, a.unit, a.member, a.name) = (u.project, u.unit, u.member, u.name))""")
def q_d2(spark, sf_dir):
    params = _params(spark, sf_dir)
    uses = params.where(F.col("section") == "param").select(*E.UNIT, "name").distinct()
    defs = (fixture(spark, sf_dir, "fx_signatures").select(*E.UNIT, F.explode("params").alias("name"))
            .where((F.col("name") != "self") & ~F.col("name").startswith("*") & ~F.col("name").contains("kwargs")
                   & (F.col("name") != "cls"))
            .unionByName(params.where(F.col("section") == "attr").select(*E.UNIT, "name")))
    return D.undefined_names(uses, defs, [*E.UNIT, "name"])


@register("d3_dict_encode", """WITH dct AS (SELECT p_type AS value, CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS code
                   FROM (SELECT DISTINCT p_type FROM part))
SELECT p.p_partkey, p.p_type, d.code AS p_type_code, d.value AS decoded FROM part p JOIN dct d ON p.p_type = d.value""")
def q_d3(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    dct = D.dictionary(part, "p_type")
    enc = D.dict_encode(part, "p_type", dct)
    return D.dict_decode(enc, "p_type_code", dct, "decoded").select("p_partkey", "p_type", "p_type_code", "decoded")


_TREE_SQL = f"""WITH RECURSIVE {duckdb_ctes('fx_edges')},
walk(unit, node, depth, nodes, labels) AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'r' || CAST(r_regionkey AS VARCHAR), 0,
         ['r' || CAST(r_regionkey AS VARCHAR)], CAST([] AS INTEGER[]) FROM region
  UNION ALL
  SELECT w.unit, e.child, w.depth + 1, list_append(w.nodes, e.child), list_append(w.labels, e.label)
  FROM walk w JOIN fx_edges e ON e.unit = w.unit AND e.parent = w.node),
paths AS (SELECT w.unit, w.node AS leaf, w.depth, w.nodes, w.labels FROM walk w
          WHERE NOT EXISTS (SELECT 1 FROM fx_edges e WHERE e.unit = w.unit AND e.parent = w.node))
"""


def _tree_paths(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("unit"),
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return Tr.enumerate_paths(spark, fixture(spark, sf_dir, "fx_edges"), roots)


@register("p1_enumerate_paths", _TREE_SQL + "SELECT * FROM paths")
def q_p1(spark, sf_dir):
    return _tree_paths(spark, sf_dir)


_COND = ("CASE WHEN length(child) % 2 = 0 THEN '!' ELSE '' END || child || ' ' || "
         "CASE length(child) % 4 WHEN 0 THEN '=' WHEN 1 THEN '<' WHEN 2 THEN '==' ELSE '>=' END || ' 1'")


@register("p2_flip_condition", f"""WITH {duckdb_ctes('fx_edges')},
c AS (SELECT unit, parent, child, label, {_COND} AS cond FROM fx_edges),
d AS (SELECT *, regexp_replace(cond, '^!+', '') AS body,
        ((label = 1 AND starts_with(cond, '!')) OR (label = 0 AND NOT starts_with(cond, '!'))) AS flip FROM c),
e AS (SELECT *, regexp_extract(body, '(==|!=|<=|>=|=|<|>)', 1) AS op FROM d)
SELECT unit, parent, child, cond,
  CASE WHEN regexp_matches(cond, '^-?[0-9]+(\\.[0-9]+)?$') THEN cond
       WHEN flip AND op <> '' THEN regexp_replace(body, '(==|!=|<=|>=|=|<|>)',
         CASE op WHEN '==' THEN '!=' WHEN '=' THEN '!=' WHEN '!=' THEN '=' WHEN '<' THEN '>=' WHEN '>=' THEN '<' WHEN '>' THEN '<=' ELSE '>' END, 'g')
       ELSE body END AS taken
FROM e""")
def q_p2(spark, sf_dir):
    e = fixture(spark, sf_dir, "fx_edges").select("unit", "parent", "child", "label", F.expr(_COND).alias("cond"))
    return e.select("unit", "parent", "child", "cond", Tr.flip_condition(F.col("cond"), F.col("label")).alias("taken"))


@register("p3_render_paths", _TREE_SQL + """SELECT unit, leaf, array_to_string(list_transform(generate_series(2, len(nodes)),
  lambda i: '(' || nodes[i] || ' = ' || CAST(labels[i - 1] AS VARCHAR) || ')'), ' -> ') AS text FROM paths""")
def q_p3(spark, sf_dir):
    p = _tree_paths(spark, sf_dir)
    conds = F.transform(F.arrays_zip(F.slice("nodes", 2, 1 << 30).alias("n"), F.col("labels").alias("l")),
                        lambda x: F.concat(F.lit("("), x["n"], F.lit(" = "), x["l"].cast("string"), F.lit(")")))
    return Tr.render_paths(p, conds)


@register("s3_param_json", _PARAMS_SQL + """SELECT project, unit, member, section, name, descr FROM e7
UNION ALL SELECT project, unit, member, 'pa', name, descr FROM e8""")
def q_s3(spark, sf_dir):
    params = materialize(_params(spark, sf_dir))  # read twice, and counted
    pa = E.overlay_params(params.repartition(partitions(params), *E.UNIT))
    return ST.read_param_json(ST.write_param_json(params, pa))


@register("s4_scan_rule_blocks", f"""WITH {duckdb_ctes('fx_rule_text')},
ln AS (SELECT unit, CAST(i AS INTEGER) AS line_no, regexp_replace(parts[i], '[ \\t\\r\\f\\x0B]+$', '') AS line
       FROM (SELECT unit, parts, unnest(generate_series(1, len(parts))) AS i
             FROM (SELECT unit, string_split(text, chr(10)) AS parts FROM fx_rule_text))),
w AS (SELECT unit, line_no, line,
        coalesce(lead(line, 1) OVER (PARTITION BY unit ORDER BY line_no), '') AS nxt,
        coalesce(lead(line, 2) OVER (PARTITION BY unit ORDER BY line_no), '') AS nxt2 FROM ln),
r AS (SELECT unit, line_no,
        CASE WHEN contains(nxt, '```') THEN
          (CASE WHEN trim(nxt) = '```' THEN (CASE WHEN trim(nxt2) <> '' THEN trim(split_part(nxt2, ':', -1), '*`. ' || chr(10)) END)
                ELSE trim(split_part(nxt, ':', -1), '*`. ' || chr(10)) END)
        ELSE trim(split_part(line, ':', -1), '*`. ' || chr(10)) END AS rule
      FROM w WHERE (contains(line, 'Logical format') OR contains(line, 'Logical Format')) AND contains(line, ':'))
SELECT * FROM r WHERE contains(rule, '->')""")
def q_s4(spark, sf_dir):
    return S.scan_rule_blocks(S.scan_lines(fixture(spark, sf_dir, "fx_rule_text"), "unit"), "unit")


@register("s5_lookup_case", f"""WITH {duckdb_ctes('fx_cases', 'fx_verdicts')},
last AS (SELECT id, arg_max(class, doc_id) AS class, arg_max(func, doc_id) AS func,
                arg_max(constraints, doc_id) AS constraints, arg_max(oracle, doc_id) AS oracle FROM fx_cases GROUP BY id)
SELECT l.id AS case_id, CASE WHEN l.class = 'NA' THEN l.func ELSE l.class END AS unit,
       trim(split_part(l.constraints, ':', -1)) AS rule_text, l.oracle
FROM (SELECT DISTINCT case_id FROM fx_verdicts) v JOIN last l ON l.id = v.case_id""")
def q_s5(spark, sf_dir):
    return S.lookup_case(fixture(spark, sf_dir, "fx_cases"), fixture(spark, sf_dir, "fx_verdicts"))


@register("s7_attach_results", """SELECT l.doc_id, l.quality, l.toxic, d.source FROM labels l JOIN documents d USING (doc_id)""")
def q_s7(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.attach_results(table(spark, sf_dir, "labels"), units)


@register("s7_placed_results", """SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)""")
def q_s7_placed(spark, sf_dir):
    placed = S.attach_results(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    root = ST.scratch_path(spark, "placed")
    S.place_results(placed, root, ("lang", "source"))
    return S.read_placed(spark, root, placed.schema)


@register("s8_extraction_records", f"""WITH {duckdb_ctes('fx_records')}
SELECT 'm' || method AS lib, 'sha' || doc_id AS sha, CASE WHEN consistent = 1 THEN 'issue' || doc_id END AS issue_sha, CAST(consistent AS INTEGER) AS consistent,
  note, CASE WHEN consistent = 0 THEN 'said "no",' || chr(10) || 'twice' END AS human, '(a = ' || doc_id || ') -> (b != ''None'')' AS model FROM fx_records""")
def q_s8_records(spark, sf_dir):
    path = ST.scratch_path(spark, "extraction")
    records = fixture(spark, sf_dir, "fx_records").select(
        F.expr("concat('\"lib\": \"m', method, '\",\n \"sha\": \"sha', doc_id, if(consistent = 1, concat('\",\n \"issue_sha\": \"issue', doc_id), ''), '\"')")
        .alias("INFO (lib, sha, issue_sha)"), F.col("consistent").alias("Consistency?"), F.col("note").alias("Note"),
        F.when(F.col("consistent") == 0, F.lit('said "no",\ntwice')).alias("Human label"),
        F.concat(F.lit("(a = "), F.col("doc_id").cast("string"), F.lit(") -> (b != 'None')")).alias("LLM output"))
    records.write.option("header", True).option("escape", '"').csv(path)
    return ST.record_info(ST.read_records(spark, path, ST.RECORD_SCHEMA)).select("lib", "sha", "issue_sha", "consistent", "note", "human", "model")


@register("s8_read_records", """SELECT CAST(item_id AS BIGINT) AS item_id, text || chr(10) || 'note: "quoted", line' AS info,
  regexp_extract(text || chr(10), '^([A-Za-z]+)', 1) AS lib FROM benchmark""")
def q_s8(spark, sf_dir):
    path = ST.scratch_path(spark, "records")
    (table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("text"), F.lit("\nnote: \"quoted\", line")).alias("info"))
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))
    recs = ST.read_records(spark, path)
    return recs.select(F.col("item_id").cast("long").alias("item_id"), "info",
                       F.regexp_extract("info", r"^([A-Za-z]+)", 1).alias("lib"))


# ---- docstring section parsers (E4 numpy, E5 google) ---------------------------------------------------
from concordia.functions import vocab as V  # noqa: E402

_STRIP = "regexp_replace({x}, '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')"


def _hkind_sql() -> str:
    def cases(table, numpy):
        out = []
        for h, kind in table.items():
            cond = f"starts_with(line, {O.q(h)})" + (" AND NOT contains(line, ':')" if numpy and h == "return" else "")
            out.append(f"WHEN {cond} THEN '{kind or 'none'}'")
        return "CASE " + " ".join(out) + " END"
    return (f"CASE WHEN flag IN ('Parameters', 'Parameters:') THEN ({cases(V.NUMPY_HEADERS, True)}) "
            f"WHEN flag = 'Args:' THEN ({cases(V.GOOGLE_HEADERS, False)}) END")


_W = "PARTITION BY project, unit ORDER BY line_no"
_SECTIONS_SQL = f"""WITH {duckdb_ctes('fx_docs')},
ln AS (SELECT unit, project, flag, CAST(i AS INTEGER) AS line_no, regexp_replace(parts[i], '[ \\t\\r\\f\\x0B]+$', '') AS line
       FROM (SELECT unit, project, flag, parts, unnest(generate_series(1, len(parts))) AS i
             FROM (SELECT unit, project, flag, string_split(docstring, chr(10)) AS parts FROM fx_docs))),
h AS (SELECT *, {_hkind_sql()} AS hkind FROM ln),
h2 AS (SELECT *, CASE WHEN flag IN ('Parameters', 'Parameters:') THEN hkind IS NOT NULL
                      ELSE hkind IS NOT NULL AND ({' OR '.join(f"starts_with(line, {O.q(x)})" for x in V.GOOGLE_SKIP_NEXT)}) END AS hskip FROM h),
s AS (SELECT *, ((line_no - 1) - coalesce(max(CASE WHEN NOT hskip THEN line_no END)
        OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS skipped FROM h2),
s2 AS (SELECT *, hkind IS NOT NULL AND NOT skipped AS hdr FROM s),
s3 AS (SELECT *, last_value(CASE WHEN hdr THEN hkind END IGNORE NULLS)
        OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM s2),
s4 AS (SELECT *, NOT hdr AND NOT skipped AND coalesce(section IN ('param', 'attr'), false) AS content,
        contains(line, ':') AS colon, length(line) - length(ltrim(line, ' ')) AS indent FROM s3),
s5 AS (SELECT *, first_value(CASE WHEN content AND colon THEN indent END IGNORE NULLS)
        OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_indent FROM s4),
s6 AS (SELECT *, content AND colon AND indent = first_indent AS is_key FROM s5),
s7 AS (SELECT *,
        max(CASE WHEN is_key THEN line_no END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_key,
        max(CASE WHEN hdr THEN line_no END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_hdr,
        min(CASE WHEN is_key THEN line_no END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_key FROM s6),
pt AS (SELECT unit, project, flag, section, line_no, line, is_key,
        CASE WHEN is_key THEN line_no
             WHEN content AND last_key IS NOT NULL AND (last_hdr IS NULL OR last_key > last_hdr) THEN last_key
             WHEN content AND colon THEN next_key END AS owner,
        CASE WHEN is_key THEN {_STRIP.format(x="substr(line, strpos(line, ':') + 1)")} ELSE {_STRIP.format(x="line")} END AS part
       FROM s7),
kv AS (SELECT unit, owner, regexp_replace({_STRIP.format(x="string_agg(part, ' ' ORDER BY line_no)")}, '\\s*,\\s*', ', ', 'g') AS descr
       FROM pt WHERE owner IS NOT NULL GROUP BY ALL),
sec AS (SELECT k.unit, k.project, k.flag, k.section, CAST(k.line_no AS INTEGER) AS pos,
          {_STRIP.format(x="split_part(k.line, ':', 1)")} AS name, v.descr
        FROM pt k JOIN kv v ON v.unit = k.unit AND v.owner = k.line_no WHERE k.is_key)
"""


def _sections(spark, sf_dir, flags):
    docs = fixture(spark, sf_dir, "fx_docs").where(F.col("flag").isin(*flags))
    lines = S.scan_lines(docs.select("unit", "project", "flag", F.col("docstring").alias("text")), ["unit", "project", "flag"])
    return E.parse_sections(lines)


@register("e4_sections_numpy", _SECTIONS_SQL + "SELECT unit, project, section, pos, name, descr FROM sec WHERE flag IN ('Parameters', 'Parameters:')")
def q_e4(spark, sf_dir):
    return _sections(spark, sf_dir, ["Parameters", "Parameters:"])


@register("e5_sections_google", _SECTIONS_SQL + "SELECT unit, project, section, pos, name, descr FROM sec WHERE flag = 'Args:'")
def q_e5(spark, sf_dir):
    return _sections(spark, sf_dir, ["Args:"])


@register("v2_entails", O.ENTAILS_SQL)
def q_entails(spark, sf_dir):
    return _plan(spark, sf_dir).entailment()


# ---- paths with OR, NOT and comparisons of two variables (C5, V1, V2) ------------------------------------
# The oracle evaluates each template by itself over a grid that separates chains of three variables
# between whole numbers, for every pair of constants; orders then look their constants up.
_LOGIC_SQL = """WITH v AS (SELECT CAST(x AS DOUBLE) / 4 AS x FROM (SELECT unnest(generate_series(-4, 24)) AS x)),
g AS (SELECT a.x AS a, b.x AS b, c.x AS c FROM v a, v b, v c),
k AS (SELECT q, d FROM (SELECT unnest(range(5)) AS q), (SELECT unnest(range(4)) AS d)),
e AS (SELECT q, d, d AS rule, p,
        CASE d WHEN 0 THEN a = q AND b > d WHEN 1 THEN a >= b AND c < a WHEN 2 THEN b < 2 OR (c >= d AND a = 1) ELSE c <> d AND a > c END AS r_true,
        CASE p WHEN 0 THEN a = q OR (b = d AND c = 0) WHEN 1 THEN a >= q AND b <= c AND c = d WHEN 2 THEN a < b AND b < c AND c = q
               WHEN 3 THEN NOT (a = q OR b > d) AND c <> 1 ELSE (a > q OR b < d) AND c = 1 AND a <> 2 END AS p_true
      FROM g, k, (SELECT unnest(range(5)) AS p)),
t AS (SELECT q, d, p, bool_or(r_true AND p_true) AS sat, bool_or(r_true AND NOT p_true) AS sat_not FROM e GROUP BY ALL),
o AS (SELECT o_orderkey AS unit, o_orderkey AS rule_id, CAST(t.p AS INTEGER) AS path_no, t.sat, t.sat_not
      FROM orders JOIN t ON t.q = o_custkey % 5 AND t.d = o_orderkey % 4)
"""


def _logic_inputs(spark, sf_dir, scope, negate=False):
    """Literals of the rules by clause, forms of the paths (rows unit, path_no, scope, forms, kind)."""
    rules, rows = fixture(spark, sf_dir, "fx_logic_rules"), P.path_rows(P.path_parts(fixture(spark, sf_dir, "fx_logic_paths")))
    lits = R.typed_literals(R.rule_literals(rules))
    clauses = R.rule_clauses(rules).select(*KEYS, "clause_id", "slot", "negated")
    forms = P.with_logic(rows.where("alone"), negate=[negate]).select("unit", "path_no", decide.row_forms(scope).alias("forms"))
    others = rows.where("not alone")  # literals and clauses of equal keys belong together
    if not others.isEmpty():
        scopes = decide.negated_path_scopes if negate else decide.path_scopes
        scoped = scopes(P.row_literals(others), P.path_clauses(others, negate=negate)).where(F.col("scope") == scope)
        forms = forms.unionByName(decide.path_forms(scoped).select(*forms.columns))
    return decide.rule_forms(decide.clause_literals(lits, clauses)), materialize(forms.withColumn("scope", F.lit(scope))), rows


@register("v1_path_logic", _LOGIC_SQL + "SELECT unit, rule_id, path_no FROM o WHERE sat")
def q_path_logic(spark, sf_dir):
    """Rules and paths of one unit that can hold together."""
    rules, paths, _ = _logic_inputs(spark, sf_dir, "full")
    return decide.sat_pairs(rules, paths.where("forms is not null")).select(*KEYS, "path_no")


@register("v2_path_logic", _LOGIC_SQL + "SELECT unit, rule_id, path_no, NOT sat_not AS holds FROM o")
def q_not_path_logic(spark, sf_dir):
    """Whether a rule leaves no state outside of a path."""
    rules, paths, rows = _logic_inputs(spark, sf_dir, "not", True)
    c_keys = R.rule_literals(fixture(spark, sf_dir, "fx_logic_rules"))
    return decide.entails(c_keys.select(*KEYS).distinct(), rows.select("unit", "path_no", "kind"), rules, paths, F.lit(True))


# ---- units from source files (E1-E3), file scan (S1) ------------------------------------------------------
from concordia.operators import units as U  # noqa: E402


def _structure(spark, sf_dir):
    src = fixture(spark, sf_dir, "fx_sources").where(~F.element_at(F.split("path", "/"), -1).contains("{"))
    lines = S.scan_lines(spread(src, "project", "path"), ["project", "path"], "content")
    return U.code_structure(lines, fixture(spark, sf_dir, "doc_style"))


# one character after the other: 0 code, 1 and 2 triple quotes, 3 and 4 quotes, 5 comment
_UNITS_SQL = f"""WITH RECURSIVE {duckdb_ctes('fx_sources', 'doc_style')},
src AS (SELECT project, path, content FROM fx_sources WHERE NOT contains(split_part(path, '/', -1), '{{')),
lex AS (
  SELECT path, 1 AS pos, 0 AS eaten, '' AS c, 0 AS st, 0 AS depth, '' AS piece, 0 AS to_st, 0 AS to_depth FROM src
  UNION ALL
  SELECT path, p,
    CASE WHEN st = 0 AND t IN (tq1, tq2) OR st = 1 AND t = tq1 OR st = 2 AND t = tq2 THEN 3 ELSE 1 END,
    c, st, depth,
    CASE WHEN st <> 0 OR c IN ('#', chr(10)) THEN '' WHEN c IN (chr(34), chr(39)) THEN chr(1) ELSE c END,
    CASE WHEN st = 0 THEN CASE WHEN t = tq1 THEN 1 WHEN t = tq2 THEN 2 WHEN c = chr(34) THEN 3 WHEN c = chr(39) THEN 4 WHEN c = '#' THEN 5 ELSE 0 END
         WHEN st = 1 THEN CASE WHEN t = tq1 THEN 0 ELSE 1 END WHEN st = 2 THEN CASE WHEN t = tq2 THEN 0 ELSE 2 END
         WHEN st = 3 THEN CASE WHEN c IN (chr(34), chr(10)) THEN 0 ELSE 3 END WHEN st = 4 THEN CASE WHEN c IN (chr(39), chr(10)) THEN 0 ELSE 4 END
         ELSE CASE WHEN c = chr(10) THEN 0 ELSE 5 END END,
    CASE WHEN st = 0 AND c IN ('(', '[', '{{') THEN depth + 1 WHEN st = 0 AND c IN (')', ']', '}}') THEN depth - 1 ELSE depth END
  FROM (SELECT l.path, l.pos + l.eaten AS p, l.to_st AS st, l.to_depth AS depth, substr(s.content, l.pos + l.eaten, 1) AS c,
          substr(s.content, l.pos + l.eaten, 3) AS t, repeat(chr(34), 3) AS tq1, repeat(chr(39), 3) AS tq2
        FROM lex l JOIN src s ON s.path = l.path WHERE l.pos + l.eaten <= length(s.content))),
sg AS (SELECT *, 1 + coalesce(sum(CASE WHEN c = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no
       FROM lex WHERE eaten > 0),
cd AS (SELECT path, CAST(line_no AS INTEGER) AS line_no, min_by(st, pos) AS st, min_by(depth, pos) AS depth, rtrim(string_agg(piece, '' ORDER BY pos)) AS code
       FROM sg GROUP BY path, line_no),
ln AS (SELECT project, path, CAST(i AS INTEGER) AS line_no, regexp_replace(parts[i], '[ \\t\\r\\f\\x0B]+$', '') AS line
       FROM (SELECT project, path, parts, unnest(generate_series(1, len(parts))) AS i
             FROM (SELECT project, path, string_split(content, chr(10)) AS parts FROM src))),
l0 AS (SELECT n.*, d.st, d.code, d.st = 0 AND d.depth = 0 AND trim(d.code) <> '' AS begins FROM ln n JOIN cd d USING (path, line_no)),
l1 AS (SELECT *, max(CASE WHEN begins THEN line_no END) OVER (PARTITION BY path ORDER BY line_no) AS logical FROM l0),
lg AS (SELECT project, path, logical AS line_no, min_by(line, line_no) AS line, min_by(length(line) - length(ltrim(line, ' ')), line_no) AS indent,
         string_agg(code, ' ' ORDER BY line_no) AS code, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE begins OR st <> 0) AS raw
       FROM l1 WHERE logical IS NOT NULL GROUP BY project, path, logical),
hd AS (SELECT *, CASE WHEN starts_with(ltrim(code), 'class ') THEN 'class' WHEN starts_with(ltrim(code), 'def ') THEN 'def'
                      WHEN regexp_matches(ltrim(code), '^async +def ') THEN 'async def' ELSE '' END AS hkind,
         ends_with(rtrim(code), ':') AS opens, lead(code) OVER w AS next_code, lead(raw) OVER w AS next_raw
       FROM lg WINDOW w AS (PARTITION BY path ORDER BY line_no)),
hn AS (SELECT *, CASE WHEN hkind <> '' THEN regexp_extract(substr(ltrim(code), length(hkind) + 1), '[A-Za-z0-9_]+') END AS name FROM hd),
par AS (SELECT h.path, h.line_no, max(o.line_no) AS p_line FROM hn h JOIN hn o
          ON o.path = h.path AND o.opens AND o.line_no < h.line_no AND o.indent < h.indent WHERE h.hkind <> '' GROUP BY ALL),
dc AS (SELECT path, line_no, string_split(next_raw, chr(10)) AS ls FROM hn WHERE hkind <> '' AND trim(next_code) = chr(1)),
dm AS (SELECT *, coalesce(list_min(list_transform(list_filter(ls[2:], lambda x: trim(x) <> ''), lambda x: length(x) - length(ltrim(x)))), 0) AS margin FROM dc),
dd AS (SELECT path, line_no, array_to_string([ltrim(ls[1])] || list_transform(ls[2:], lambda x: substr(x, margin + 1)), chr(10)) AS whole FROM dm),
docs AS (SELECT path, line_no, trim(trim(whole, chr(34) || chr(39)), ' ' || chr(10)) AS docstring FROM dd),
st AS (SELECT h.project, h.path, h.line_no, h.hkind, h.name,
         CASE WHEN h.hkind = 'class' THEN 'class' WHEN h.hkind = 'async def' THEN 'async'
              WHEN o.hkind = 'class' THEN 'member' ELSE 'function' END AS kind,
         CASE WHEN o.hkind = 'class' THEN o.name END AS parent, d.docstring, h.code, s.flag,
         coalesce(contains(d.docstring, CASE WHEN s.flag = 'Parameters' THEN 'Parameters' || chr(10) || '-----' ELSE s.flag END), false) AS with_doc
       FROM hn h LEFT JOIN par p ON p.path = h.path AND p.line_no = h.line_no LEFT JOIN hn o ON o.path = p.path AND o.line_no = p.p_line
       LEFT JOIN docs d ON d.path = h.path AND d.line_no = h.line_no LEFT JOIN doc_style s ON s.project = h.project WHERE h.hkind <> '')
"""


@register("e1_extract_units", _UNITS_SQL + """SELECT project, path, line_no, kind, name, parent, with_doc,
  CASE WHEN with_doc THEN docstring END AS docstring FROM st
WHERE (kind IN ('class', 'function') AND with_doc) OR (kind = 'member' AND name <> '__init__')""")
def q_e1(spark, sf_dir):
    return U.extract_units(_structure(spark, sf_dir))


@register("e2_unit_stats", _UNITS_SQL + """SELECT project,
  count(*) FILTER (WHERE kind = 'class') AS class,
  count(*) FILTER (WHERE kind = 'class' AND with_doc) AS class_with_doc,
  count(*) FILTER (WHERE kind = 'member' AND name <> '__init__') AS member,
  count(*) FILTER (WHERE kind = 'member' AND name <> '__init__' AND with_doc) AS member_with_doc,
  count(*) FILTER (WHERE kind = 'function') AS function,
  count(*) FILTER (WHERE kind = 'function' AND with_doc) AS function_with_doc
FROM st GROUP BY project""")
def q_e2(spark, sf_dir):
    return U.unit_stats(_structure(spark, sf_dir))


@register("e3_signature_params", _UNITS_SQL + """, ch AS (
  SELECT project, path, line_no, CASE WHEN kind = 'member' THEN parent ELSE name END AS unit, i, substr(code, CAST(i AS BIGINT), 1) AS c
  FROM (SELECT *, unnest(generate_series(1, length(code))) AS i FROM st WHERE kind = 'function' OR (kind = 'member' AND name = '__init__'))),
dp AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 WHEN c IN (')', ']', '}') THEN -1 ELSE 0 END) OVER (PARTITION BY path, line_no ORDER BY i) AS depth FROM ch),
it AS (SELECT *, sum(CASE WHEN c = ',' AND depth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, line_no ORDER BY i) AS item FROM dp),
nm AS (SELECT project, path, line_no, unit, item, ltrim(ltrim(string_agg(c, '' ORDER BY i) FILTER (WHERE depth = 1 AND c NOT IN (',', '(', ')', ']', '}'))), ' ') AS t
       FROM it GROUP BY ALL),
nn AS (SELECT *, regexp_extract(t, '^[A-Za-z0-9_]+') AS name FROM nm WHERE NOT starts_with(t, '*'))
SELECT project, path, unit, CAST(row_number() OVER (PARTITION BY path, line_no ORDER BY item) - 1 AS INTEGER) AS pos, name
FROM nn WHERE name NOT IN ('', 'self')""")
def q_e3(spark, sf_dir):
    return U.signature_params(_structure(spark, sf_dir))


@register("s1_scan_sources", f"""WITH {duckdb_ctes('fx_sources')}
SELECT project, regexp_extract(path, '([^/]*)\\.py$', 1) AS fname, content || chr(10) AS content FROM fx_sources WHERE NOT contains(path, '{{')""")
def q_s1(spark, sf_dir):
    root = ST.scratch_path(spark, "sources")
    src = fixture(spark, sf_dir, "fx_sources").select(
        "project", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "").alias("fname"), "content")
    # one file per source: a folder per (project, file name), the content as a single text value
    # tasks move their own files: by default the driver would move every folder, one after the other;
    # dealt by rows, since what takes time is the number of folders, not their bytes
    (spread(src, "project", "fname").write.partitionBy("project", "fname")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root))
    return ST.scan_sources(spark, root, "*.txt").select("project", F.regexp_extract("path", "/fname=([^/]*)/", 1).alias("fname"), "content")


@register("p4_decision_table", O.audit_with("""
, shapes AS (SELECT l_orderkey AS unit, l_returnflag AS returnflag, l_linestatus AS linestatus,
               CAST(l_quantity AS INTEGER) AS quantity, CAST(round(l_discount * 100) AS INTEGER) AS discount,
               count(*) AS n_rows FROM lineitem GROUP BY ALL),
ceff AS (SELECT unit, path_no, regexp_extract(replace(line, ' ', ''), '^(.*)->', 1) AS cond_text,
           regexp_extract(replace(line, ' ', ''), '.*->(.*)$', 1) AS effect FROM pinfo),
""" + O.literals_ctes("cl0", "ceff", ["unit", "path_no"], "cond_text", "pos") + """,
cl AS (SELECT *, """ + O.typed_select() + """ FROM cl0),
need AS (SELECT unit, path_no, count(*) AS n_cond FROM cl GROUP BY ALL),
uv AS (SELECT unit, returnflag, linestatus, quantity, discount, 'returnflag' AS var, returnflag AS s_val, NULL::DOUBLE AS n_val FROM shapes
       UNION ALL SELECT unit, returnflag, linestatus, quantity, discount, 'linestatus', linestatus, NULL FROM shapes
       UNION ALL SELECT unit, returnflag, linestatus, quantity, discount, 'quantity', NULL, CAST(quantity AS DOUBLE) FROM shapes
       UNION ALL SELECT unit, returnflag, linestatus, quantity, discount, 'discount', NULL, CAST(discount AS DOUBLE) FROM shapes),
hit AS (SELECT u.unit, u.returnflag, u.linestatus, u.quantity, u.discount, c.path_no, count(*) AS n_hold
        FROM uv u JOIN cl c ON c.unit = u.unit AND c.var = u.var
        WHERE coalesce(CASE WHEN c.sort = 'S' THEN (CASE c.rop WHEN '=' THEN u.s_val = c.sv WHEN '!=' THEN u.s_val <> c.sv END)
                            WHEN c.sort = 'R' THEN (CASE c.rop WHEN '=' THEN u.n_val = c.num WHEN '!=' THEN u.n_val <> c.num
                                 WHEN '<' THEN u.n_val < c.num WHEN '<=' THEN u.n_val <= c.num
                                 WHEN '>' THEN u.n_val > c.num WHEN '>=' THEN u.n_val >= c.num END) END, false)
        GROUP BY ALL),
firsthit AS (SELECT h.unit, h.returnflag, h.linestatus, h.quantity, h.discount, min(h.path_no) AS path_no
             FROM hit h JOIN need n USING (unit, path_no) WHERE h.n_hold = n.n_cond GROUP BY ALL)
SELECT s.unit, s.returnflag, s.linestatus, s.quantity, s.discount, s.n_rows, f.path_no, coalesce(e.effect, 'Unknown') AS effect
FROM shapes s LEFT JOIN firsthit f USING (unit, returnflag, linestatus, quantity, discount)
LEFT JOIN ceff e ON e.unit = f.unit AND e.path_no = f.path_no"""))
def q_p4(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = (li.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("returnflag"),
                       F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").cast("int").alias("quantity"),
                       F.round(F.col("l_discount") * 100).cast("int").alias("discount"))
            .agg(F.count(F.lit(1)).alias("n_rows")))
    parts = P.path_parts(fixture(spark, sf_dir, "fx_paths")).withColumn("__nb", F.regexp_replace("line", " ", ""))
    # both are read twice below: paths are parsed once
    parts = materialize(parts.select("unit", "path_no",
                                     F.expr("substring(__nb, 1, length(__nb) - length(substring_index(__nb, '->', -1)) - 2)").alias("cond_text"),
                                     F.substring_index("__nb", "->", -1).alias("effect")))
    cond = materialize(R.typed_literals(R.literals_from_text(parts, "cond_text", ["unit", "path_no"], "pos"))
                       .select("unit", "path_no", "var", "sort", "rop", "num", "sv"))
    return Tr.apply_decision_table(rows, parts, cond, {"returnflag": "returnflag", "linestatus": "linestatus"},
                                   {"quantity": "quantity", "discount": "discount"})
