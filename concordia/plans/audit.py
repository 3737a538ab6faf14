"""The rule audit: documented rules x observed paths -> one verdict per rule.

Phases (each phase's output is read by several later joins, so it is checkpointed into
the shared checkpoint folder instead of being recomputed per branch):

  A. paths --C5--> one row per path with its typed literals and the forms of its scopes 'full' / 'err'
  B. rules --C7--> screen; crisp rules are read whole, fuzzy rules by their left side;
     C1 literals + C3 types, C2 logic, C8
  C. crisp: L3 best match inside the unit, L5 rewrite, L4 fold, L6 gate, source gate
  D. V1 satisfiable(clause AND path scope); per (rule, path) V3/V4/V5 -> result; V6

Every join is keyed by ``unit``: rules and paths of one unit meet, two units never do.
A unit with very many paths is a skewed key; AQE's skew-join splitting handles it
(the rule side of one unit is tiny).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.operators import decide, paths as P, rules as R, similarity as L
from concordia.session import materialize

KEYS = ["unit", "rule_id"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def path_info(rows: DataFrame) -> DataFrame:
    """Phase A: ``info`` of ``paths.path_rows`` (cut): unit, path_no, line, kind, pnames, err_names,
    path_error, the forms of its scopes ``full`` and ``err`` (null: no consistent clause) and
    ``first``: one row of each (unit, path_no).

    What is asked of a path is read in its own row; only paths that share their keys are gathered."""
    keys = ["unit", "path_no"]
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["var"]))
    unread = F.col("logical") & F.col("dnf").isNull()
    info = P.with_logic(rows.where("alone"), keys).select(
        *keys, "line", "kind", F.coalesce(names(F.col("lits")), _empty()).alias("pnames"),
        F.coalesce(names(F.filter("lits", lambda x: F.array_contains("error_params", x["var"]))), _empty()).alias("err_names"),
        F.coalesce(unread | F.exists("lits", lambda x: (x["sort"] == "E") | x["lit_error"].isNotNull()), F.lit(False)).alias("path_error"),
        *(decide.row_forms(scope).alias(scope) for scope in ("full", "err")), F.lit(True).alias("first"))
    others = rows.where("not alone")
    if not others.isEmpty():
        info = info.unionByName(_gathered(others, keys).select(*info.columns))
    return materialize(info)


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``info`` of paths whose keys are not theirs alone: literals and clauses of equal keys belong together."""
    lits = materialize(P.row_literals(rows, keys))
    names = lits.groupBy(*keys).agg(
        F.collect_set("var").alias("pnames"),
        F.collect_set(F.when(F.col("in_error"), F.col("var"))).alias("err_names"),
        F.bool_or((F.col("sort") == "E") | F.col("lit_error").isNotNull()).alias("path_error"))
    unread = P.path_logic_error(rows, keys).withColumn("unread", F.lit(True))
    forms = decide.path_forms(decide.path_scopes(lits, P.path_clauses(rows, keys))).groupBy(*keys).agg(
        *(F.get(F.collect_list(F.when(F.col("scope") == s, F.col("forms"))), F.lit(0)).alias(s) for s in ("full", "err")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return (rows.withColumn("first", (nth == 1) & F.col("unit").isNotNull() & F.col("path_no").isNotNull())
            .join(names, keys, "left").join(unread, keys, "left").join(forms, keys, "left")
            .select(*keys, "line", "kind", F.coalesce("pnames", _empty()).alias("pnames"), F.coalesce("err_names", _empty()).alias("err_names"),
                    (F.coalesce("path_error", F.lit(False)) | F.coalesce("unread", F.lit(False))).alias("path_error"), "full", "err", "first"))


def prepare_rules(rules: DataFrame, checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Phase B: ``state`` (one row per rule: screen, skeleton, fuzzy variables, right-side
    names) and typed literals of the checked text (whole rule, or a fuzzy rule's left side)."""
    screened = R.screen_rules(rules.select(*KEYS, "text"))
    parts = F.split(F.col("text"), "->")
    staged = screened.select(
        *KEYS, "screen", "text",
        F.when(F.col("screen") == "fuzzy", F.element_at(parts, 1)).otherwise(F.col("text")).alias("checked_text"),
        F.when(F.col("screen") == "fuzzy", F.element_at(parts, 2)).alias("right_text"))
    if checkpoint:
        staged = materialize(staged)
    live = staged.where(F.col("screen").isin("crisp", "fuzzy"))
    lits = R.typed_literals(R.literals_from_text(live, "checked_text", KEYS, "slot"))
    sk = R.rule_skeletons(live, text="checked_text")
    fz = live.where(F.col("screen") == "fuzzy")
    fvars = R.fuzzy_vars(fz)
    right_names = (R.literals_from_text(fz, "right_text", KEYS, "slot")
                   .groupBy(*KEYS).agg(F.collect_set("var").alias("right_names")))
    state = (staged.select(*KEYS, "screen").join(sk, KEYS, "left")
             .join(fvars, KEYS, "left").join(right_names, KEYS, "left"))
    if checkpoint:
        lits, state = materialize(lits), materialize(state)
    return state, lits


def _first_reason(*conds_reasons) -> Column:
    out = F.lit(None).cast("string")
    for cond, reason in reversed(conds_reasons):
        out = F.when(cond, F.lit(reason)).otherwise(out)
    return out


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


class AuditPlan:
    """The audit as named stages; each stage is built (and checkpointed) on first use,
    so a query that needs only an early stage never runs the later ones."""

    def __init__(self, rules: DataFrame, paths: DataFrame, exempt_names: Sequence[str] = (),
                 checkpoint: bool = True, sources: DataFrame | None = None):
        self.rules, self.paths, self.exempt_names, self.checkpoint = rules, paths, tuple(exempt_names), checkpoint
        self.sources = sources
        self._cache: dict[str, object] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    # ---- A / B -------------------------------------------------------------------------------
    @property
    def path_rows(self) -> DataFrame:
        """A row a path with its literals."""
        return self._get("path_rows", lambda: P.path_rows(P.path_parts(self.paths)))

    @property
    def info(self) -> DataFrame:
        """What is asked of a path, with the forms of its scopes; see `path_info`."""
        return self._get("info", lambda: path_info(self.path_rows))

    @property
    def plits(self) -> DataFrame:
        """Typed path literals."""
        return self._get("plits", lambda: P.row_literals(self.path_rows))

    @property
    def rule_stage(self) -> tuple[DataFrame, DataFrame]:
        return self._get("rules", lambda: prepare_rules(self.rules, self.checkpoint))

    @property
    def state(self) -> DataFrame:
        return self.rule_stage[0]

    @property
    def rlits(self) -> DataFrame:
        return self.rule_stage[1]

    # ---- C: similarity matching of crisp literals ---------------------------------------------
    @property
    def matches(self) -> DataFrame:
        def build():
            crisp_keys = self.state.where(F.col("screen") == "crisp").select(*KEYS)
            c_lits = self.rlits.join(crisp_keys, KEYS, "left_semi")
            m = L.best_match(c_lits.select(*KEYS, "slot", "var", "op", "sval", "nval"),
                             self.plits.select("unit", "path_no", "pos", "var", "op", "sval", "nval"),
                             self.exempt_names)
            # read by the similarity fold, the source gate and the decision: cut it once
            return materialize(m) if self.checkpoint else m
        return self._get("matches", build)

    @property
    def rewritten(self) -> DataFrame:
        return self._get("rewritten", lambda: L.rewrite_rule(self.matches))

    @property
    def w_typed(self) -> DataFrame:
        return self._get("w_typed", lambda: R.typed_literals(
            self.rewritten.where(F.col("w_var").isNotNull())
            .select(*KEYS, "slot", F.col("w_var").alias("var"), F.col("w_op").alias("op"),
                    F.col("w_sval").alias("sval"), F.col("w_nval").alias("nval"))))

    @property
    def st(self) -> DataFrame:
        return self._get("st", self._build_state)

    def _build_state(self) -> DataFrame:
        info, state, rlits, matches, w_typed = self.info, self.state, self.rlits, self.matches, self.w_typed
        sims = (matches.groupBy(*KEYS).agg(
            F.sort_array(F.collect_list(F.struct("slot", "sim"))).alias("s"),
            F.bool_and(F.col("sim") > 0).alias("all_matched")))
        w_agg = w_typed.groupBy(*KEYS).agg(
            F.collect_set("var").alias("w_names"),
            F.collect_set(F.when(F.col("sval") != "", F.col("sval"))).alias("svals"),
            F.bool_or(F.col("sort") == "E").alias("w_empty"))
        lit_flags = rlits.groupBy(*KEYS).agg(
            F.bool_or(F.col("lit_error").isNotNull()).alias("lit_err"),
            F.bool_or(F.col("sort") == "E").alias("empty_val"),
            F.bool_or(R.symbols_expr(F.col("var"), F.col("sval"))).alias("symbols"),
            F.collect_set("var").alias("l_names"))

        st = (state.join(lit_flags, KEYS, "left").join(sims, KEYS, "left").join(w_agg, KEYS, "left")
              .withColumn("similarity", F.when(F.col("all_matched") & F.col("rpn").isNotNull(),
                                               L.fold_similarity(F.col("rpn"), F.transform("s", lambda x: x["sim"]))))
              .withColumn("names", F.when(F.col("screen") == "crisp", F.col("w_names"))
                          .otherwise(F.array_union(F.coalesce("l_names", _empty()), F.coalesce("right_names", _empty())))))

        # ---- source gate: every checked name occurs in the unit's source (else its observed paths) ----
        name_rows = st.where(F.col("names").isNotNull()).select(*KEYS, F.explode("names").alias("name"))
        found = R.names_in_source(name_rows, info.select("unit", F.col("line").alias("text")) if self.sources is None else self.sources, KEYS)
        self._cache["found"] = found
        bad_units = info.where("path_error").select("unit").distinct().withColumn("unit_path_error", F.lit(True))
        st = st.join(found, KEYS, "left").join(bad_units, "unit", "left")

        multi = F.col("n_slots") > 1
        crisp_reason = _first_reason(
            (_flag("lit_err") & multi, "quarantine:numeric_left_equality"),
            (F.col("dnf").isNull() & multi, "quarantine:skeleton"),
            (_flag("empty_val") & multi, "quarantine:empty_value"),
            (_flag("symbols"), "skip:symbols"),
            (_flag("unit_path_error"), "quarantine:path_parse"),
            (~_flag("all_matched") & (F.col("n_slots") > 0), "quarantine:no_match"),
            (F.coalesce(F.col("n_slots"), F.lit(0)) <= 1, "skip:single_literal"),
            (F.col("rpn").isNull(), "quarantine:similarity_fold"),
            (L.similarity_gate(F.col("similarity")), "skip:similarity_gate"),
            (~_flag("in_source"), "skip:names_absent"),
            (_flag("w_empty"), "undecided:empty_value"),
        )
        fuzzy_reason = _first_reason(
            (F.col("exist_flag").isNull(), "quarantine:fuzzy_word_left_only"),
            (_flag("lit_err") & multi, "quarantine:numeric_left_equality"),
            (F.col("dnf").isNull(), "quarantine:skeleton"),
            (_flag("empty_val") & multi, "quarantine:empty_value"),
            (~_flag("in_source"), "skip:names_absent"),
        )
        st = st.withColumn("reason", F.when(F.col("screen") == "crisp", crisp_reason)
                           .when(F.col("screen") == "fuzzy", fuzzy_reason)
                           .otherwise(F.concat(F.lit("skip:"), F.col("screen"))))
        if self.checkpoint:
            st = materialize(st)
        return st


    # ---- D: decision ---------------------------------------------------------------------------
    @property
    def decision(self) -> dict[str, DataFrame]:
        return self._get("decision", self._build_decision)

    def _build_decision(self) -> dict[str, DataFrame]:
        st, w_typed, rlits, info = self.st, self.w_typed, self.rlits, self.info
        ready = st.where(F.col("reason").isNull())
        checked = (w_typed.join(ready.where(F.col("screen") == "crisp").select(*KEYS), KEYS, "left_semi")
                   .unionByName(rlits.join(ready.where(F.col("screen") == "fuzzy").select(*KEYS), KEYS, "left_semi")
                                .select(*w_typed.columns)))
        clauses = (ready.select(*KEYS, F.posexplode("dnf").alias("clause_id", "lits"))
                   .select(*KEYS, F.col("clause_id").cast("int").alias("clause_id"), F.explode("lits").alias("signed"))
                   .select(*KEYS, "clause_id", (F.abs("signed") - 1).alias("slot"), (F.col("signed") < 0).alias("negated")))
        rules = decide.rule_forms(decide.clause_literals(checked, clauses))
        if self.checkpoint:
            rules = materialize(rules)
        scopes = info.where("first").select("unit", "path_no", F.explode(F.create_map(F.lit("full"), "full", F.lit("err"), "err")).alias("scope", "forms"))
        sat = decide.sat_pairs(rules, scopes.where(F.col("forms").isNotNull()))

        # rules and paths of a unit meet once; what they say of each other is decided in that row
        pairs = (ready.select(*KEYS, "screen", "names", F.coalesce("svals", _empty()).alias("svals"),
                              F.coalesce("vars", _empty()).alias("vars"), "exist_flag")
                 .join(rules, KEYS, "left").join(info.drop("first"), "unit")
                 .withColumn("sat_full", decide.can_hold(F.col("forms"), F.col("full")))
                 .withColumn("sat_err", decide.can_hold(F.col("forms"), F.col("err")))
                 .drop("forms", "full", "err"))
        covered = decide.covers(F.col("names"), F.col("pnames"))
        err_cover = decide.covers(F.col("names"), F.col("err_names"))
        values_in = F.forall("svals", lambda v: F.col("line").contains(v))
        left = F.trim(F.expr("substring(line, 1, greatest(length(line) - length(substring_index(line, '->', -1)) - 2, 0))"))
        right = F.trim(F.expr("substring(line, length(line) - length(substring_index(line, '->', -1)) - 1)"))
        text_cover = F.forall("names", lambda n: F.col("line").contains(n))
        is_err = F.col("kind") == "error"
        crisp_result = (F.when(F.col("path_error"), F.lit(True))
                        .when(~covered, F.lit(False))
                        .when(is_err, F.when(err_cover & values_in, ~F.col("sat_full")))
                        .otherwise(F.col("sat_full")))
        crisp_hit = ~F.col("path_error") & covered & is_err & err_cover & values_in & F.col("sat_err")
        fuzzy_result = (F.when(~text_cover, F.lit(None).cast("boolean"))
                        .when(F.col("path_error"), F.lit(True))
                        .when(~covered, F.lit(False))
                        .otherwise(F.col("sat_full") & decide.existence_expr(F.col("vars"), F.col("exist_flag"), left, right)))
        results = pairs.select(*KEYS, "path_no", "kind", F.col("screen").alias("mode"),
                               F.when(F.col("screen") == "crisp", crisp_result).otherwise(fuzzy_result).alias("result"),
                               F.when(F.col("screen") == "crisp", crisp_hit).otherwise(F.lit(False)).alias("hit"))
        verdicts = decide.verdict(results)

        checks = pairs.select(*KEYS, "path_no", covered.alias("covered"), err_cover.alias("err_cover"),
                              values_in.alias("values_in"))
        return {"sat": sat, "pairs": pairs, "checks": checks, "results": results, "verdicts": verdicts}

    @property
    def verdicts(self) -> DataFrame:
        return self.decision["verdicts"]

    @property
    def found(self) -> DataFrame:
        self.st
        return self._cache["found"]

    def entailment(self) -> DataFrame:
        """V2 for the crisp rules still standing, over every path of their unit."""
        st, w_typed, info = self.st, self.w_typed, self.info
        ready = st.where(F.col("reason").isNull() & (F.col("screen") == "crisp"))
        checked = w_typed.join(ready.select(*KEYS), KEYS, "left_semi")
        clauses = (ready.select(*KEYS, F.posexplode("dnf").alias("clause_id", "lits"))
                   .select(*KEYS, F.col("clause_id").cast("int").alias("clause_id"), F.explode("lits").alias("signed"))
                   .select(*KEYS, "clause_id", (F.abs("signed") - 1).alias("slot"), (F.col("signed") < 0).alias("negated")))
        keys = ["unit", "path_no"]
        negated = P.with_logic(self.path_rows.where("alone"), keys, [True]).select(*keys, decide.row_forms("not").alias("forms"))
        others = self.path_rows.where("not alone")
        if not others.isEmpty():
            negated = negated.unionByName(decide.path_forms(decide.negated_path_scopes(
                P.row_literals(others), P.path_clauses(others, negate=True))).select(*negated.columns))
        return decide.entails(ready.select(*KEYS, "names"), info.select("unit", "path_no", "kind", "pnames"),
                              decide.rule_forms(decide.clause_literals(checked, clauses)), negated,
                              decide.covers(F.col("names"), F.col("pnames")))

    def findings(self) -> DataFrame:
        """V7: every BAD rule with its text and an example path (the first path that
        raised for BAD_ERROR, else the first path whose result is false)."""
        rep = self.report().where(F.col("verdict").startswith("BAD"))
        res = self.decision["results"]
        example = (res.join(rep.select(*KEYS, "verdict"), KEYS)
                   .where(F.when(F.col("verdict") == "BAD_ERROR", F.col("hit")).otherwise(F.col("result") == False))  # noqa: E712
                   .groupBy(*KEYS).agg(F.min("path_no").alias("path_no")))
        return (rep.select(*KEYS, F.col("verdict").alias("kind"))
                .join(self.rules.select(*KEYS, "text"), KEYS)
                .join(example, KEYS, "left")
                .join(self.info.select("unit", "path_no", "line"), ["unit", "path_no"], "left")
                .select(*KEYS, "kind", "text", "path_no", "line"))

    def report(self) -> DataFrame:
        """V6 output: one row per rule."""
        st, verdicts = self.st, self.verdicts
        out = st.join(verdicts.select(*KEYS, "verdict", "n_results", "n_true"), KEYS, "left")
        status = (F.when(F.col("reason").startswith("skip:"), F.lit("SKIPPED"))
                  .when(F.col("reason").startswith("quarantine:"), F.lit("QUARANTINED"))
                  .when(F.col("reason").startswith("undecided:"), F.lit("UNDECIDED"))
                  .otherwise(F.coalesce(F.col("verdict"), F.lit("CONSISTENT"))))
        return out.select(*KEYS, "screen", status.alias("verdict"), "reason",
                          F.when(F.col("screen") == "crisp", F.round(F.col("similarity") * 100).cast("int"))
                          .alias("similarity"),
                          F.coalesce("n_results", F.lit(0)).alias("n_results"),
                          F.coalesce("n_true", F.lit(0)).alias("n_true"))


def audit(rules: DataFrame, paths: DataFrame, exempt_names: Sequence[str] = (),
          checkpoint: bool = True, sources: DataFrame | None = None) -> DataFrame:
    """One row per rule: unit, rule_id, screen, verdict, reason, similarity (hundredths),
    n_results, n_true. ``sources`` (unit, text): where a rule's names must occur (none: paths).

    verdict: BAD | BAD_ERROR | BAD_FUZZY | CONSISTENT | SKIPPED | QUARANTINED | UNDECIDED."""
    return AuditPlan(rules, paths, exempt_names, checkpoint, sources).report()
