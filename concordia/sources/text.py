"""Text scans: line tables, last lines, run-log parsing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordia.functions.scan import exclusive_scan
from concordia.session import materialize

# FIXED VALUES: counter lines printed by a run ("NAME: number") and the verdict line.
VERDICT_LINE = "BAD CONSTRAINT"
COUNTER_RE = r"^([A-Za-z][A-Za-z _]*): (-?[0-9]+)$"
# FIXED VALUES: titles of finding blocks, the fields in them, fences, results lines, colour marks.
FINDINGS = {"BAD CONSTRAINT": "BAD", "BAD CONSTRAINT WITH ERROR": "BAD_ERROR", "BAD CONSTRAINT WITH FUZZY": "BAD_FUZZY"}
FINDING_FIELDS = {"Type": "kind", "path": "path", "Library": "library", "Class": "unit", "Memberfunc": "member",
                  "Function": "func", "Constraint": "rule", "path file": "path_file"}
TITLE_RE = r"^\[ (BAD CONSTRAINT[A-Z ]*) \]$"
FIELD_RE = r"^([A-Za-z ]+): (.*)$"
FENCE_RE = r"^#{20,}$"
RESULTS_RE = r"^normal results: (\[.*\])$"
COLOUR_RE = r"\x1B\[[0-9;]*m"
# a line that any of the steps below reads
FINDING_LINE_RE = "|".join((TITLE_RE, FENCE_RE, RESULTS_RE, "^(?:" + "|".join(FINDING_FIELDS) + "): (.*)$"))


def scan_lines(df: DataFrame, key: str | Sequence[str], text: str = "text") -> DataFrame:
    """Ordered line table ``keys + (line_no, line)``; every line right-stripped of
    whitespace, lines numbered from 1 in text order."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
            .select(*keys, (F.col("line_no") + 1).cast("int").alias("line_no"),
                    F.regexp_replace("line", r"[ \t\r\f\x0B]+$", "").alias("line")))


def last_line(lines: DataFrame, key: str = "file") -> DataFrame:
    """The last line of every text (``max_by`` — no sort, no window)."""
    return lines.groupBy(key).agg(F.max_by("line", "line_no").alias("last_line"))


def parse_run_log(lines: DataFrame, key: str = "file") -> DataFrame:
    """Counters and verdict lines back out of run logs: per (file, metric) the
    number of lines and the summed value (verdict lines count, value null)."""
    metric = F.when(F.col("line") == VERDICT_LINE, F.lit(VERDICT_LINE)).otherwise(
        F.regexp_extract("line", COUNTER_RE, 1))
    value = F.when(F.col("line") == VERDICT_LINE, F.lit(None).cast("long")).otherwise(
        F.regexp_extract("line", COUNTER_RE, 2).cast("long"))
    parsed = lines.select(key, metric.alias("metric"), value.alias("value")).where(F.col("metric") != "")
    return parsed.groupBy(key, "metric").agg(F.count(F.lit(1)).alias("n_lines"),
                                             F.sum("value").alias("total"))


def parse_findings(lines: DataFrame, key: str = "file") -> DataFrame:
    """Finding blocks of run logs, ``key, line_no, verdict, kind, path, library, unit, member,
    func, rule, path_file, n_results, n_true``.

    A block is a title line, a fence, ``name: value`` lines and a fence; a fence without a title
    opens none. The result flags are those of the last results line before the title (null: none).
    The reader's state (line of the last title, fences since, line of the last results) is scanned
    in chunks, so a log of any length is spread over tasks; lines that change no state and hold no
    field are left out of it. A block that never closes ends with its log; of a field written twice
    the first counts; colour marks are dropped."""
    plain = lines.select(key, "line_no", F.regexp_replace("line", COLOUR_RE, "").alias("line")).where(F.col("line").rlike(FINDING_LINE_RE))
    plain = materialize(plain.select(  # each line is taken apart once
        key, "line_no", F.regexp_extract("line", TITLE_RE, 1).alias("title"), F.regexp_extract("line", RESULTS_RE, 1).alias("flags"),
        F.col("line").rlike(FENCE_RE).alias("fence"), F.regexp_extract("line", FIELD_RE, 1).alias("name"), F.regexp_extract("line", FIELD_RE, 2).alias("value")))
    title, flags, fence = F.col("title"), F.col("flags"), F.col("fence")
    none = F.lit(None).cast("int")
    steps = plain.withColumn("step", F.struct(F.when(title != "", F.col("line_no")).alias("title"), fence.cast("long").alias("fences"),
                                              F.when(flags != "", F.col("line_no")).alias("results")))

    def then(a: Column, b: Column) -> Column:
        return F.struct(F.coalesce(b["title"], a["title"]).alias("title"),
                        F.when(b["title"].isNotNull(), b["fences"]).otherwise(a["fences"] + b["fences"]).alias("fences"),
                        F.coalesce(b["results"], a["results"]).alias("results"))

    read = materialize(exclusive_scan(steps, [key], "line_no", "step", F.struct(none.alias("title"), F.lit(0).cast("long").alias("fences"), none.alias("results")), then)
                       .where(F.col("before.title").isNotNull() | (title != "") | (flags != "")).drop("step"))
    inside = (read.where((F.col("before.fences") == 1) & F.col("before.title").isNotNull() & ~fence)
              .select(key, F.col("before.title").alias("title"), "line_no", "name", "value"))
    fields = inside.groupBy(key, F.col("title").alias("line_no")).agg(
        *(F.min_by("value", F.when(F.col("name") == n, F.col("line_no"))).alias(c) for n, c in FINDING_FIELDS.items()))
    verdict = F.create_map(*(F.lit(x) for pair in FINDINGS.items() for x in pair))
    heads = read.where(title.isin(*FINDINGS)).select(key, "line_no", verdict[title].alias("verdict"), F.col("before.results").alias("results"))
    results = read.where(flags != "").select(key, F.col("line_no").alias("results"), F.from_json(F.lower(flags), "array<boolean>").alias("flags"))
    return (heads.join(fields, [key, "line_no"], "left").join(results, [key, "results"], "left")
            .select(key, "line_no", "verdict", *FINDING_FIELDS.values(),
                    F.when(F.col("flags").isNotNull(), F.size("flags")).cast("long").alias("n_results"),
                    F.when(F.col("flags").isNotNull(), F.size(F.filter("flags", lambda x: x))).cast("long").alias("n_true")))


def scan_rule_blocks(lines: DataFrame, key: str = "unit") -> DataFrame:
    """Rules written in an answer text, ``key, line_no, rule``.

    A line naming the logical format (and holding ``:``) gives its rule: the value after
    the last ``:`` of that line, or of the next line when that one is fenced, or of the
    line after a bare fence (when that is not blank); ``*`.`` and blanks are trimmed at
    both ends and only texts with ``->`` are rules."""
    clean = lambda c: F.expr(f"trim(BOTH '*`. \\n' FROM substring_index({c}, ':', -1))")
    marker = ((F.col("line").contains("Logical format") | F.col("line").contains("Logical Format"))
              & F.col("line").contains(":"))
    # the two lines after each marker come by place, so no task sees a whole text
    marked = lines.where(marker).select(key, "line_no", "line")
    after = (marked.select(key, "line_no", F.explode(F.array(F.lit(1), F.lit(2))).alias("ahead"))
             .withColumn("at", F.col("line_no") + F.col("ahead"))
             .join(lines.select(key, F.col("line_no").alias("at"), F.col("line").alias("next")), [key, "at"])
             .groupBy(key, "line_no").agg(*(F.max(F.when(F.col("ahead") == n, F.col("next"))).alias(c) for n, c in ((1, "nxt"), (2, "nxt2")))))
    staged = marked.join(after, [key, "line_no"], "left").fillna("", ["nxt", "nxt2"])
    rule = (F.when(F.col("nxt").contains("```"),
                   F.when(F.trim("nxt") == "```", F.when(F.trim("nxt2") != "", clean("nxt2")))
                   .otherwise(clean("nxt")))
            .otherwise(clean("line")))
    return (staged.select(key, "line_no", rule.alias("rule"))
            .where(F.col("rule").contains("->")))


def lookup_case(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Per case id the audited unit (class, or the function when the class is 'NA'),
    its rule and its oracle; of several records with one id the last one wins."""
    last = cases.groupBy("id").agg(F.max_by(F.struct("class", "func", "constraints", "oracle"), "doc_id").alias("c"))
    return (ids.select(F.col("case_id").alias("id")).distinct().join(last, "id")
            .select(F.col("id").alias("case_id"),
                    F.when(F.col("c.class") == "NA", F.col("c.func")).otherwise(F.col("c.class")).alias("unit"),
                    F.trim(F.substring_index("c.constraints", ":", -1)).alias("rule_text"),
                    F.col("c.oracle").alias("oracle")))


def attach_results(results: DataFrame, units: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Results placed only on units that exist, with the unit's columns."""
    return results.join(units, list(keys))


def place_results(placed: DataFrame, root: str, by: Sequence[str] = ("project", "unit")) -> None:
    """S7 sink: a folder a value of ``by``. Rows are rebalanced, so the files of small folders
    are gathered and a folder that holds a third of all rows is written by several tasks."""
    placed.hint("rebalance", *map(F.col, by)).write.partitionBy(*by).parquet(root)


def read_placed(spark: SparkSession, root: str, schema: StructType, **where: object) -> DataFrame:
    """Placed results, of the folders of ``where`` only; a value of None is the null folder."""
    df = spark.read.schema(schema).parquet(root)
    for name, value in where.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value).cast(schema[name].dataType)))
    return df
