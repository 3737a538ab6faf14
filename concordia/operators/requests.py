"""Annotation-request preparation (T1-T3): rendered parameter docs, chunked texts and
chat message arrays.  No model is called; the request table is the output."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators.extract import UNIT

CHUNK_SIZE = 1500      # FIXED VALUE: characters per chunk
CHUNK_MIN_LEN = 1000   # FIXED VALUE: only longer texts are chunked

# Message templates (parameters of build_messages; our own wording).
SYSTEM_TEMPLATE = "You review API documentation as an experienced Python developer."
TASK_TEMPLATE = "Keep this parameter list in mind: [{params}]. List every parameter with its type and default."
CLOSING_TEMPLATES = (
    "Now state every constraint between parameters described in the text.",
    "Write each constraint in the rule format: -> for implication, ! for not, ^ for and, || for or.",
)


def render_doc(params: DataFrame) -> DataFrame:
    """``project, unit, member, text, param_list`` from an expanded parameter table (section, name,
    descr, order): a Parameters block, an Attributes block, and the overlay's names."""
    entry = F.struct("order", "name", "descr")
    per_unit = params.groupBy(*UNIT).agg(
        F.sort_array(F.collect_list(F.when(F.col("section") == "param", entry))).alias("ps"),
        F.sort_array(F.collect_list(F.when(F.col("section") == "attr", entry))).alias("ats"))
    lines = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat(F.lit("\n"), x["name"], F.lit(":"), x["descr"])), "")
    text = F.concat(
        F.when(F.size("ps") > 0, F.lit("Parameters\n----------")).otherwise(F.lit("")), lines(F.col("ps")),
        F.when(F.size("ats") > 0, F.lit("\nAttributes\n----------")).otherwise(F.lit("")), lines(F.col("ats")))
    pnames = F.transform("ps", lambda x: x["name"])
    anames = F.filter(F.transform("ats", lambda x: x["name"]), lambda n: ~F.array_contains(pnames, n))
    return per_unit.select(*UNIT, text.alias("text"), F.array_join(F.concat(pnames, anames), ",").alias("param_list"))


def chunk_text(df: DataFrame, key: str, text: str = "text", size: int = CHUNK_SIZE,
               min_len: int = CHUNK_MIN_LEN) -> DataFrame:
    """Texts longer than ``min_len`` cut into ``size``-character chunks, each wrapped
    in START/END markers with its index, the total and the key."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    rows = (df.where(F.length(text) > min_len)
            .select(F.col(key).alias("key"), F.col(text).alias("t"), n.alias("n"), F.posexplode(starts).alias("i0", "start")))
    i = (F.col("i0") + 1).cast("int")
    head = F.concat(F.lit("[START CHUNK "), i.cast("string"), F.lit("/"), F.col("n").cast("string"),
                    F.lit("]\n### "), F.col("key").cast("string"), F.lit(" ###\n"))
    tail = F.concat(F.lit("\n[END CHUNK "), i.cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]"))
    return rows.select("key", i.alias("i"), "n",
                       F.concat(head, F.expr(f"substring(t, start + 1, {size})"), tail).alias("chunk"))


def build_messages(docs: DataFrame, key: str = "unit", text: str = "text", params: str = "param_list",
                   min_len: int = CHUNK_MIN_LEN) -> DataFrame:
    """``key, messages array<struct<role, content>>``: system, task, then the text
    (or its chunks when long), then the two closing instructions."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    chunks = (chunk_text(docs, key, text, min_len=min_len)
              .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "chunk"))).alias("cs")))
    j = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(params).alias("p")).join(chunks, "key", "left")
    task = F.expr("replace({tpl}, '{{params}}', p)".format(tpl="'" + TASK_TEMPLATE.replace("'", "''") + "'"))
    body = F.when(F.col("cs").isNotNull(), F.transform("cs", lambda c: msg("user", c["chunk"]))).otherwise(
        F.array(msg("user", F.col("t"))))
    messages = F.concat(F.array(msg("system", F.lit(SYSTEM_TEMPLATE)), msg("user", task)), body,
                        F.array(*[msg("user", F.lit(c)) for c in CLOSING_TEMPLATES]))
    return j.select(F.col("key").alias(key), messages.alias("messages"))
