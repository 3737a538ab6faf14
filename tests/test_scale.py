"""What keeps large inputs cheap gives the same results, on in-line rows."""
import random

from concordia import session
from concordia.functions.exprs import is_number
from concordia.functions.scan import exclusive_scan
from concordia.operators import extract as E, paths as P, rules as R, similarity as L
from concordia.session import SHUFFLE_CLEANUP, materialize
from concordia.sources import structured as ST
from pyspark.sql import functions as F


def test_scan_broadcasts_nothing(spark):
    rows = spark.range(1, 1001).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("n"), F.lit(1).alias("v"))
    done = exclusive_scan(rows, ["k"], "n", "v", F.lit(0), lambda a, b: a + b)
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.where("before <> n - 1").count() == 0 and done.count() == 1000


def test_cut_tables_are_files_with_the_same_rows(spark):
    rows = spark.sql("select id, array(struct(id as a, null as b)) as x, cast(null as string) as s, 'é' as t from range(5) "
                     "union all select null, array(), 's', ''").selectExpr("id", "transform(x, y -> y.a) as x", "s", "t")
    cut = materialize(rows)
    assert cut.inputFiles() and sorted(map(repr, cut.collect())) == sorted(map(repr, rows.collect()))
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"


def test_masked_parentheses_equal_the_folds(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("(()) a\n\x01" if i % 20 == 0 else "(()) a\n") for _ in range(r.randint(0, 25))) for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "((((((a))))))", "((((((a)))))", ")(", "$1(\\2)"]], "t string")
    assert df.where(~P.balance_parens(F.col("t")).eqNullSafe(P._balance_by_folds(F.col("t")))).count() == 0


def test_numbers_are_what_casts(spark):
    texts = ["1", " 1 ", "\t-2.5", "+.5", ".", "", " ", "nan", "NaN", "Infinity", "-inf", "+Infinity", "inf", "name", "1d", "1f", "0x1p3", "1e5", "e5",
             "infinite", "\x00 7", "n", "i", "--1", "quantity", "é1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.coalesce(F.col("t").try_cast("double").isNotNull() & (F.length("t") > 0), F.lit(False))
    assert df.where(is_number(F.col("t")) != old).count() == 0


def test_large_units_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(L, "SPLIT", 3)
    lits = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 0)], "unit string, pos int")
    assert [tuple(r) for r in L.large_units(lits).collect()] == [("a", 3)]


def test_rules_are_not_sorted_for_their_templates(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["{} -> {}", "({}) && {}", None, "{}", "{} -> {}"])], "i int, templated string")
    want = sorted(map(repr, R.skeleton_columns(rows, ["i"]).collect()))
    for few, join in ((R.TEMPLATES, "BroadcastHashJoin"), (1, "ShuffledHashJoin")):
        monkeypatch.setattr(R, "TEMPLATES", few)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = R.skeleton_columns(rows, ["i"])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert join in plan and "SortMergeJoin" not in plan and sorted(map(repr, got.collect())) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 10)
    raw = spark.createDataFrame([("p", i, "", "param", 0, "a,b", "d") for i in range(400)],
                                "project string, unit long, member string, section string, pos int, name string, descr string")
    params = E.param_table(raw)
    assert params.rdd.getNumPartitions() == 40 and params.count() == 800
    json = ST.write_param_json(params, E.overlay_params(params))
    assert json.rdd.getNumPartitions() == 80 and ST.read_param_json(json).count() == 1600


def test_texts_of_a_small_table_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    spark.range(60).selectExpr("id % 50 as k", "'a' as text").coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    dealt = session.spread(table, "k")
    assert table.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, table.collect()))
    monkeypatch.setattr(session, "TEXTS", 1)
    assert session.spread(table, "k").rdd.getNumPartitions() == 60
    sizes = session.spread(table, "k").rdd.glom().map(len).collect()
    assert max(sizes) < 20


def test_cuts_run_no_method_the_jvm_leaves_interpreted(spark, monkeypatch):
    before, seen = spark.conf.get(session.HUGE_METHOD), []
    rows = spark.range(3)
    writer = type(rows.write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(session.HUGE_METHOD)), parquet(self, *a, **k))[1])
    assert materialize(rows).count() == 3 and seen == ["8000"] and spark.conf.get(session.HUGE_METHOD) == before


def test_decision_table_reads_its_rows_and_paths_once(spark):
    from concordia.operators import trees as Tr

    rows = spark.createDataFrame([(1, "a", 3, 2), (1, "b", None, 1), (2, "a", 3, 1), (None, "a", 3, 1)], "unit int, name string, size int, n_rows int")
    rows = rows.groupBy("unit", "name", "size").agg(F.sum("n_rows").alias("n_rows"))
    parts = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "unit int, path_no int, effect string")
    lits = spark.createDataFrame([(1, 1, "name", "S", "=", None, "a"), (1, 1, "size", "R", ">", 3.0, None), (1, 2, "size", "R", "<=", 3.0, None),
                                  (2, 1, "name", "S", "!=", None, "b")], "unit int, path_no int, var string, sort string, rop string, num double, sv string")
    done = Tr.apply_decision_table(rows, parts, lits, {"name": "name"}, {"size": "size"})
    assert sorted(map(str, done.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "a", 3, 2, 2, "y"), (1, "b", None, 1, None, "Unknown"), (2, "a", 3, 1, 1, "z"), (None, "a", 3, 1, None, "Unknown")], done.schema).collect()))
    assert "Union" not in done._jdf.queryExecution().executedPlan().toString()


def test_sources_are_written_by_all_cores(spark, tmp_path):
    from concordia.plans.registry import REGISTRY

    spark.range(1, 61).selectExpr("id as p_partkey", "'n' as p_name", "concat('T', id % 3) as p_type", "'b' as p_brand", "cast(id % 9 as int) as p_size",
                                  "1.5D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    done = REGISTRY["s1_scan_sources"][0](spark, str(tmp_path))
    assert done.count() == 54 and len({f.rsplit("/", 1)[1].split("-")[1] for f in done.inputFiles()}) > 1
