"""Imports of a file that has many symbols of a name."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom import plan_queries, queries  # noqa: F401
from codeloom.plans import resolve

N_IMPORTS, N_SYMBOLS = 300, 400


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Tables whose imports (two of three have a name) all mean file 4, where each symbol is of that name; some that match nothing; and
    files with one export."""
    folder = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    for name, sql in {
        "part": "SELECT i AS p_partkey, 1 AS p_size FROM range(200) r(i)",
        "orders": f"SELECT 97 * i AS o_orderkey, 3::BIGINT AS o_custkey FROM range({N_SYMBOLS}) r(i) UNION ALL SELECT 100_004 + 10 * i, 4 + i FROM range(90) r(i)",
        "events": f"SELECT 12_804 + 19_400 * i + CASE WHEN i % 10 = 9 THEN 3 ELSE 0 END AS event_id, 3::BIGINT AS user_id FROM range({N_IMPORTS}) r(i)",
        "lineitem": "SELECT 0::BIGINT AS l_orderkey, 0::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey, 1 AS l_linenumber, 1.0::DOUBLE AS l_quantity, 'R' AS l_returnflag, 'F' AS l_linestatus WHERE FALSE",
    }.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


def shuffled(spark, make) -> tuple[list[tuple], int]:
    """The rows that ``make`` gives, sorted, and the rows written to shuffles for them."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = sorted(map(tuple, make().collect()), key=str)
    return rows, written() - before


@pytest.fixture
def large(spark, monkeypatch):
    """Tables are joined by shuffle, as large ones are."""
    names = ["spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"]
    was = {n: spark.conf.get(n, None) for n in names}
    monkeypatch.setattr(resolve, "measured_broadcasts", lambda session: [session.conf.set(n, "-1") for n in names])
    yield
    for n, value in was.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_pairs_of_imports_and_symbols_are_not_shuffled(spark, hot, large):
    folder, con = hot
    want = con.execute(queries.ORACLES["import_targets"]).fetchall()
    assert len(want) > N_IMPORTS * N_SYMBOLS // 2
    rows, written = shuffled(spark, lambda: queries.QUERIES["import_targets"](spark, folder).select("import_id", "target_file_id", "target_symbol_id"))
    assert rows == sorted(want, key=str)
    assert written < 10 * (N_IMPORTS + N_SYMBOLS)


def test_named_default_and_open_imports(spark):
    """Names, the one export of a module as a whole, repeated ids and sources, and rows without a source, name or file."""
    files = spark.createDataFrame([(1, "a.ts", 1), (2, "b.ts", 1), (3, "c.ts", 1), (4, "a.py", 1), (5, "b.py", 2)], "file_id long, path string, repository_id long")
    symbols = spark.createDataFrame([(10, 2, "x", "FUNCTION", True), (11, 2, "x", "CLASS", False), (12, 2, "y", "METHOD", True), (13, 3, "", "FUNCTION", True), (14, 3, "z", "CLASS", True), (15, 4, "x", "CLASS", None)], "symbol_id long, file_id long, name string, kind string, exported boolean")
    rows = [
        (1, 1, "./b", "x", None, "es_module"), (2, 1, "./b", None, "all", "es_module"), (3, 1, "./b", None, None, "es_module"), (4, 1, "./c", None, "all", "es_module"), (5, 1, "./c", "", "e", "es_module"),
        (6, 1, None, "x", None, "es_module"), (7, 1, "./gone", None, "all", "es_module"), (8, 4, "a", "x", None, "python_from_import"), (9, 5, "a", "x", None, "python_from_import"), (10, 4, None, None, None, "python_import"),
        (11, 4, "a.x", "x", "w", "python_from_import"), (12, 99, "a", "x", None, "python_from_import"), (13, 1, "./b", None, "all", "commonjs"), (14, 1, "./b", "x", "again", "es_module"),
    ]
    imports = spark.createDataFrame(rows, "import_id long, file_id long, source string, imported_name string, alias string, kind string")
    got = resolve.resolved_imports(files, symbols, imports.withColumn("start_line", F.lit(1)))
    assert sorted((r["import_id"], r["target_file_id"], r["target_symbol_id"], r["target_kind"]) for r in got.where("import_id NOT IN (3, 6, 7, 9, 10, 13, 4)").collect()) == [
        (1, 2, 10, "FUNCTION"), (1, 2, 11, "CLASS"), (2, 2, 10, "FUNCTION"), (5, 3, 13, "FUNCTION"), (8, 4, 15, "CLASS"), (11, 4, 15, "CLASS"), (14, 2, 10, "FUNCTION"), (14, 2, 11, "CLASS"),
    ]
    without = {r["import_id"]: (r["target_file_id"], r["target_symbol_id"], r["path"]) for r in got.where("import_id IN (3, 6, 7, 9, 10, 13, 4)").collect()}
    assert without == {3: (2, None, "a.ts"), 4: (3, None, "a.ts"), 6: (None, None, "a.ts"), 7: (None, None, "a.ts"), 9: (None, None, "b.py"), 10: (None, None, "a.py"), 13: (2, None, "a.ts")}


def joined(plan) -> list[int]:
    """The rows that each join of a plan that ran has made."""
    kind = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") else []
    return own + [n for p in inner for n in joined(p)]


def test_bindings_make_no_pairs(spark, hot, large):
    folder, con = hot
    want = con.execute(queries.ORACLES["import_bindings"]).fetchall()
    made = queries.QUERIES["import_bindings"](spark, folder).select("file_id", "name", "bound_symbol_id")
    rows, written = shuffled(spark, lambda: made)
    assert rows == sorted(want, key=str) and rows
    rows_of_joins = joined(made._jdf.queryExecution().executedPlan())
    assert rows_of_joins and max(rows_of_joins) <= 2 * (N_IMPORTS + N_SYMBOLS) and written < 10 * (N_IMPORTS + N_SYMBOLS)


def test_bindings_of_first_symbols_are_those_of_all(spark):
    files = spark.createDataFrame([(1, "a.ts"), (2, "b.ts"), (3, "c.ts"), (4, "d.py"), (5, "e.py")], "file_id long, path string")
    symbols = spark.createDataFrame([(12, 2, "x", "CLASS", True), (11, 2, "x", "METHOD", False), (13, 3, "x", "FUNCTION", True), (21, 4, "y", "CLASS", None), (20, 4, "y", "METHOD", None)], "symbol_id long, file_id long, name string, kind string, exported boolean")
    rows = [(1, 1, "./c", "x", None, "es_module"), (2, 1, "./b", "x", None, "es_module"), (3, 1, "./gone", "x", None, "es_module"), (4, 1, "./b", None, "z", "es_module"), (5, 1, "./c", "x", "z", "es_module"), (6, 1, "./c", None, "w", "es_module"), (7, 5, "d", "y", None, "python_from_import"), (8, 5, "d", "y", "q", "python_from_import")]
    imports = spark.createDataFrame(rows, "import_id long, file_id long, source string, imported_name string, alias string, kind string")
    want = [(1, "w", 13, "FUNCTION"), (1, "x", 11, "METHOD"), (1, "z", 13, "FUNCTION"), (5, "q", 20, "METHOD"), (5, "y", 20, "METHOD")]
    for first in (False, True):
        got = resolve.bindings(resolve.resolved_imports(files, symbols, imports, first=first))
        assert sorted(tuple(r) for r in got.select("file_id", "name", "bound_symbol_id", "bound_kind").collect()) == want
    once = resolve.resolved_imports(files, symbols, imports, first=True)
    assert sorted(r["import_id"] for r in once.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
