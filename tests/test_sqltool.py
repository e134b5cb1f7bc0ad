import pytest

from skein.plans.sqltool import SqlTool, sqlite_compat
from skein.sources.tables import open_database, register_master, table_info


@pytest.fixture(scope="module")
def tool(spark, small):
    open_database(spark, f"parquet:{small}", ["nation", "region", "customer"])
    spark.udf.register("own_code", lambda x: x)
    spark.table("customer").createOrReplaceTempView("hidden_customer")
    return SqlTool(spark, {"nation", "region"}, cap=3)


def test_rows_are_capped_and_shown_as_text(tool):
    result = tool.run("SELECT n_nationkey FROM nation ORDER BY 1")
    assert result.ok and len(result.rows) == 3
    assert tool("SELECT n_nationkey FROM nation ORDER BY 1") == "[(0,), (1,), (2,)]"


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE nation",
        "INSERT INTO nation VALUES (1)",
        "CREATE TABLE x AS SELECT 1",
        "CREATE TEMP VIEW v AS SELECT 1",
        "SELECT 1; SELECT 2",
        "SELECT * FROM customer",
        "WITH n AS (SELECT * FROM customer) SELECT * FROM n",
        "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM customer)",
        "SELECT (SELECT count(*) FROM customer)",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
        "SELECT reflect('java.lang.Math', 'abs', 1)",
        "SELECT java_method('java.lang.Math', 'abs', 1)",
        "SELECT * FROM range(5)",
        "SET spark.sql.ansi.enabled = false",
        "WITH customer AS (SELECT * FROM customer) SELECT * FROM customer",
        "SELECT * FROM customer WHERE EXISTS (WITH customer AS (SELECT 1 AS x) SELECT x FROM customer)",
        "SELECT * FROM (WITH customer AS (SELECT 1 AS x) SELECT * FROM customer) a, customer",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
        "SELECT * FROM IDENTIFIER('customer')",
        "SELECT IDENTIFIER('abs')(1)",
        "DESCRIBE customer",
        "DESCRIBE nation",
        "SHOW TABLES",
        "EXPLAIN SELECT * FROM nation",
        "TABLE customer",
        "FROM nation |> JOIN customer",
        "SELECT TRANSFORM (n_name) USING 'cat' FROM nation",
        "BEGIN SELECT 1; END",
        "SELECT * FROM default.customer",
        "SELECT first(n_nationkey) OVER w FROM nation WINDOW w AS (ORDER BY n_nationkey * CASE WHEN (SELECT max(c_custkey) FROM customer) = 42 THEN -1 ELSE 1 END)",
        "SELECT count(*) OVER w FROM nation WINDOW w AS (PARTITION BY exists(SELECT 1 FROM customer WHERE c_custkey = 42))",
        "SELECT first(n_name) OVER w FROM nation WINDOW w AS (ORDER BY reflect('java.lang.Math', 'abs', -1))",
        "SELECT count(*) OVER w FROM nation WINDOW w AS (PARTITION BY java_method('java.lang.System', 'getProperty', 'user.home'))",
        "SELECT n_name FROM nation SORT BY try_reflect('java.lang.Math', 'abs', -1)",
        "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x)) FROM nation",
        "SELECT current_user() FROM nation",
        "SELECT own_code(n_name) FROM nation",
        "SELECT own_code(n_name) OVER () FROM nation",
        "SELECT upper(n_name) FROM hidden_customer",
        "SELECT nothing FROM nation",
        "SELEKT 1",
    ],
)
def test_refused_or_wrong_queries_are_errors_as_values(tool, text):
    result = tool.run(text)
    assert not result.ok and str(result).startswith("Error: ")


def test_runtime_errors_are_values_too(spark):
    assert SqlTool(spark).run("SELECT 1 / id FROM VALUES (0), (1) AS t(id)").error.startswith("Error: ")
    assert str(SqlTool(spark, prefix="Error querying database: ").run("SELECT x")).startswith("Error querying database: ")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT n_nationkey + 1 - 2 * 3 AS x FROM nation",
        "SELECT struct(n_name), named_struct('a', 1), array(1), map('a', 1), CASE WHEN true THEN 1 END, date_add(date'2024-01-01', 1) FROM nation",
        "SELECT replace(n_name, 'A', 'B') || 'x', n_name LIKE 'A%' FROM NATION ORDER BY 1 LIMIT 2 OFFSET 1",
        "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM A) SELECT * FROM B",
        "WITH region AS (SELECT * FROM nation) SELECT n_name FROM region",
        "WITH RECURSIVE t AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM t WHERE x < 3) SELECT * FROM t",
        "SELECT n_regionkey, count(*) FROM nation GROUP BY ROLLUP (n_regionkey) HAVING count(*) > 1",
        "SELECT n_name, rank() OVER w FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)",
        "SELECT * FROM nation JOIN LATERAL (SELECT r_name FROM region WHERE r_regionkey = n_regionkey)",
        "SELECT n_name, x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x",
        "SELECT * FROM VALUES (1), (2) AS t(a) UNION SELECT 3 EXCEPT SELECT 1 INTERSECT SELECT 2",
        "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM Region)",
        "SELECT * FROM (SELECT n_regionkey, n_nationkey FROM nation) PIVOT (count(n_nationkey) FOR n_regionkey IN (0, 1))",
    ],
)
def test_reading_passes(tool, text):
    result = tool.run(text)
    assert result.ok, result.error


def test_a_function_of_the_session_that_hides_a_built_in_one_is_refused(spark, small):
    session = spark.newSession()
    open_database(session, f"parquet:{small}", ["nation"])
    assert SqlTool(session, {"nation"}).run("SELECT soundex(n_name) FROM nation").ok
    session.udf.register("soundex", lambda x: x)
    assert not SqlTool(session, {"nation"}).run("SELECT soundex(n_name) FROM nation").ok


def test_without_an_allowlist_only_views_are_read(spark, small):
    open_database(spark, f"parquet:{small}", ["nation", "customer"])
    assert SqlTool(spark).run("SELECT * FROM customer LIMIT 1").ok
    assert not SqlTool(spark).run(f"SELECT * FROM parquet.`{small}/customer.parquet`").ok
    assert not SqlTool(spark).run("SELECT * FROM no_such_view").ok


def test_cut_results_say_so(tool):
    assert tool.run("SELECT * FROM nation").truncated
    assert not tool.run("SELECT * FROM nation LIMIT 3").truncated


def test_own_names_pass(tool):
    assert tool.run("WITH n AS (SELECT * FROM nation) SELECT count(*) FROM n JOIN region r ON n_regionkey = r_regionkey").rows[0][0] == 25


def test_parameters(tool):
    assert tool.run("SELECT n_name FROM nation WHERE n_nationkey = :k", {"k": 3}).ok


def test_audit_has_every_query(spark, small):
    open_database(spark, f"parquet:{small}", ["nation"])
    tool = SqlTool(spark, {"nation"})
    tool.run("SELECT 1")
    tool.run("DROP TABLE nation")
    assert [(r.ok, r.n_rows) for r in tool.audit().orderBy("started").collect()] == [(True, 1), (False, 0)]


def test_timeout_is_an_error(spark):
    slow = "SELECT count(*) FROM (SELECT explode(sequence(1, 100000)) a) x CROSS JOIN (SELECT explode(sequence(1, 1000000)) b) y WHERE a * b % 7 = 3"
    assert not SqlTool(spark, timeout_s=1.5).run(slow).ok


def test_like_ignores_case_in_compat_mode_only_outside_quotes():
    assert sqlite_compat("SELECT 'like' WHERE a LIKE 'S%'") == "SELECT 'like' WHERE a ILIKE 'S%'"


def test_catalog_as_rows(spark, small):
    open_database(spark, f"parquet:{small}", ["nation"])
    assert ("n_name", "string") in {(r.column_name, r.data_type) for r in table_info(spark, ["nation"]).collect()}
    assert "nation" in {r.name for r in register_master(spark).collect()}


@pytest.mark.parametrize(
    "text,columns,rows",
    [
        ("SELECT n_name FROM nation", ["n_name"], ""),
        ("SELECT n_name AS x FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 2", ["n_name"], "n_regionkey n_nationkey"),
        ("SELECT count(*) AS n, max(n_name) FROM nation GROUP BY n_regionkey", ["", "n_name"], "n_regionkey"),
        ("SELECT rank() OVER w FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)", ["n_regionkey n_name"], ""),
        ("SELECT x FROM nation LATERAL VIEW explode(split(n_name, 'A')) t AS x", ["n_name"], "n_name"),
        ("SELECT n_name FROM nation UNION SELECT r_name FROM region", ["n_name r_name"], "n_name r_name"),
        ("SELECT n_name FROM nation EXCEPT SELECT r_name FROM region WHERE r_regionkey = 1", ["n_name r_name"], "n_name r_name r_regionkey"),
        ("WITH a AS (SELECT n_regionkey AS k, n_name AS v FROM nation) SELECT b.v FROM a JOIN a b ON a.k = b.k", ["n_name"], "n_regionkey"),
        ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name = 'ASIA')", ["n_name"], "r_regionkey n_regionkey r_name"),
        ("SELECT (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) FROM nation", ["r_name r_regionkey n_regionkey"], "r_regionkey n_regionkey"),
        ("SELECT n_regionkey, n_name, count(*) FROM nation GROUP BY ROLLUP (n_regionkey, n_name)", ["n_regionkey", "n_name", ""], "n_regionkey n_name"),
    ],
)
def test_lineage(spark, tool, text, columns, rows):
    from skein.plans.lineage import lineage

    found = lineage(spark.sql(text))
    assert [{c for _, c in base} for _, base in found.columns] == [set(c.split()) for c in columns]
    assert {c for _, c in found.rows} >= set(rows.split()) and {c for _, c in found.every} == set(" ".join([*columns, rows]).split())


def test_column_rights(spark, tool):
    own = SqlTool(spark, {"nation", "region"}, columns={"Nation": {"n_name", "N_NATIONKEY"}})
    assert own.run("SELECT n_name, n_nationkey, r_name FROM nation CROSS JOIN region LIMIT 3").ok
    for text in (
        "SELECT n_regionkey FROM nation",
        "SELECT * FROM nation",
        "SELECT n_name FROM nation WHERE n_regionkey = 1",
        "SELECT n_name FROM nation ORDER BY n_regionkey",
        "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
        "SELECT count(*) OVER w FROM nation WINDOW w AS (PARTITION BY n_regionkey)",
        "WITH a AS (SELECT n_regionkey AS k FROM nation) SELECT sum(k) FROM a",
    ):
        assert "n_regionkey is not allowed" in own.run(text).error, text
