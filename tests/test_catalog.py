from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from stratalog import catalog_queries
from stratalog.operators import budget, diff, graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def results(spark):
    """Every query's rows, several queries at a time."""
    queries = catalog_queries.queries()
    with ThreadPoolExecutor(6) as pool:
        futures = {name: pool.submit(lambda f=f: f(spark, SF).toPandas()) for name, f in queries.items()}
        return {name: (f.exception(), None if f.exception() else f.result()) for name, f in futures.items()}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query_matches_sql(results, tables, name):
    error, got = results[name]
    if error:
        raise error
    want = tables.sql(catalog_queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_cyclic_trace_ends(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t")], "source string, target string, type string")
    got = graph.trace(e, spark.createDataFrame([("a",)], "node string"), 5).collect()
    assert sorted((r.depth, r.source, r.target) for r in got) == [(1, "a", "b"), (2, "b", "c"), (3, "c", "a")]


def test_greedy_skip_and_exact_boundary(spark):
    c = spark.createDataFrame([("q", 1, "a", 6, 0), ("q", 2, "b", 5, 0), ("q", 3, "c", 1, 0)], "q string, rank long, item string, bytes long, tokens long")
    got = {r.item: r.decision for r in budget.greedy_select(c, "q", 10, 7, 100).collect()}
    assert got == {"a": "selected", "b": "bytes", "c": "selected"}


def test_rename_needs_one_to_one(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    assert diff.renames(f([("x", "h")]), f([("y", "h")])).count() == 1
    assert diff.renames(f([("x", "h"), ("z", "h")]), f([("y", "h")])).count() == 0


def test_retarget(spark):
    f = lambda *t: spark.createDataFrame([("i", x, "s") for x in t], "identity string, target string, state string")
    assert [r.change for r in diff.relationship_changes(f("a"), f("b")).collect()] == ["retargeted"]
    assert sorted(r.change for r in diff.relationship_changes(f("a", "a", "c"), f("b", "d", "c")).collect()) == ["added", "added", "removed", "removed"]


@pytest.mark.parametrize("name, most", [("b10_find_page", 1), ("b11_inspect_path", 2), ("d14_resolution", 0), ("a3_symbol_counts", 2), ("j3_edge_membership", 1)])
def test_texts_are_read_once_a_use(spark, name, most):
    """Scans of documents' texts in the plan that is left when a query is ready to run."""
    from stratalog.plans import audit

    plan = audit.audit(catalog_queries.queries()[name](spark, SF))
    assert sum("text" in columns for columns in plan.scanned) <= most
