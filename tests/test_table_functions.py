import pytest
from stratalog.operators import scip, table_functions

DOCS = [{"path": "a.ts", "occurrences": [((3, 4, 3, 9), "npm x#", 1), ((0, 0, 2, 5), "local 1", 0), ((0, 0, 0, 0), "z", 2)], "symbols": [("npm x#", "né", [("npm t#", "IMPLEMENTS")])]}]
EXTERNAL = [("npm t#", "T", [("npm u#", "TYPE_DEFINITION")])]


@pytest.mark.parametrize("form", ["packed", "plain", "typed"])
def test_all_forms_of_ranges(form):
    data = scip.encode_index(DOCS, form, EXTERNAL)
    assert list(scip.decode_index(data)) == DOCS and list(scip.external_symbols(data)) == EXTERNAL


def test_a_typed_range_wins_over_a_plain_one():
    put = scip._put
    both = put(2, put(1, "d".encode()) + put(2, put(1, bytes([7, 1, 2])) + put(8, put(1, 3) + put(2, 4) + put(3, 9))))
    zero = put(2, put(1, "d".encode()) + put(2, put(1, bytes([7, 1, 2])) + put(8, b"")))
    assert [next(scip.decode_index(d))["occurrences"][0][0] for d in (both, zero)] == [(3, 4, 3, 9), (7, 1, 7, 2)]


def test_tables_in_and_rows_out(spark):
    table_functions.register(spark)
    content = [(scip.encode_index(DOCS, form, EXTERNAL),) for form in ("packed", "typed")] + [(None,), (b"",), (b"\x0b",)]
    spark.createDataFrame(content, "content binary").createOrReplaceTempView("idx")
    got = spark.sql("SELECT record, path, symbol, start_line, end_line, end_char FROM index_records(TABLE(idx))").collect()
    assert sorted((r.record, r.symbol or "", r.end_char or -1) for r in got) == sorted([("occurrence", "npm x#", 9), ("occurrence", "local 1", 5), ("occurrence", "z", -1), ("symbol", "npm x#", -1), ("related", "npm x#", -1), ("external", "npm t#", -1), ("related", "npm t#", -1)] * 2 + [("error", "", -1)])
    spark.createDataFrame([("a.toml", "[s]\nk = 1\n"), ("b.md", None), ("c.bin", "x")], "path string, content string").createOrReplaceTempView("files")
    rows = spark.sql("SELECT f.path, f.kind, f.name FROM file_facts(TABLE(SELECT path, content FROM files)) f ORDER BY 1, 2").collect()
    assert [(r.path, r.kind, r.name) for r in rows] == [("a.toml", "config_key", "k"), ("a.toml", "config_section", "s"), ("c.bin", "no_structural_provider", "")]
