import random

import pytest
from pyspark.sql import functions as F
from stratalog.operators import budget, context, extractors, find, lifecycle, resolution, scip, sessions, temporal, workspace


def test_extractor_spans():
    found = extractors.scan("a.md", b"x\n  ## T\xc3\xa9 \n####### no\n#no\n")
    assert found == [("symbol", "heading", "Té", "h2", 4, 11, 0.9)]
    data = b'{"a": {"b": 1}, "c\\"d": [1, {"x": 2}], broken "e": 1, "f'
    assert [(f[2], data[f[4] : f[5]]) for f in extractors.scan("a.json", data)] == [("a", b'"a"'), ('c\\"d', b'"c\\"d"'), ("e", b'"e"')]
    assert [f[2] for f in extractors.scan("a.yml", "k: 1\n# c: 1\n- l: 1\n x: 1\nü.1 : 2\nb d: 3\n".encode())] == ["k", "ü.1"]
    assert [(f[1], f[2], f[6]) for f in extractors.scan("a.toml", b"[ s.t ]\n k=1\n# x=1\nb d = 1\n[open\n")] == [("config_section", "s.t", 0.9), ("config_key", "k", 0.85)]


def test_script_spans():
    data = b"export async function f(a) {\n  return '}' + `{`;\n}\nclass C {\nconst v: T = {\n a: 1\n};\nlet w = 1\nimport x from \"m\";"
    found = {f[2]: data[f[4] : f[5]] for f in extractors.scan("a.ts", data)}
    assert found["f"].endswith(b"`;\n}") and found["v"].endswith(b"};") and found["w"].endswith(b"= 1") and found["C"].endswith(b'"m";')
    assert [f[1] for f in extractors.scan("a.js", b"1 + 1")] == ["no_declarations"] and [f[1] for f in extractors.scan("a.bin", b"")] == ["no_structural_provider"]


def test_extractor_registry(spark):
    extractors.register(".ini", lambda data: iter([("symbol", "config_key", "own", None, 0, 1, 0.5)]))
    try:
        rows = extractors.extract(spark.createDataFrame([("x/a.INI", "k"), ("b.md", None)], "path string, content string")).collect()
        assert [(r.path, r.name, r.start_line) for r in rows] == [("x/a.INI", "own", 1)]
    finally:
        del extractors.SCANNERS[".ini"]


def test_line_ranges(spark):
    df = spark.createDataFrame([("a\nb\r\nc",), ("a\n",), ("",)], "t string")
    take = lambda a, b: [r.x for r in df.select(extractors.line_range(F.col("t"), a, b).alias("x")).collect()]
    assert take(0, 1) == ["a\n", "a\n", ""] and take(2, 9) == ["b\r\nc", "", ""] and take(3, 3) == ["c", "", ""] and take(4, 5) == ["", "", ""]


def test_positions_in_every_encoding(spark):
    text = "ab\né𝒳z"
    df = spark.createDataFrame([(text,)], "t string")
    at = lambda e, c: df.select(extractors.byte_offset(F.col("t"), F.lit(1), F.lit(c), e).alias("x")).first().x
    assert at("utf-32", 2) == at("utf-16", 3) == at("utf-8", 6) == 3 + len("é𝒳".encode())


def test_index_round_trip_and_bounds():
    rng = random.Random(3)
    docs = [{
        "path": f"p{i}", "occurrences": [((rng.randrange(9), 1, a, rng.randrange(300)), f"s{j}", j % 3) for j, a in enumerate([rng.randrange(9) for _ in range(6)])],
        "symbols": [(f"s{i}", "né", [("t", "IMPLEMENTS"), ("u", "DEFINED_BY")])],
    } for i in range(5)]
    data = scip.encode_index(docs)
    assert list(scip.decode_index(data)) == docs
    extra = b"\x0a\x02hi" + data + b"\x9a\x06\x01x" + b"\x99\x06" + bytes(8)
    assert list(scip.decode_index(extra)) == docs  # unknown fields are skipped
    assert next(scip.decode_index(b"\x12\x08\x12\x06\x08\x05\x08\x01\x08\x02"))["occurrences"] == [((5, 1, 5, 2), "", 0)]  # a range that is not packed
    for bad in (data[:-1], b"\xff" * 11, b"\x0b"):
        with pytest.raises(ValueError):
            list(scip.decode_index(bad))


def test_walk_and_paths(spark, tmp_path):
    for name in ("a.md", "src/b.rs", "node_modules/c.js", ".git/d", "dist/e.js", "id_rsa"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "a.md")
    assert workspace.walk(str(tmp_path)) == ["a.md", "id_rsa", "src/b.rs"]
    assert workspace.walk(str(tmp_path), prune=False) == ["a.md", "dist/e.js", "id_rsa", "node_modules/c.js", "src/b.rs"]
    (tmp_path / "link").unlink()
    got = {r.path: r.state for r in workspace.read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"] == "present" and got["id_rsa"] == "secret_excluded" and got["dist/e.js"] == "excluded" and ".git/d" not in got
    assert workspace.relative_path(str(tmp_path), "src/../a.md") == "a.md"
    with pytest.raises(ValueError):
        workspace.relative_path(str(tmp_path), "../x")
    rows, digest = workspace.unregister_preview(str(tmp_path / "src"))
    assert [r[:2] for r in rows] == [("file", "b.rs")] and workspace.unregister_preview(str(tmp_path / "src"))[1] == digest


def test_config_lease_and_schema(tmp_path):
    c = workspace.Config.parse('[workspace]\nroot = "r"\n[policy]\nexclude = ["x"]\n[evidence]\nmin_confidence = 0.5')
    assert (c.root, c.exclude, c.min_confidence) == ("r", ("x",), 0.5)
    with pytest.raises(ValueError):
        workspace.Config.parse("[other]\na = 1")
    lease = workspace.WriterLease(str(tmp_path))
    lease.acquire("a")
    lease.heartbeat("a")
    with pytest.raises(PermissionError):
        lease.acquire("b")
    workspace.WriterLease(str(tmp_path), stale_after=-1).acquire("b")
    lease.release("a")
    assert lease.holder() == "b"
    assert workspace.Schema(str(tmp_path), [("1", "x")]).apply_all() == ["1"]
    assert workspace.Schema(str(tmp_path), [("1", "x"), ("2", "y")]).apply_all() == ["2"]
    with pytest.raises(ValueError):
        workspace.Schema(str(tmp_path), [("1", "z"), ("2", "y")]).apply_all()
    with pytest.raises(ValueError):
        workspace.Schema(str(tmp_path), [("1", "x")]).apply_all()


def test_manifest_swaps_only_on_success(spark, tmp_path):
    m = lifecycle.Manifest(str(tmp_path))
    m.begin("a")
    m.finish("a", "committed")
    m.begin("b")
    m.finish("b", "failed")
    assert m.read()["active"] == "a"
    with pytest.raises(ValueError):
        m.finish("b", "committed")
    g = spark.createDataFrame([("x", "y", 1), ("y", "x", 2)], "generation_id string, parent_id string, sequence_no long")
    with pytest.raises(ValueError):
        lifecycle.Ancestry(g)


def test_cursor_of_another_snapshot_starts_again():
    text = "\u001f".join(["g1", "q", "p"]).encode().hex()
    assert find.read_cursor(text, "g1", "q") == "p"
    assert find.read_cursor(text, "g2", "q") is find.read_cursor("zz", "g1", "q") is find.read_cursor(None, "g1", "q") is None


def test_find_page_drops_the_rest_of_a_file(spark):
    s = spark.createDataFrame([("k%d" % i, "n", "t", "p", 1.0, i) for i in range(5)], "symbol_key string, display_name string, kind string, path string, confidence double, start_byte long")
    first = find.find_page(s, find.matches(), 3, "g", "q").collect()
    assert [r.symbol_key for r in first] == ["k0", "k1", "k2"] and all(r.truncated and r.total_matched == 3 for r in first)
    assert find.find_page(s, find.matches(), 3, "g", "q", first[0].next_cursor).count() == 0
    assert find.keyset_page(s, ["path", "start_byte"], 3, ("p", 2)).count() == 2
    assert [find.matches(query="N_"), s.where(find.matches(query="_")).count()][1] == 5  # a wildcard, as documented


def test_resolution_precedence_and_candidates(spark):
    rel = spark.createDataFrame(
        [("1", "REFERENCES", "symbol", "k1", "reference", 0.5, "semantic"), ("2", "IMPLEMENTS", "external_symbol", "zz", "reference", 0.5, "semantic"), ("3", "CALLS", "symbol", "a/b#dup().", "reference", 0.5, "semantic"), ("4", "CALLS", "symbol", "k1", "x", 0.5, "structural")],
        "fact_id string, type string, ref_kind string, target string, reason_in string, confidence_in double, method string",
    )
    sym = spark.createDataFrame([("k1", "one")] + [(f"d{i:02}", "dup") for i in range(20)], "symbol_key string, display_name string")
    got = {r.fact_id: r for r in resolution.resolve(rel, sym, spark.createDataFrame([], "path string")).collect()}
    assert set(got) == {"1", "2", "3"}
    assert (got["1"].reason, got["2"].status, got["3"].status) == ("exact_canonical_symbol", "external", "ambiguous")
    assert got["3"].candidates == [f"d{i:02}" for i in range(16)] and got["3"].resolved_value is None
    same = resolution.resolve(rel, sym, spark.createDataFrame([], "path string"), spark.createDataFrame([("zz",)], "target string")).collect()
    assert {r.fact_id: r.reason for r in same}["2"] == "exact_provider_symbol"


def test_deep_budget_charges_before_it_refuses(spark):
    rows = [("q", 0, "a", 3, 9, False, 1, 1), ("q", 1, "b", 3, 0, False, 1, 1), ("q", 2, "c", 5, 0, False, 1, 1), ("q", 3, "d", 1, 0, True, 1, 1), ("q", 4, "e", 1, 0, True, 1, 1)]
    df = spark.createDataFrame(rows, "request string, rank long, item string, work long, depth long, uncertain boolean, bytes long, tokens long")
    got = {r.item: (r.decision, r.ledger) for r in budget.deep_budget(df, 5, 100, 100, 2, 9, 20).collect()}
    assert got == {"a": ("depth", 3), "b": ("selected", 6), "c": ("work_units", 6), "d": ("selected", 7), "e": ("uncertainty_reserve", 8)}


def test_seed_order_does_not_matter(spark):
    f = lambda seeds: context.canonical_seeds(spark.createDataFrame([("q", s) for s in seeds], "request string, seed string")).first().seeds
    assert f(["b", "a", "b"]) == f(["a", "b"]) == ["a", "b"]


def test_closure_ends_with_its_ledger(spark):
    e = spark.createDataFrame([(f"f{i}", f"n{i}", f"n{i + 1}", "calls", "resolved_symbol") for i in range(6)], "fact_id string, source string, target string, type string, status string")
    seeds = spark.createDataFrame([("q", "n0")], "request string, seed string")
    assert context.relationship_closure(e, seeds, ["calls"], 9, 5, 1000)[0].count() == 6
    few, left = context.relationship_closure(e, seeds, ["calls"], 9, 5, 12)
    assert few.count() == 2 and left == 6
    assert context.relationship_closure(e, seeds, ["calls"], 9, 5, 3)[0].count() == 0


def test_route_goes_up_while_it_helps():
    missing = {"direct": {"exact_source"}, "light": {"validation_plan"}, "deep": set()}
    run = lambda ceiling, seen=None: sessions.execute_route("direct", ceiling, lambda r: missing[r], lambda: seen.pop() if seen else "g")
    assert run("deep") == [("direct", "escalated"), ("light", "escalated"), ("deep", "sufficient")]
    assert run("light")[-1] == ("light", "ceiling_reached")
    assert sessions.execute_route("direct", "deep", lambda r: {"unknown"}, lambda: "g") == [("direct", "not_escalatable")]
    assert run("deep", ["h", "g"]) == [("direct", "generation_changed")] or run("deep", ["h", "g", "g"])[-1][1] == "generation_changed"


def test_zero_denominator_is_typed(spark):
    e = spark.createDataFrame([("s", "entity_queried", "x", 1)], "session_id string, use_type string, entity string, bytes long")
    got = {r.metric: (r.denominator, r.validity) for r in sessions.context_metrics(sessions.evidence(e)).collect()}
    assert got["precision_observed"] == (0, "zero_denominator") and got["expansion_count"] == (1, "valid")


def test_impact_parts_and_risk_levels(spark):
    e = spark.createDataFrame([("p", "resolved_symbol"), ("p", "ambiguous"), ("q", "stale")], "path string, status string")
    assert {r.path: (r.verified, r.uncertain) for r in resolution.split_by_resolution(e).collect()} == {"p": (True, True), "q": (False, True)}
    one = spark.createDataFrame([tuple(1 if c == "additive_changes" else 0 for c in temporal.SIGNALS)], ", ".join(f"{c} long" for c in temporal.SIGNALS))
    assert [(r.code, r.overall) for r in temporal.risk_summary(one).collect()] == [("additive_changes", "low")]
