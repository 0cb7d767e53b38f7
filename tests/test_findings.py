"""What a review found: each of these failed before its finding was settled."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F
from stratalog import catalog_queries
from stratalog.operators import budget, compiled, context, diff, graph, lifecycle, merkle, names, packets, projection, resolution, scip, temporal
from stratalog.plans import audit
from stratalog.queries import evidence, extraction, search
from stratalog.queries import context as context_queries
from stratalog.queries import temporal as temporal_queries
from stratalog.sources.model import Model

SF = "/root/testdata/sf0.001"
SPAN = ["document", "revision_id", "start_line", "start_char", "end_line", "end_char"]


def test_exploded_occurrences_are_not_broadcast(spark):
    spans = lambda df: df.select(F.lit("d").alias("document"), F.lit("r").alias("revision_id"), *(F.col("n").alias(c) for c in SPAN[2:]))
    calls = spans(spark.range(5, 15).withColumnRenamed("id", "n")).withColumns({"caller": F.concat(F.lit("c"), "start_line"), "confidence": F.lit(0.5)})
    occ = spans(spark.range(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("n"))).withColumn("symbol", F.lit("s"))
    got = resolution.compose_call_edges(calls, occ)
    assert audit.audit(got).broadcasts == 0
    assert sorted((r.caller, r.symbol, r.confidence) for r in got.collect()) == [(f"c{i}", "s", 0.49) for i in (5, 6, 7, 8)]


def test_effect_closure_takes_every_part(spark):
    got = catalog_queries.queries()["g6_effect_closure"](spark, SF)
    keys = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).collect()}
    events = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select(F.concat(F.lit("part:"), F.get_json_object("props", "$.k"))).collect()}
    assert {r.subject for r in got.select("subject").distinct().collect()} == keys & events


def test_selected_symbols_are_not_broadcast(spark):
    selected = spark.createDataFrame([("q", "a"), ("r", "a"), ("q", "a")], "request string, symbol_key string")
    effects = spark.createDataFrame([("x", "a", "view"), ("y", "b", "view")], "effect_id string, subject string, effect_type string")
    got = context.effect_closure(selected, effects, spark.createDataFrame([("b", "open")], "subject_key string, status string"))
    joined = got.select("request", "effect_id", "subject")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [subject" in joined
    assert sorted(map(tuple, got.collect())) == [("q", "x", "a", "view", False), ("r", "x", "a", "view", False)]


def test_pairs_of_mentions_are_not_shuffled(spark):
    rng = random.Random(4)
    shown = ["red ring", "Ring", "blue box", "12.md", ""]
    rows = [(f"s{i}", f"d/{i % 9}.md", rng.choice(shown), rng.choice(["semantic", "exact"])) for i in range(60)]
    rows += [("s1", "d/1.md", name, "exact") for name in ("red ring", "Ring", "blue box")]
    texts = [(f"q{i}", f"See the {rng.choice(shown).upper()} in {rng.randrange(30)}.md") for i in range(12)]
    want = collections.Counter()
    for q, text in texts:
        for key, path, name, method in rows:
            if name and name.lower() in text.lower():
                want[q, key, path] += 95 if method == "semantic" else 80
            if path.split("/")[-1] in text.lower():
                want[q, "path:" + path, path] += 70
    symbols = spark.createDataFrame(rows, "symbol_key string, path string, display_name string, method string")
    got = names.mention_points(spark.createDataFrame(texts, "request string, text string"), symbols)
    assert collections.Counter({(r.request, r.key, r.path): r.points for r in got.collect()}) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union")  # entries with one name are joined and no more


def test_tiles_are_the_join(spark, monkeypatch):
    """j17_mention_points, F1: any sizes of tiles, strips and partitions give a plain join's rows, and one name's pairs lie in many tasks."""
    found = [("a", f"q{i}") for i in range(41)] + [("b", f"q{i}") for i in range(3)] + [("a", None), ("c", "q1"), ("none", "q2")]
    entries = [("a", f"s{i}", None if i % 7 == 0 else f"d/{i}.md", i) for i in range(30)] + [("b", "s1", "d/1.md", 5), ("c", "s1", "d/1.md", 6), ("unasked", "s2", "d", 7)]
    want = collections.Counter((q, k, p, n) for a, q in found for b, k, p, n in entries if a == b)
    rows = spark.createDataFrame(found, "name string, request string"), spark.createDataFrame(entries, "name string, key string, path string, points long")
    for sizes in ((7, 8, 16, 20), (1, 8, 8, 1), (2048, 504, 8064, 16384)):
        for constant, n in zip(("TILE_ENTRIES", "STRIP", "LIST_VALUES", "PART_ROWS"), sizes):
            monkeypatch.setattr(names, constant, n)
        got = names.in_tiles(*rows, "name", "request")
        assert collections.Counter((r.request, r.key, r.path, r.points) for r in got.collect()) == want
        if sizes[0] == 7:
            tasks = [r["count"] for r in got.where("key != 's1'").groupBy(F.spark_partition_id()).count().collect()]
            assert len(tasks) > 4 and max(tasks) < sum(tasks) / 2
    assert names.in_tiles(rows[0].where("name = 'none'"), rows[1], "name", "request").collect() == []


def test_pairs_of_mentions_take_little_disk(spark, tmp_path):
    """j17_mention_points, F1: the written result took 1.8 to 3 bytes a pair."""
    rows = [(f"s{i}", f"web/en/{i}.md", f"thing {i * 7 % 40:02d}", "exact") for i in range(4000)]
    texts = [(f"q{i}", f"take thing {i % 40:02d} away") for i in range(8000)]
    got = names.mention_points(spark.createDataFrame(texts, "request string, text string"), spark.createDataFrame(rows, "symbol_key string, path string, display_name string, method string"))
    got.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 * 200 == back.select("request", "key").distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * 4000 * 200


def test_candidates_of_requests_that_share_names(spark):
    """Against all pairs in plain Python, with common names from two bearers on."""
    rng = random.Random(5)
    for seed in range(3):
        entities = sorted({(f"n{rng.randrange(6)}", f"s{rng.randrange(25)}") for _ in range(40)})
        entities = [(n, k, f"p{int(k[1:]) % 4}", rng.choice([70, 80, 95])) for n, k in entities]
        hits = sorted({(f"q{rng.randrange(7)}", f"n{rng.randrange(6)}") for _ in range(14)})
        own = [(f"q{rng.randrange(8)}", f"s{k}", f"p{k % 4}", 100) for k in (rng.randrange(25) for _ in range(9))]
        best = sorted({(f"s{rng.randrange(25)}", f"s{rng.randrange(28)}") for _ in range(60)})
        best = [(a, b, rng.choice([20, 40, 50])) for a, b in best]
        located = [(f"s{k}", f"p{k % 4}") for k in range(25)] + [("s3", "other")]
        score, first = collections.Counter(), set()
        for q, k, p, points in own + [(q, k, p, points) for q, n in hits for m, k, p, points in entities if m == n]:
            score[q, k, p] += points
            first.add((q, k, p))
        near = collections.defaultdict(int)
        for q, a in {(q, k) for q, k, _ in first}:
            for x, b, points in best:
                if x == a:
                    near[q, b] = max(near[q, b], points)
        for (q, b), points in near.items():
            for k, p in located:
                if k == b:
                    score[q, k, p] += points
        order = sorted(score, key=lambda e: (e[0], -score[e], e not in first, e[2], e[1]))
        want = [(q, k, p, score[q, k, p], i) for _, g in itertools.groupby(order, lambda e: e[0]) for i, (q, k, p) in enumerate(g, 1) if i <= 6]
        make = lambda rows, columns: spark.createDataFrame(rows, columns)
        row = "key string, path string, points long"
        got = packets.best_of(make(own, f"request string, {row}"), make(hits, "request string, name string"), make(entities, f"name string, {row}"), make(best, "source string, target string, points int"), make(located, "key string, path string"), 6, common=1 + seed)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_facts_that_share_a_text_are_one_record_of_the_index(spark):
    facts = spark.createDataFrame([("red ring B::red ring",)] * 5 + [("blue box C::blue box",)], "looked string")
    index = search.symbol_index(Model(spark, SF), facts)
    assert sorted({r.record for r in index.postings().collect()}) == ["blue box C::blue box", "red ring B::red ring"]
    assert index.postings().where("token = 'ring'").count() == 1


def test_a_seed_is_settled_once_for_all_requests(spark, monkeypatch):
    written, cut = [], context.cut
    monkeypatch.setattr(context, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    symbols = spark.createDataFrame([(f"s{i}", "q0" if i == 0 else f"q{i}", "ring") for i in range(5)], "symbol_key string, qualified_name string, display_name string")
    seeds = spark.createDataFrame([(f"r{i}", seed) for i in range(20) for seed in ("ring", "s1", "q0", "none")], "request string, seed string")
    words = spark.createDataFrame([("ring", "s0"), ("none", "s4")], "seed string, symbol_key string")
    got = context.resolve_seeds(seeds, symbols, None, words)
    want = [("ring", "display", f"s{i}", True) for i in range(5)] + [("s1", "canonical", "s1", False), ("q0", "qualified", "s0", False), ("none", "phrase", "s4", True)]
    assert sorted(map(tuple, got.collect())) == sorted((f"r{i}", *w) for i in range(20) for w in want)
    assert written[0].count() == 9  # eight, and the phrase hit of a seed that has better ones
    assert sorted(map(tuple, context.resolve_seeds(seeds, symbols).where("request = 'r7'").collect())) == [("r7", "q0", "qualified", "s0", False), ("r7", "s1", "canonical", "s1", False)]


def test_edges_of_a_generation_are_shuffled_once(spark):
    """lines move once, as numbers, and files once."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = Model(spark, SF).edges_at(2)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sums_of_digests_are_those_of_their_lanes(spark):
    rows = spark.createDataFrame([(f"f{i}", f"s{i % 7}", "t", "calls", "stale") for i in range(500)], projection.SCHEMAS["edges"])
    digests = [r[0] for r in rows.select(projection.row_digest("edges")).collect()]
    got = projection.sums(rows, "edges").first()
    assert (got.n, int(got.a), int(got.b)) == (500, sum(int(d[:15], 16) for d in digests), sum(int(d[15:30], 16) for d in digests))


def _kinds_written(monkeypatch, tmp_path):
    kinds, write, edges = [], projection.Projection._write, projection.Projection._replace_edges
    monkeypatch.setattr(graph, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(projection.Projection, "_write", lambda p, folder, kind, rows: (kinds.append(kind), write(p, folder, kind, rows)))
    monkeypatch.setattr(projection.Projection, "_replace_edges", lambda *args: (kinds.append("edges"), edges(*args)))
    return kinds


def test_stored_rollups_build_rollups_alone(spark, monkeypatch, tmp_path):
    """F8."""
    kinds = _kinds_written(monkeypatch, tmp_path)
    assert evidence.b15_stored_rollups(Model(spark, SF)).count() and kinds == ["rollups"] * 2


def test_serving_cards_store_no_edges(spark, monkeypatch, tmp_path):
    """the same cards as those of a projection of all kinds."""
    kinds = _kinds_written(monkeypatch, tmp_path)
    m = Model(spark, SF)
    alone = sorted(map(tuple, evidence.b15_serving_cards(m).collect()))
    assert kinds == ["cards"] * 2
    assert sorted(map(tuple, evidence.projected(m).read("g2", "cards").select("symbol_key", "fact_id", "callers", "unresolved", "coverage_state", "tokens", "card_hash").collect())) == alone


def test_adjacency_keeps_edges_up_by_moved_files(spark, monkeypatch, tmp_path):
    """only edges are stored, and those of the second generation are all of its edges."""
    kinds = _kinds_written(monkeypatch, tmp_path)
    m = Model(spark, SF)
    assert evidence.g9_adjacency_projection(m).count() and kinds == ["edges"] * 2
    columns = ["fact_id", "source", "target", "type", "status"]
    for n in (1, 2):
        stored = evidence.projected(m, "edges").read(f"g{n}", "edges").select(*columns)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, m.edges_at(n).select(*columns).collect()))


def test_records_of_an_index_come_from_one_decoding(spark):
    """F9, against plain Python."""
    docs = [{"path": f"p{i}", "occurrences": [((i, 2, i, 4), s, r) for s, r in (("local 1", 1), ("x#", 3), ("y#", 2), ("z#", 0))], "symbols": [("x#", "x", [("y#", "IMPLEMENTS")]), ("z#", "z", [])]} for i in range(3)]
    files = spark.createDataFrame([(scip.encode_index(docs),), (None,)], "content binary")
    got = scip.map_documents(scip.decoded(files))
    want = []
    for d in docs:
        p = d["path"]
        key = lambda s, p=p: f"scip-local:{p}:{s}" if s.startswith("local ") else f"scip:{s}"
        for _, s, r in d["occurrences"]:
            want += [(p, "symbol", "definition", key(s), None, 0.97)] * (r & 1) + [(p, "relation", "REFERENCES", p, key(s), 0.97)] + [(p, "relation", "IMPORTS", p, key(s), 0.97)] * (r >> 1)
        want.append((p, "relation", "IMPLEMENTS", "scip:x#", "scip:y#", 0.97))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_decoded_documents_share_batches(spark):
    """and an occurrence without a valid range has none."""
    made = scip._batch([{"path": f"p{i}", "occurrences": [(None, "a", 0), ((1, 2, 1, 4), "b", 1)][: i % 3], "symbols": []} for i in range(9)])
    assert made.num_rows == 9 and [len(o) for o in made.column("occurrences").to_pylist()] == [0, 1, 2] * 3
    assert made.column("occurrences").to_pylist()[2] == [dict(start_line=None, start_char=None, end_line=None, end_char=None, symbol="a", roles=0), dict(start_line=1, start_char=2, end_line=1, end_char=4, symbol="b", roles=1)]


def test_lines_of_indexes_are_shuffled_once(spark):
    """F15."""
    plan = extraction.indexes(Model(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == plan.count("Exchange hashpartitioning(l_") == 1


def test_state_changes_gather_no_items(spark):
    """against lists in plain Python, with null keys and states."""
    rng = random.Random(3)
    some = lambda n: [(rng.choice([None, *"abcdefgh"]), rng.choice([None, "x", "y"]), rng.randrange(2)) for _ in range(n)]
    for _ in range(4):
        old, new = some(14), some(14)
        want = []
        for key in {k for k, *_ in old + new}:
            a, b = ([r for r in rows if r[0] == key] for rows in (old, new))
            if key is None:
                want += [(None, "removed")] * bool(a) + [(None, "added")] * bool(b)
                continue
            states = [{r[1] for r in rows} - {None} for rows in (a, b)]
            differ = collections.Counter(a) != collections.Counter(b)
            what = "added" if not a else "removed" if not b else "state_changed" if states[0] != states[1] else "modified" if differ else None
            want += [(key, what)] if what else []
        frame = lambda rows: spark.createDataFrame(rows, "k string, s string, i int")
        got = temporal.state_changes(frame(old), frame(new), "k", "s", ["i", "s"])
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_relationships_are_paired_once(spark):
    """one pairing gives every kind of change."""
    frame = lambda *rows: spark.createDataFrame(rows, "identity string, target string, state string")
    old = frame(("a", "x", "1"), ("b", "x", "1"), ("c", "x", "1"), ("c", "y", "1"), ("e", "x", "1"), ("f", "x", "1"), ("f", "x", "2"))
    new = frame(("a", "z", "1"), ("b", "x", "2"), ("c", "z", "1"), ("d", "x", "1"), ("e", "x", "1"), ("f", "x", "2"), ("f", "y", "1"))
    got = diff.relationship_changes(old, new)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("a", "retargeted", "x", "z"), ("b", "evidence_changed", "x", "x"), ("c", "removed", "x", None), ("c", "removed", "y", None), ("c", "added", None, "z"), ("d", "added", None, "x"), ("f", "retargeted", "x", "y")]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("row_number(") == 1


def test_first_details_make_the_changes_once(spark, monkeypatch):
    """F25."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or cut(df, name))
    plan = temporal_queries.l7_first_details(Model(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert written == ["changes"] and "lineitem" not in plan and "l_orderkey" not in plan


def test_conflict_records_shuffle_facts_once(spark):
    """F23."""
    plan = evidence.d15_conflict_records(Model(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ancestry_broadcasts_nothing(spark, monkeypatch):
    """a level that is broadcast passes through the driver at each round."""
    plans, cut = [], lifecycle.cut
    monkeypatch.setattr(lifecycle, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "generation_id long, parent_id long")
    got = lifecycle.Ancestry(rows).judge(spark.createDataFrame([(2, 8), (8, 2)], "older long, newer long"))
    assert sorted(map(tuple, got.collect())) == [(2, 8, True, 6), (8, 2, False, None)]
    assert plans and not any("Broadcast" in p for p in plans)


def test_a_tree_moves_rows_once_and_no_hashes(spark, monkeypatch):
    """F16: the same tree with rows combined first and in one shuffle, with repeats and nulls."""
    plans, written, cut = [], [], merkle.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        written.append((name, df.columns))
        return cut(df, name)

    monkeypatch.setattr(merkle, "cut", seen)
    rows = spark.createDataFrame([(f"k{i % 90}", f"v{i % 7}") for i in range(200)] + [(None, "x"), ("k1", None), ("k1", None)], "k string, v string")
    make = lambda **more: merkle.tree(rows, F.col("k"), F.col("v"), leaf_rows=8, **more)
    kept, combined, once = make(keep_rows=True), make(), make(repeats=False)
    plans.clear()
    given = make(repeats=False, depth=once.depth)
    assert kept.depth == combined.depth == once.depth == 2
    assert kept.root().first() == combined.root().first() == once.root().first() == given.root().first()
    assert plans[0].count("Exchange hashpartitioning") == 1
    assert all(columns == ["key", "value", "n"] for name, columns in written if name == "merkle-rows")


def test_indexes_are_read_in_lockstep_as_one_by_one():
    """all forms of ranges, unknown fields, absent parts, and files that only the plain reader takes."""
    rng = random.Random(13)
    put = scip._put
    number = lambda: rng.choice([0, 1, 127, 128, 300, 1 << 20, 1 << 40])
    for _ in range(30):
        files = []
        for i in range(rng.randrange(5)):
            docs = []
            for d in range(rng.randrange(3)):
                spans = [(a := number(), number(), rng.choice([a, number()]), number()) for _ in range(rng.randrange(6))]
                docs.append({"path": f"p{i}é{d}", "occurrences": [(s, rng.choice(["", "x#", "ü" * 90]), rng.choice([0, 1, 3])) for s in spans], "symbols": [("s", "n", [("o", "IMPLEMENTS")])] * rng.randrange(3)})
            files.append(scip.encode_index(docs, rng.choice(["packed", "plain", "typed"]), [("e", "E", [])] * rng.randrange(2)))
        files.append(put(2, put(1, b"q") + put(2, put(2, b"no range") + put(9, 7)) + put(2, put(1, bytes([1, 2])) + put(8, put(2, 4)) + put(9999, b"?")) + put(2, put(8, b"")) + put(2, put(1, bytes([1, 2, 3])) + put(8, b""))))
        got, external = scip._lockstep(files)
        want = scip._batch([doc for f in files for doc in scip.decode_index(f)])
        assert got.to_pylist() == want.to_pylist() and external == [e for f in files for e in scip.external_symbols(f)]
    two = put(2, put(2, put(1, bytes([1])) + put(1, bytes([2, 3]))))
    wrong = put(2, put(1, b"\xff") + put(2, put(2, b"\xff")))
    assert [scip.decoded_batch([f, two]).to_pylist() for f in (two, wrong)] == [scip._batch([d for f in (x, two) for d in scip.decode_index(f)]).to_pylist() for x in (two, wrong)]
    for broken in (b"\x0b", b"\x12", b"\x12\x05\x0a", b"\x12\x03\x12\x05\x08" + bytes(9)):
        with pytest.raises(ValueError):
            scip.decoded_batch([files[-1], broken])


def test_a_walk_makes_its_edges_once(spark, monkeypatch):
    """before, every level and every use made all edges again, and a trace made all of them distinct."""
    plans, cut = [], context.cut
    seen = lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, name)
    monkeypatch.setattr(context, "cut", seen)
    for query in (context_queries.k15_compiled_use, context_queries.b7_deep_context):
        plans.clear()
        plans.append(query(Model(spark, SF))._jdf.queryExecution().optimizedPlan().toString())
        assert sum("l_orderkey" in p for p in plans) == 1
    monkeypatch.setattr(graph, "cut", seen)
    plans.clear()
    context_queries.g1_trace_bounded(Model(spark, SF))
    assert plans[0].count("Aggregate [") == 3  # lines, seeds, and what a step found


def test_candidates_that_no_ledger_pays_are_counted(spark, monkeypatch):
    """before, every effect and test of a selected symbol was listed, ranked and folded for each request."""
    rng = random.Random(17)
    written, cut = [], compiled.cut

    def seen(df, name):
        out = cut(df, name)
        written.extend([out.count()] if name in ("compiled-effects", "compiled-validation") else [])
        return out

    monkeypatch.setattr(compiled, "cut", seen)
    n, paths = 60, [f"p{i:02}" for i in range(28)] + ["é", None]
    symbols = [(f"s{i}", f"f{i}", paths[i // 2], 0, 8, "source", i >= 20) for i in range(n)]
    edges = sorted({(f"s{rng.randrange(n)}", f"s{rng.randrange(8)}") for _ in range(300)})
    effects = [(f"x{i}", f"s{rng.randrange(9)}", rng.choice(["view", "error"])) for i in range(150)] + [(f"x{rng.randrange(150)}", f"s{rng.randrange(5)}", "click") for _ in range(60)]
    effects += effects[:40] + [("x1", None, "a"), (None, "s1", "view"), (None, "s2", "error"), (None, "s3", "view")]
    seeds = [(f"q{r}", f"s{rng.randrange(12)}") for r in range(12) for _ in range(r % 5 + 1)]
    bad, limits = {"s2", "s4"}, budget.Limits(9, 4000, 4000, reserve=2, work=11)
    about = dict(zip("symbols edges effects conflicts events files".split(), (
        spark.createDataFrame(symbols, "symbol_key string, file_id string, path string, start_byte long, end_byte long, artifact_class string, is_test boolean"),
        spark.createDataFrame([(a, b, "calls", "stale", a + b) for a, b in edges], "source string, target string, type string, status string, fact_id string"),
        spark.createDataFrame(effects, "effect_id string, subject string, effect_type string"),
        spark.createDataFrame([(s, "open") for s in bad] + [("s1", "resolved")], "subject_key string, status string"),
        spark.createDataFrame([(i, s, k) for i, (_, s, k) in enumerate(effects)], "event_id long, subject string, kind string"),
        spark.createDataFrame([], "file_id string, path string, content_hash string, live_hash string")), strict=True))
    every, state = compiled.decisions(spark.createDataFrame(seeds, "request string, seed string"), compiled.Evidence(**about), limits, ["none"], 1)
    assert max(written) <= 12 * limits.work

    want, totals = collections.Counter(), {}
    for request in {q for q, _ in seeds}:
        own, fold = sorted({s for q, s in seeds if q == request}), budget._Fold(limits)
        chosen = [s for s in own if fold.take(1, 0, False, 8 + 96, 2) == "selected"]
        assert chosen == own
        want.update((request, "seeds", s, "explicit_seed", "selected") for s in chosen)
        hit, last, tests = collections.defaultdict(list), {}, {paths[int(a[1:]) // 2] for a, b in edges if b in chosen and int(a[1:]) >= 20}
        for i, (x, s, k) in enumerate(effects):
            if s in chosen:
                hit[x].append((s in bad, k))
                last[s, k] = i
        text = lambda x: (x is not None, x or "")
        rows = [("effects", x, f"effect_of_{min(k for _, k in hit[x])}", any(b for b, _ in hit[x])) for x in sorted(hit, key=text)]
        rows += [("temporal", x, f"last_{k}", False) for x, k in sorted((f"{s}@{k}@{i}", k) for (s, k), i in last.items())]
        rows += [("validation", x and f"test:{x}", "covers_selected", False) for x in sorted(tests, key=text)]
        for section, item, reason, unsure in rows:
            spent = fold.spent
            decision = fold.take(1, 0, unsure, 64, 16)
            behind = section != "temporal" and spent == limits.work
            want[(request, section, None if behind else item, None if behind else reason, decision)] += 1
        totals[request] = fold.totals()
    got = collections.Counter()
    for r in every.collect():
        got[(r.request, r.section, r.item, r.reason, r.decision)] += r.n
    assert got == want and {r.request: tuple(r)[1:] for r in state.collect()} == totals
    assert sum(v for k, v in want.items() if k[4] == "work_units") > 500
