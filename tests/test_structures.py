"""Indexes, automata, trees, folds and ranks against plain Python."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F
from stratalog.operators import budget, graph, lifecycle, merkle, names, phrases, projection, ranks
from stratalog.plans import audit


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


# --- the stored projection


def source(spark, facts, edges, effects=(), conflicts=(), coverage=()):
    f = spark.createDataFrame(facts, "symbol_key string, fact_id string, file_id string, method string, confidence double, start_byte long, end_byte long")
    e = spark.createDataFrame(edges, "fact_id string, source string, target string, type string, status string")
    x = spark.createDataFrame(list(effects), "subject string")
    c = spark.createDataFrame(list(conflicts), "subject_key string, status string")
    return projection.Source(f, e, x, c, spark.createDataFrame(list(coverage), "file_id string, lang string, presence string, status string"))


def some_rows(seed, n=60):
    rng = random.Random(seed)
    facts = [(f"s{i}", f"f{i}:{k}", f"d{i % 9}", rng.choice(["exact", "semantic", "structural"]), rng.random(), 0, rng.randrange(99)) for i in range(n) for k in range(rng.randrange(1, 3))]
    edges = [(f"e{i}", f"s{rng.randrange(n)}", f"s{rng.randrange(n)}", rng.choice(["calls", "tests", "configures", "references"]), rng.choice(["resolved_symbol", "stale", "ambiguous"])) for i in range(4 * n)]
    return facts, edges, [(f"s{rng.randrange(n)}",) for _ in range(n)], [(f"s{rng.randrange(n)}", rng.choice(["open", "resolved"])) for _ in range(n)], [(f"d{i}", "en" if i % 2 else "de", "present", rng.choice(["complete", "stale", "partial"])) for i in range(9)]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_projection_kept_up_by_keys_equals_a_new_one(spark, folder):
    old = some_rows(1)
    new = [list(x) for x in old]
    new[0][3] = (*new[0][3][:2], "d8", "semantic", 0.99, 0, 7)
    del new[0][20], new[1][5], new[1][77]
    new[1] += [("e-new", "s3", "s59", "calls", "resolved_symbol"), ("e-more", "s-new", "s1", "tests", "stale")]
    new[0].append(("s-new", "f-new", "d-new", "exact", 0.5, 0, 8))
    new[2].pop(4)
    new[3].append(("s40", "open"))
    new[4][2] = ("d2", "fr", "present", "failed")
    new[4].append(("d-new", "en", "present", "partial"))
    before, after = source(spark, *old), source(spark, *new)
    p = projection.Projection(spark, folder, buckets=16)
    p.build("a", "1", before)
    changed = projection.affected(before, after)
    row = ["file_id", "lang", "presence", "status"]
    p.advance("a", "b", "2", changed, after, before.coverage.join(after.coverage, row, "left_anti"), after.coverage.join(before.coverage, row, "left_anti"))
    fresh = projection.Projection(spark, folder + "-fresh", buckets=16)
    fresh.build("b", "2", after)
    for kind in projection.SCHEMAS:
        assert rows_of(p.read("b", kind)) == rows_of(fresh.read("b", kind)) != rows_of(p.read("a", kind))
    assert projection.content(p.manifest("b")) == projection.content(fresh.manifest("b")) == projection.content(p.recount("b"))
    assert p.status("b", "b") == "ready" and p.status("a", "b") == "superseded" and p.status("c", "b") == "absent"
    assert projection.content_hash(p.manifest("b")).first().content_hash == projection.content_hash(fresh.recount("b")).first().content_hash


def test_a_small_delta_leaves_other_buckets_alone(spark, folder):
    facts, edges, *rest = some_rows(2)
    before = source(spark, facts, edges, *rest)
    after = source(spark, facts, [*edges, ("e-new", "s3", "s5", "calls", "resolved_symbol")], *rest)
    p = projection.Projection(spark, folder, buckets=32)
    p.build("a", "1", before)
    none = before.coverage.limit(0)
    p.advance("a", "b", "2", projection.affected(before, after), after, none, none)
    folders = {(r.kind, r.bucket): r.folder for r in p.manifest("a").collect()}
    moved = {(r.kind, r.bucket) for r in p.manifest("b").collect() if r.kind != "rollups" and folders.get((r.kind, r.bucket)) != r.folder}
    assert 1 <= len({b for _, b in moved}) <= 2 and p.status("b", "b") == "ready"
    assert [r.callers for r in p.cards_of("b", ["s5"]).collect()] == [p.cards_of("a", ["s5"]).first().callers + 1]


def test_an_equal_build_reads_no_source(spark, folder):
    s = source(spark, *some_rows(3))
    p = projection.Projection(spark, folder)
    p.build("a", "1", s)
    broken = s.facts.withColumn("fact_id", F.raise_error(F.lit("read")))
    again = p.build("a", "1", projection.Source(broken, s.edges, s.effects, s.conflicts, s.coverage))
    assert projection.content(again) == projection.content(p.recount("a"))
    with pytest.raises(ValueError):
        p.build("a", "2", s)


def test_damage_shows(spark, folder):
    import shutil

    p = projection.Projection(spark, folder)
    p.begin("x")
    assert p.status("x", "x") == "building"
    p.fail("x")
    assert p.status("x", "x") == "failed"
    p.build("a", "1", source(spark, *some_rows(4)))
    cards = p.read("a", "cards")
    hurt = {"changed": cards.withColumn("tokens", F.col("tokens") + F.when(F.col("symbol_key") == "s1", 1).otherwise(0)), "lost": cards.where("symbol_key != 's1'"), "doubled": cards.unionByName(cards.where("symbol_key = 's1'"))}
    for name, df in hurt.items():
        other = f"{folder}-{name}"
        shutil.copytree(folder[7:], other[7:])
        copy = projection.Projection(spark, other)
        files = copy.manifest("a").where("kind = 'cards'").first().folder
        shutil.rmtree(f"{other[7:]}/a/manifest")
        copy._write(f"{other}/a/new", "cards", df)
        claimed = p.manifest("a").withColumn("folder", F.when(F.col("kind") == "cards", F.lit(f"{other}/a/new")).otherwise(F.col("folder"))).drop("generation_id", "fingerprint")
        copy._finish("a", "1", claimed)
        assert files and copy.status("a", "a") == "stale", name
    assert p.status("a", "a") == "ready"


# --- phrases and names


@pytest.mark.parametrize("block_tokens", [50, phrases.BLOCK_TOKENS])
def test_phrases_against_a_scan(spark, folder, block_tokens):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "Dé", "e-f", "g"]) for _ in range(n))
    records = [(i, text(rng.randrange(0, 40))) for i in range(80)] + [(100, None), (101, ""), (102, "only once"), (103, "a " * 5000)]
    asked = [(i, text(rng.randrange(1, 5))) for i in range(30)] + [(50, "a a a"), (51, ""), (52, "zzz a"), (53, None), (54, "ONCE"), (55, "a " * 40)]
    index = phrases.build_index(spark.createDataFrame(records, "record long, text string"), folder, block_tokens=block_tokens)
    got = {(r.phrase, r.record): r.starts for r in phrases.search(index, spark.createDataFrame(asked, "phrase long, text string")).collect()}
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    want = {}
    for q, phrase in asked:
        w = split(phrase)
        for r, body in records:
            words = split(body)
            at = [i for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w] if w else []
            if at:
                want[q, r] = at
    assert got == want and (50, 103) in got
    coded = index.postings().where("token = 'a' AND record = 103").first().coded
    assert coded[0] == 0 and set(coded[1:]) == {1}
    pairs = {(w, r) for r, body in records for w in split(body)}
    assert {(r.token, r.record) for r in index.postings().collect()} == pairs and index.postings().count() == len(pairs)
    empty = spark.createDataFrame([], "record long, text string")
    assert phrases.search(phrases.build_index(empty, folder + "-empty"), spark.createDataFrame(asked, "phrase long, text string")).count() == 0


@pytest.mark.parametrize("rows, entities", [(400, 3), (7, 3), (7, 50), (1000, 50)])
def test_one_sentinel_past_the_bound(spark, rows, entities):
    rng = random.Random(6)
    hits = [(q, f"k{rng.randrange(12):02}", i) for q in range(4) for i in range(rng.randrange(1, 30))]
    order = [F.col("entity"), F.col("i")]
    got = phrases.bounded(spark.createDataFrame(hits, "q long, entity string, i long"), "q", "entity", order, rows, entities)
    for q in range(4):
        kept, seen, sentinel = [], set(), None
        for r in sorted(h for h in hits if h[0] == q)[:rows]:
            if r[1] not in seen and len(seen) >= entities:
                sentinel = r
                break
            seen.add(r[1])
            kept.append(r)
        if sentinel is None and len(kept) == rows:
            sentinel = kept.pop()
        found = got.where(F.col("q") == q).orderBy("place").collect()
        assert [(r.q, r.entity, r.i) for r in found if not r.sentinel] == kept
        assert [(r.q, r.entity, r.i) for r in found if r.sentinel] == ([sentinel] if sentinel else [])


@pytest.mark.parametrize("whole", [False, True])
def test_names_in_blocks_against_a_scan(spark, whole):
    rng = random.Random(7)
    words = ["He", "she", "hers", "his", "a_b", "É", "x"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "s"]) for _ in range(rng.randrange(20)))) for i in range(60)] + [(90, None), (90, ""), (91, "hers")]
    listed = [("he",), ("SHE",), ("hers",), ("s his",), ("a_b",), ("É",), ("",), (None,), ("he",), ("He",), ("shers",), ("!",)]
    for block in (4, 1000):
        got = {(r.request, r.name) for r in names.mentions(spark.createDataFrame(texts, "request long, text string"), spark.createDataFrame(listed, "name string"), whole, block).collect()}
        low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
        framed = lambda t: " " + " ".join(w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789_" else " " for c in t.lower()).split()) + " "
        form = framed if whole else low
        assert got == {(i, n) for i, t in texts for (n,) in listed if t and n and form(n).strip() and form(n) in form(t)}


# --- trees


def test_trees_are_descended_to_what_differs(spark):
    rng = random.Random(8)
    a = [(f"k{i}", f"v{rng.randrange(5)}") for i in range(3000)] + [("twice", "x"), ("twice", "x"), (None, "n")]
    b = [r for r in a if r[0] not in ("k7", "k1000")] + [("new", "1"), ("twice", "y")]
    b[5] = (b[5][0], "other")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    x = merkle.tree(frame(a), F.col("k"), F.col("v"), keep_rows=True, leaf_rows=8)
    y = merkle.tree(frame(b).repartition(7), F.col("k"), F.col("v"), keep_rows=True, depth=x.depth)
    assert x.depth == 3 and merkle.differing_leaves(x, y).count() <= 5
    got = {(r.key, r.change, r.before, r.after) for r in merkle.differences(x, y).collect()}
    gone = dict(a)
    assert got == {("k7", "removed", gone["k7"], None), ("k1000", "removed", gone["k1000"], None), ("new", "added", None, "1"), ("twice", "modified", "x*2", "x*2,y"), (b[5][0], "modified", gone[b[5][0]], "other")}
    same = merkle.tree(frame(a[::-1]), F.col("k"), F.col("v"), leaf_rows=8)
    assert same.root().first() == x.root().first() != y.root().first() and merkle.differing_leaves(x, same).count() == 0
    assert merkle.tree(frame([]), F.col("k"), F.col("v")).root().first().n == 0


def test_a_seal_tells_replay_from_conflict(spark, folder):
    t = lambda rows: merkle.tree(spark.createDataFrame(rows, "k string, v string"), F.col("k"), F.col("v"))
    store = merkle.Sealed(spark, folder)
    assert [store.seal("d", t([("a", "1"), ("b", "2")])), store.seal("d", t([("b", "2"), ("a", "1")])), store.seal("d", t([("a", "1")])), store.seal("e", t([("a", "1")]))] == ["sealed", "replayed", "conflict", "sealed"]


# --- budgets


def plain_fold(rows, limits):
    out, fold = [], budget._Fold(limits)
    for rank, item, work, depth, unsure, size, tokens in sorted(rows):
        out.append((rank, item, fold.take(work, depth, unsure, size, tokens), fold.spent))
    return out


@pytest.mark.parametrize("limits", [budget.Limits(12, 400, 90), budget.Limits(5, 10**6, 10**6), budget.Limits(9, 300, 80, 3, 2, 60), budget.Limits(9, 10**6, 10**6, 2, 2, 10**6), budget.Limits(0, 10, 10), budget.Limits(400, 90, 10**6, 5, 1, 700)])
def test_ranges_against_one_fold(spark, limits):
    rng = random.Random(9)
    every = {q: [(k + 1, f"{q}{k}", rng.randrange(0, 4), rng.randrange(4), rng.random() < 0.2, rng.choice([0, 1, 20, 60, 500]), rng.choice([0, 1, 5, 30])) for k in range(n)] for q, n in (("a", 700), ("b", 25), ("c", 1))}
    df = spark.createDataFrame([(q, *r) for q, rows in every.items() for r in rows], "request string, rank long, item string, work long, depth long, uncertain boolean, bytes long, tokens long")
    got = {q: [] for q in every}
    for r in budget.select(df.repartition(5), limits, width=20).collect():
        got[r.request].append((r.rank, r.item, r.decision, r.ledger))
    for q, rows in every.items():
        assert sorted(got[q]) == plain_fold(rows, limits)


# --- graphs and ranks


def test_suffixes_without_a_nested_loop(spark):
    rng = random.Random(10)
    targets = ["/".join(rng.choice(["a", "b", "Test", "x_y"]) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    edges = spark.createDataFrame([(f"src{i}", t) for i, t in enumerate(targets)], "source string, target string")
    seeds = ["a/b", "./B", "test", "x_y", "src3", "y", "", "%b", "a%test"]
    hits = graph.suffix_matches(edges, spark.createDataFrame([(s,) for s in seeds], "node string"))
    import fnmatch

    def like(text, seed):
        s = seed.lower()
        while s.startswith("./"):
            s = s[2:]
        return fnmatch.fnmatchcase(text.lower(), "*" + s.replace("%", "*").replace("_", "?"))

    assert {(r.target, r.seed) for r in hits.collect()} == {(t, s) for t in targets for s in seeds if t == s or like(t, s)}
    many = spark.createDataFrame([(f"seed{i}",) for i in range(10_000)], "node string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = audit.audit(graph.impact(edges, many))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.cartesian == 0


def test_impact_takes_kinds_and_parts(spark):
    e = spark.createDataFrame([("p1", "m.a", "path", "resolved_file"), ("p1", "m.a", "external", "stale"), ("p2", "m.a", "symbol", "resolved_symbol"), ("spec3", "x/M.A", "external", "ambiguous")], "source string, target string, ref_kind string, status string")
    got = {r.dependent: (r.is_test, r.verified, r.uncertain) for r in graph.impact(e, spark.createDataFrame([("./m.a",)], "node string")).collect()}
    assert got == {"p1": (False, True, True), "spec3": (True, False, True)}


def test_chains_of_any_length_and_cycles(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("generation_id"), (F.col("id") - 1).alias("parent_id"))
    pairs = spark.createDataFrame([(0, n - 1), (70_001, 99_999), (5, 5), (9, 3), (3, n)], "older long, newer long")
    got = {(r.older, r.newer): (r.is_ancestor, r.distance) for r in lifecycle.Ancestry(chain).judge(pairs).collect()}
    assert got == {(0, n - 1): (True, n - 1), (70_001, 99_999): (True, 29_998), (5, 5): (True, 0), (9, 3): (False, None), (3, n): (False, None)}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "generation_id long, parent_id long")
    with pytest.raises(ValueError):
        lifecycle.Ancestry(loop)


@pytest.mark.parametrize("kind", ["double", "long"])
def test_ranks_against_sorting(spark, kind):
    rng = random.Random(11)
    wild = [0.0, -0.0, -1.5, 1e300, -1e300, 5e-324, math.inf, -math.inf] if kind == "double" else [0, -1, 2**62, -(2**62), 7]
    rows = [(rng.choice(["a", "b", None]), rng.choice(wild) if rng.random() < 0.3 else (rng.gauss(0, 1) if kind == "double" else rng.randrange(-99, 99))) for _ in range(3000)] + [("hot", 3.0 if kind == "double" else 3)] * 2000 + [("none", None), ("one", 4.0 if kind == "double" else 4)]
    shares = {"least": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: r for r in ranks.nearest_ranks(spark.createDataFrame(rows, f"g string, v {kind}"), ["g"], "v", shares).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        for name, p in shares.items():
            assert got[g][name] == values[max(1, math.ceil(round(p * len(values), 9))) - 1]


# --- compiled contexts


def test_a_context_does_not_depend_on_the_seeds_order(spark):
    from stratalog.operators import compiled, context

    rng = random.Random(12)
    n = 40
    symbols = spark.createDataFrame([(f"s{i}", f"f{i % 12}", f"p{i % 12}", 0, rng.randrange(200), rng.choice(["source", "configuration"]), i % 12 == 5) for i in range(n)], "symbol_key string, file_id string, path string, start_byte long, end_byte long, artifact_class string, is_test boolean")
    edges = spark.createDataFrame([(f"s{rng.randrange(n)}", f"s{rng.randrange(n)}", rng.choice(["calls", "tests", "imports"]), rng.choice(["resolved_symbol", "resolved_symbol", "stale"]), f"e{i:03}") for i in range(150)], "source string, target string, type string, status string, fact_id string")
    effects = spark.createDataFrame([(f"x{i}", f"s{rng.randrange(n)}", "view", i) for i in range(60)], "effect_id string, subject string, effect_type string, event_id long")
    conflicts = spark.createDataFrame([("s1", "open"), ("s2", "resolved")], "subject_key string, status string")
    files = spark.createDataFrame([(f"f{i}", f"p{i}", f"h{i}", None if i == 3 else "other" if i == 4 else f"h{i}") for i in range(12)], "file_id string, path string, content_hash string, live_hash string")
    e = compiled.Evidence(symbols, edges, effects, conflicts, effects.select("event_id", "subject", F.col("effect_type").alias("kind")), files)
    requests = spark.createDataFrame([("q", "bug_fix"), ("r", "explore"), ("nothing", "audit")], "request string, task_kind string")
    seeds = [("q", f"s{i}") for i in (3, 1, 7, 20, 11)] + [("r", "s2"), ("nothing", "unknown")]
    limits = budget.Limits(6, 10_000, 10_000, reserve=1, depth=1, work=14)
    make = lambda some: {r.request: r for r in compiled.compile_context(requests, spark.createDataFrame(some, "request string, seed string"), context.required_roles(spark), e, limits, ["calls", "tests", "imports"], 1).collect()}
    got, again = make(seeds), make([*seeds[::-1], seeds[0]])
    assert {k: r.context_hash for k, r in got.items()} == {k: r.context_hash for k, r in again.items()} and got == again
    q = got["q"]
    assert q.cost.work == 14 and q.cost.records == len(q.items) <= 7  # the ledger binds: five seeds, then what is left
    assert [i.section for i in q.items] == sorted((i.section for i in q.items), key=compiled.SECTIONS.index) and [i.item for i in q.items][:5] == sorted(f"s{i}" for i in (3, 1, 7, 20, 11))
    assert any(o.why.endswith("_work_units") for o in q.omissions) and q.seal in ("partial", "blocked") and {x.path for x in q.leases} >= {"p3", "p1", "p7", "p8", "p11"}
    states = {r.role: r.state for r in got["nothing"].roles}
    assert got["nothing"].items is None and got["nothing"].seal == "blocked" and states["primary_implementation"] == "missing" and states["effect"] == "unavailable"
    assert {r.role: r.state for r in q.roles}["primary_implementation"] == "satisfied"


def test_sections_share_one_ledger(spark):
    rows = lambda items: spark.createDataFrame([("q", i + 1, x, 1, 0, False, 10, 1) for i, x in enumerate(items)], "request string, rank long, item string, work long, depth long, uncertain boolean, bytes long, tokens long")
    limits = budget.Limits(3, 1000, 1000, work=5)
    first = budget.fold(rows(["a", "b"]), limits)
    state = budget.state_after(first)
    second = budget.fold(rows(["c", "d", "e", "f"]), limits, start=state)
    assert [(r.item, r.decision, r.spent) for r in second.orderBy("rank").collect()] == [("c", "selected", 3), ("d", "records", 4), ("e", "records", 5), ("f", "work_units", 5)]
    assert budget.state_after(second.where("request = 'other'"), state).first().n == 2
