import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from stratalog.llm import binary_ids, decontamination, fingerprints, packing, sharding, similarity_join, substring_dedup, token_counts, tokens, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(30)] + ["É", "日本", "the", "of"]


def documents(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 20, 60, 120]))) for _ in range(n // 2)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(rng.choice([0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [None, "", "   ", "a " * 100, base[3], base[3]]
    return [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sharding_law_and_slots(spark):
    rows = [(i, "x" * (i % 5), "en", "s", 1) for i in range(3000)] + [(None, None, None, None, None)]
    got = sharding.shard_documents(frame(spark, rows), sharding.Topology.uniform()).collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(24))
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
        text = "" if r.doc_id is None else "x" * (r.doc_id % 5)
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_reweighting_moves_only_through_the_changed_subtree(spark):
    t = sharding.Topology.uniform()
    df = spark.range(4000)
    a = sharding.place(sharding.place(df, df["id"], t, "a"), df["id"], t.reweight(5, 3.0), "b").collect()
    for r in a:
        if r.a != r.b:
            assert r.b // 8 == 0  # only the heavier region takes keys
            if r.a // 8 == 0:
                assert r.b // 4 == 1  # within it, only the heavier rack
            if r.a // 4 == 1:
                assert r.b == 5  # within that, only the heavier shard


def brute_hits(text, items, window=10):
    words = decontamination.fold((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        iw = decontamination.fold((t or "").encode())
        m = min(window, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    rows = documents(2)
    items = [(1, " ".join((rows[4][1] or "x y").split()[:12])), (2, "w1 w2"), (3, ""), (4, None), (5, "w1 w2"), (6, (rows[5][1] or "q") + " zzz")]
    got = decontamination.contaminated_spans(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got} == {(d[0], a, b, tuple(c)) for d in rows for a, b, c in [brute_hits(d[1], items)]}


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("short", [256, 2])
def test_jaccard_join(spark, short, monkeypatch):
    monkeypatch.setattr(similarity_join, "SHORT_LIST", short)
    rows = documents(3, 60)
    sets, root = {d[0]: shingles(d[1]) for d in rows}, {d[0]: d[0] for d in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = similarity_join.near_duplicates(spark, frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("short", [1024, 16])
def test_jaccard_join_of_a_drifting_group(spark, short, monkeypatch):
    """Copies of one text that drift apart: lists hold several components, so later rounds are needed."""
    monkeypatch.setattr(similarity_join, "SHORT_LIST", short)
    rng, texts = random.Random(4), []
    base = [f"v{i}" for i in range(200)]
    for i in range(120):
        w = list(texts[rng.randrange(len(texts))]) if texts and i % 3 else list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    sets, root = [shingles(" ".join(w)) for w in texts], list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)]
    got = similarity_join.near_duplicates(spark, frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(sets))}
    assert len(set(map(find, range(len(sets))))) > 2


def test_sketches_lose_no_link():
    rng = np.random.default_rng(0)
    for n in (3, 150, 2500, 20000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 10 * 2 % max(n // 10, 1)).astype(np.uint64)])
        far = rng.integers(0, 2**63, n).astype(np.uint64)
        v = [np.unique(x) for x in (a, b, far)]
        s = similarity_join.sketches(np.concatenate(v), np.concatenate([[0], np.cumsum([len(x) for x in v])]))
        assert 0 in similarity_join.near_sketches(s[0], [s[1], s[2]])
        assert n < 100 or 1 not in similarity_join.near_sketches(s[0], [s[1], s[2]])


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    rows = documents(4)
    seen, want = set(), {}
    for d in rows:
        w, gone = (d[1] or "").split(), set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        want[d[0]] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    got = substring_dedup.deduplicate(spark, frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got} == want


def test_packing(spark):
    assert packing.fill({5: 2, 3: 1}, 13) == {5: 2, 3: 1}
    rows = documents(6) + [(900, "word, " * 5000, "en", "s", 1)]
    got = packing.pack_documents(spark, frame(spark, rows), tokens.word_tokenizer_path(), window=64).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.word_tokenizer_path())
    ids = {d[0]: [*tok.encode(d[1] or "", add_special_tokens=False).ids, 1] for d in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, p in pieces.items():
        assert sorted(x for s, n in p for x in range(s, s + n)) == list(range(len(ids[d])))
    assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        assert sorted(x for o, n in s for x in range(o, o + n)) == list(range(sum(n for _, n in s))) and sum(n for _, n in s) <= 64


def test_simple8b_round_trip(spark):
    rng = np.random.default_rng(7)
    for bits in (1, 4, 12, 16, 31, 60, 64):
        for n in (0, 1, 255, 256, 257, 3000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=bits == 64 and False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64)
            words, per_block = binary_ids.encode(ids)
            assert (binary_ids.decode(words, per_block, n) == ids).all()
    rows = documents(8)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.word_tokenizer_path())
    start, want = 0, {}
    for d in rows:
        ids = [*tok.encode(d[1] or "", add_special_tokens=False).ids, 2]
        want[d[0]] = (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    got = binary_ids.round_trip(spark, frame(spark, rows), tokens.word_tokenizer_path(), 2, 2000).collect()
    assert {r.doc_id: (r.start, r.n_tokens, bytes(r.ids)) for r in got} == want


def test_fingerprints(spark):
    rows = documents(9)
    got = sorted(fingerprints.fingerprint_edits(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    by_text = defaultdict(set)
    for i, (d, r) in enumerate(zip(rows, got, strict=True)):
        text, after = d[1] or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprints_of_short_unspaced_and_long_texts(spark):
    rng = random.Random(11)
    short = [" ".join(rng.sample(WORDS, 6)) for _ in range(20)]
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    base = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [*short, han, han[:200] + "x" + han[200:], " ".join(base), " ".join(base[:2900] + ["z"] * 100), ""]
    got = sorted(fingerprints.fingerprint_edits(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect(), key=lambda r: r.doc_id)
    assert all(r.fingerprint for r in got[:-1]) and len({r.fingerprint for r in got[:20]}) == 20 and got[-1].fingerprint == ""
    assert all(r.near_next < 1 for r in got[:20]) and 0.8 < got[20].near_next < 1
    full = {r.doc_id: {a.anchor for a in r.x} for r in fingerprints.with_anchors(frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), "text", "x").collect()}
    assert len(full[22]) > 1000 and got[22].near_next == len(full[22] & full[23]) / len(full[22] | full[23])


def test_url_rules(spark):
    from stratalog.llm.queries import RULES, url_model

    urls = ["https://a.com/", "http://WWW.Example.com/en/1?x", "http://example.com/en/", "http://x.example.com/de/", "http://a.net/fr/1#z", "http://a.com", None, "nothing", "http://notnet/fr/"]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), RULES, url_model()).collect()}
    assert [got[i].rule for i in range(9)] == ["com/", "www.example.com/en/", "example.com/en/", "com/", "net/fr/", None, None, None, None]
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        assert (got[i].host, got[i].path) == (host, path)
        if got[i].rule is None:
            assert (got[i].verdict == "block") == (url_model().score(host, path) > 0)


def test_token_counts(spark):
    import public_tokenizers

    rows = documents(10) + [(901, "a\n\n\nb\n é\n", "en", "s", 1)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, sizes = token_counts.byte_encoder(path)
    for r, d in zip(sorted(token_counts.count_sections(frame(spark, rows), path).collect(), key=lambda r: r.doc_id), rows, strict=True):
        body = "\n".join([d[3] or "", d[2] or "", d[1] or ""])
        assert r.n_tokens == len(enc.encode_ordinary(body)) == sum(s.n_tokens for s in r.sections)
        assert "".join(body[s.char_start : s.char_end] for s in r.sections) == body


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    assert sharding.shard_documents(none, sharding.Topology.uniform()).count() == 0
    assert similarity_join.near_duplicates(spark, none).count() == 0
    assert substring_dedup.deduplicate(spark, none).count() == 0
    assert packing.pack_documents(spark, none, tokens.word_tokenizer_path()).count() == 0
    assert binary_ids.round_trip(spark, none, tokens.word_tokenizer_path(), 2).count() == 0
    assert fingerprints.fingerprint_edits(none).count() == 0
    wide = spark.createDataFrame([(1, "a b c", "en", "s", 5, 7, "x", "y")], SCHEMA + ", _doc int, spans string, body string")
    assert similarity_join.keep_one(spark, wide).columns == wide.columns
    assert substring_dedup.remove_repeats(spark, wide).count() == 1


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: [f"u{rng.randrange(10**5)}" for _ in range(n)]
    item, passage, copy = text(14), text(25), text(80)
    texts = [copy, copy, [*copy[:79], "zz"], [*text(30), *passage, *text(30)], [*text(30), *passage, *text(30)], [*text(20), *item, *text(20)], text(50), []]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in enumerate(texts)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    sets = [shingles(" ".join(w)) for w in texts]
    alike = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    one = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    stay = [i for i in range(len(texts)) if not any(alike(i, j) for j in range(i))]
    assert sorted(r.doc_id for r in one.collect()) == stay
    want, seen = {}, set()
    for i in stay:
        w, gone = texts[i], set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone |= set(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    rest = stages["substring dedup"](spark, one, str(tmp_path))
    assert {r.doc_id: r.text for r in rest.collect()} == want and want[4] != rows[4][1]
    clean = stages["benchmark decontamination"](spark, rest, str(tmp_path))
    left = {i for i in stay if not brute_hits(want[i], [(1, " ".join(item))])[1]}
    assert {r.doc_id for r in clean.collect()} == left and 5 not in left
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left
