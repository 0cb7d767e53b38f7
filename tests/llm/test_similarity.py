from collections import Counter

import numpy as np
import pytest
from cases import awkward, empty, frame, rows
from stratalog.llm import similarity_join


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain(data):
    """(row number, set size, root row) of each row, and each root's smallest id."""
    sets, root = [shingles(d[1]) for d in data], list(range(len(data)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    members = {}
    for i in range(len(data)):
        members.setdefault(find(i), []).append(i)
    least = {r: min((data[i][0] for i in m if data[i][0] is not None), default=None) for r, m in members.items()}
    return [(data[i][0], len(sets[i]), least[find(i)]) for i in range(len(data))], members


def test_every_row_has_its_component(spark):
    want, members = plain(rows())
    got = similarity_join.near_duplicates(spark, frame(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    df = awkward(spark)
    kept = similarity_join.keep_one(spark, df)
    assert kept.columns == df.columns
    stay = Counter()
    for m in members.values():
        first = min(m, key=lambda i: (rows()[i][0] is None, rows()[i][0] or 0))
        stay[rows()[first][0], rows()[first][1]] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == stay


def test_empty_tables(spark):
    assert similarity_join.near_duplicates(spark, empty(spark)).count() == 0
    assert similarity_join.keep_one(spark, empty(spark)).count() == 0


def test_heap_merge_counts_postings():
    lists = [np.array(x) for x in ([0, 2, 5], [2], [1, 2, 5], [0])]
    assert similarity_join.merge_short(lists, 7).tolist() == [2, 1, 3, 0, 0, 2, 0]


@pytest.mark.parametrize("seed", range(4))
def test_search_block_is_t_occurrence_search(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centre = np.unique(rng.integers(0, 500, 120)).astype(np.uint64)
    others = []
    for k in range(60):
        keep = centre[rng.random(len(centre)) < rng.choice([0.3, 0.88, 0.95, 1.0])]
        others.append(np.unique(np.concatenate([keep, rng.integers(0, 500, k % 9).astype(np.uint64)])))
    merged = []
    real = similarity_join.merge_short
    monkeypatch.setattr(similarity_join, "merge_short", lambda lists, n: merged.append(len(lists)) or real(lists, n))
    a = set(centre.tolist())
    want = [i for i, o in enumerate(others) if 100 * len(a & set(o.tolist())) >= 80 * len(a | set(o.tolist()))]
    assert similarity_join.search_block(centre, others) == want and want and merged
    few = similarity_join.search_block(centre, others[:3])
    assert few == [i for i in want if i < 3]


def test_a_similarity_of_just_four_fifths_links():
    a = np.arange(9).astype(np.uint64)
    b = np.concatenate([a[:8], [np.uint64(99)]])
    assert similarity_join.search_block(a, [b]) == [0]  # 8 of 10
    assert similarity_join.search_block(a, [a[:7]]) == []  # 7 of 9


def test_few_candidates_take_no_pass_over_sketches(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2)], "centre long, other long")
    assert similarity_join.may_link(pairs, None, 4) is pairs
    want, _ = plain(rows())
    for few, many in ((0, 0), (0, 10**6)):
        monkeypatch.setattr(similarity_join, "FEW_PAIRS", few)
        monkeypatch.setattr(similarity_join, "MANY_PAIRS", many)
        got = similarity_join.near_duplicates(spark, frame(spark)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)


def test_long_lists_are_compared_whole_from_the_third_round(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, " ".join(rng.choice(list("ab"), 12))) for i in range(60)]
    names, stored = [], similarity_join.stored
    monkeypatch.setattr(similarity_join, "stored", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(similarity_join, "SHORT_LIST", 4)
    monkeypatch.setattr(similarity_join, "LATE_LIST", 64)
    got = similarity_join.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(plain(data)[0])
    assert "join-lists-2" in names and "join-lists-4" not in names
