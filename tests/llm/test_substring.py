from collections import Counter

import numpy as np
import pytest
from cases import awkward, empty, frame, rows
from stratalog.llm import substring_dedup


def plain(data, window=20):
    """(id, words, words that go, kept) of each row; rows of one id count in any order, so these are tried in both."""
    seen, out = set(), []
    for d in sorted((d for d in data if d[0] is not None), key=lambda d: d[0]):
        w, gone = (d[1] or "").split(), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        out.append((d[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out + [(None, len((d[1] or "").split()), 0, " ".join((d[1] or "").split())) for d in data if d[0] is None]


@pytest.mark.parametrize("hot", [2000, 1])
def test_every_row_is_taken(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    data = rows()
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in substring_dedup.deduplicate(spark, frame(spark)).collect())
    assert got == Counter(plain(data))
    assert any(g[0] == 7 and g[2] >= 40 for g in got) and all(g[2] == 0 for g in got if g[0] is None)


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    df = awkward(spark)
    out = substring_dedup.remove_repeats(spark, df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    want = Counter()
    for d, p in zip(sorted(rows(), key=lambda d: (d[0] is None, d[0] or 0)), plain(rows()), strict=True):
        text = p[3] if p[2] else d[1]
        want[d[0], text, len(text) if p[2] else d[4]] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want
    assert {r.block for r in out.collect()} == {"z"} and len({r["a.b"] for r in out.collect()}) == len(rows())


def test_empty_tables(spark):
    assert substring_dedup.deduplicate(spark, empty(spark)).count() == 0
    assert substring_dedup.remove_repeats(spark, empty(spark)).count() == 0


def test_matching_statistics_of_the_automaton():
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(5)]
        automaton, before = substring_dedup.SuffixAutomaton(), []
        for t in texts:
            got = automaton.stream(t)
            for i in range(len(t)):
                best = 0
                for n in range(1, i + 2):
                    piece = t[i - n + 1 : i + 1]
                    inside = any(b[j : j + n] == piece for b in before for j in range(len(b))) or any(t[j : j + n] == piece for j in range(i - n + 1))
                    best = n if inside else best
                assert got[i] == best
            before.append(t)


def test_shifted_passages_are_found_by_the_automaton(spark, tmp_path):
    """No two segments are equal here: the passage is cut differently by what stands around it."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(23)]
    texts = [[f"a{rng.integers(10**6)}" for _ in range(15)] + passage[k : 21 + k] + [f"b{rng.integers(10**6)}" for _ in range(15)] for k in range(3)]
    data = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)]
    marked, real = [], substring_dedup.automaton_marks
    try:
        substring_dedup.automaton_marks = lambda *a: marked.append(real(*a)) or marked[-1]
        got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in substring_dedup.deduplicate(spark, frame(spark, data)).collect()}
    finally:
        substring_dedup.automaton_marks = real
    assert got == {p[0]: p[2] for p in plain(data)} and got[1] == 20
    from stratalog.llm.common import open_folder

    store, path = open_folder(marked[0])
    from pyarrow import fs

    assert any(f.size for f in store.get_file_info(fs.FileSelector(path)))
