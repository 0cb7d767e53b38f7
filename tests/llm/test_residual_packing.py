import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward, empty, frame, rows
from stratalog.llm import queries, residual_packing, tokens


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_tokenizer_path())


def ids_of(tok, text, end):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def whole(got, docs, tok, window, end=0):
    """Every row's pieces are there once, cut at multiples of the window, and sequences are gapless; their number."""
    want = Counter()
    for doc_id, text in docs:
        ids = ids_of(tok, text, end)
        for k, at in enumerate(range(0, len(ids), window)):
            part = ids[at : at + window]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("sizes", [None, (60, 10)])
def test_every_piece_has_a_place(spark, tok, monkeypatch, sizes):
    if sizes:  # many groups and several rounds
        monkeypatch.setattr(residual_packing, "MERGE_ITEMS", sizes[0])
        monkeypatch.setattr(residual_packing, "LEAF_LEAST", sizes[1])
    for df in (frame(spark), awkward(spark)):
        got = residual_packing.pack_whole_documents(spark, df, tokens.word_tokenizer_path(), window=256, keep_ids=True).collect()
        whole(got, [(d[0], d[1]) for d in rows()], tok, 256)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert residual_packing.pack_whole_documents(spark, empty(spark), tokens.word_tokenizer_path()).count() == 0


def test_partitions_and_rounds_stay_near_one_best_fit(spark, tok):
    rng = random.Random(2)
    some = [(i, " ".join(["word"] * rng.choice([1, 30, 60, 90, 120, rng.randrange(700)])), "en", "s", 1) for i in range(3000)]
    df = frame(spark, some).repartition(20)
    got = residual_packing.pack_whole_documents(spark, df, tokens.word_tokenizer_path(), window=256).collect()
    n = whole(got, [(d[0], d[1]) for d in some], tok, 256)
    lengths = np.array([r.length for r in got])
    assert n <= 1.01 * residual_packing.best_fit(lengths, 256)[1]


def test_long_documents_without_partners_end_the_tree(spark, tok, monkeypatch):
    monkeypatch.setattr(residual_packing, "MERGE_ITEMS", 50)
    some = [(i, " ".join(["word"] * 200), "en", "s", 1) for i in range(600)]
    got = residual_packing.pack_whole_documents(spark, frame(spark, some).repartition(6), tokens.word_tokenizer_path(), window=256).collect()
    assert whole(got, [(d[0], d[1]) for d in some], tok, 256) == 600


def test_best_fit_takes_the_least_room():
    rng = random.Random(6)
    for _ in range(100):
        window = rng.randrange(5, 60)
        lengths = np.array([rng.randrange(1, window + 1) for _ in range(rng.randrange(1, 50))])
        bins, n = residual_packing.best_fit(lengths, window)
        rooms, want = [], []
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= length]
            rooms.remove(min(fits)) if fits else want.append(1)
            rooms.append((min(fits) if fits else window) - length)
        assert n == len(want) and sorted(window - np.bincount(bins, weights=lengths).astype(int)) == sorted(rooms)


def test_the_registered_query(spark, tok):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = queries.op12_hierarchical_residual_packing(spark, folder).collect()
    n = whole(got, docs, tok, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 2048)
