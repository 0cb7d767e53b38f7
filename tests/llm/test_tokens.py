import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import awkward, empty, frame, rows
from stratalog.llm import binary_ids, packing, token_counts, tokens


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_tokenizer_path())


def test_piecewise_encoder_against_the_library(tok):
    rng = random.Random(9)
    pieces = ["the", "Über", "don't", "it's", "É", "ß", "İ", "日本", "a1b2", "x.", "y,,", "(z)", "<|endoftext|>", "<b>", "…", "\u00a0", "\t", "\n", "  ", "A-B", "$5.00", "e\u0301", "😀", "ﬁ", "\u200b", "ſ", "KELVIN", "'", "''s", "…'ll", "_", "1,000", "\x00", "À×÷Þ"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(30))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, n = tokens.encoder(tokens.word_tokenizer_path()).encode(data, offsets)
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends.tolist(), n.tolist(), strict=True):
        assert ids[e - k : e].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("file_bytes", [1 << 25, 3000])
def test_every_row_comes_back(spark, tok, file_bytes):
    for df in (frame(spark), awkward(spark)):
        got = binary_ids.round_trip(spark, df, tokens.word_tokenizer_path(), 2, file_bytes).collect()
        want = Counter((d[0], np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d in rows())
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.n_tokens * 4 == len(r.ids)
            at += r.n_tokens
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert binary_ids.round_trip(spark, empty(spark), tokens.word_tokenizer_path(), 2).count() == 0


def test_chunks_of_a_file():
    import io

    ids = np.arange(1000).astype(np.uint64) ** 5
    body = binary_ids.MAGIC + binary_ids.pack_chunk(np.array([5, 6]), np.array([400, 600]), ids) + binary_ids.pack_chunk(None, np.array([1]), ids[:1])
    a, b = binary_ids.read_chunks(io.BytesIO(body))
    assert a[0].tolist() == [5, 6] and a[1].tolist() == [400, 600] and (a[2] == ids).all() and b[0] is None
    with pytest.raises(ValueError):
        list(binary_ids.read_chunks(io.BytesIO(b"something")))


def test_every_row_is_packed(spark, tok):
    for df in (frame(spark), awkward(spark)):
        got = packing.pack_documents(spark, df, tokens.word_tokenizer_path(), window=256).collect()
        sizes = Counter((d[0], len(tok.encode(d[1] or "", add_special_tokens=False).ids) + 1) for d in rows())
        length = defaultdict(int)
        for r in got:
            length[r.doc_id, r.doc_tokens] += r.length
        assert length == {k: k[1] * n for k, n in sizes.items()}
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        assert sorted(sequences) == list(range(len(sequences)))
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 256
    assert packing.pack_documents(spark, empty(spark), tokens.word_tokenizer_path()).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        capacity = rng.randrange(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
        chosen = packing.fill(counts, capacity)
        assert sum(k * n for k, n in chosen.items()) == max(sums) and all(n <= counts[k] for k, n in chosen.items())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_plain_python(spark, rule):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, _ = token_counts.byte_encoder(path)
    rng = random.Random(8)
    some = [(i, "".join(rng.choice(["a", "b c", "\n", "\n\n", " ", "é", "日", "x\n y", "the end"]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "", None]), rng.choice(["s", "s\n", None]), 1) for i in range(60)]
    some += rows()
    crossed = 0
    got = token_counts.count_sections(frame(spark, some), path, rule=rule).collect()
    want = []
    for d in some:
        fields = [(x or "").encode() for x in (d[3], d[2], d[1])]
        body = b"\n".join(fields)
        bounds, names = [0, len(fields[0]) + 1, len(fields[0]) + len(fields[1]) + 2], [("source", 0), ("lang", 0), ("text", 0)]
        for i in range(bounds[2], len(body)):
            if body[i : i + 1] == b"\n" and i + 1 < len(body):
                bounds.append(i + 1)
                names.append(("text", len(names) - 2))
        count, cross = [0] * len(bounds), [0] * len(bounds)
        at, ids = 0, enc.encode_ordinary(body.decode())
        for t in ids:
            size = len(enc.decode_single_token_bytes(t))
            owner = [max(k for k, b in enumerate(bounds) if b <= p) for p in range(at, at + size)]
            one = owner[0] if rule == "start" else owner[-1] if rule == "end" else max(sorted(set(owner)), key=lambda k: (owner.count(k), -k))
            count[one] += 1
            cross[one] += len(set(owner)) > 1
            at += size
        crossed += sum(cross)
        want.append((d[0], len(ids), tuple((n, k, c, x) for (n, k), c, x in zip(names, count, cross, strict=True))))
    assert crossed and Counter((r.doc_id, r.n_tokens, tuple((s.field, s.line, s.n_tokens, s.n_crossing) for s in r.sections)) for r in got) == Counter(want)
    assert token_counts.count_sections(empty(spark), path).count() == 0
    assert token_counts.count_sections(awkward(spark), path).count() == len(rows())
