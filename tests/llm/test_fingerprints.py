import hashlib
import re
import struct
from collections import Counter

import xxhash
from cases import awkward, empty, frame, rows
from stratalog.llm import fingerprints as f


def chained(*values):
    """Hash of several values as Spark chains it, signed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def anchors(text):
    w = re.findall(rf"[{f.UNSPACED}]|[^ \t-\r{f.UNSPACED}]+", text or "")
    inner = [chained(w[i], w[i + 1]) for i in range(len(w) - 1)]
    short = lambda h: (h % (1 << 64)) >> 24
    out = []
    for i in range(len(w) - f.K + 1):
        own = inner[i : i + f.K - f.S + 1]
        if min(own[0], own[-1]) <= min(own[1:-1]):
            out.append((i, short(chained(own[0], own[2], own[4]))))
    return out or ([(0, short(chained(" ".join(w))))] if w else [])


def shown(text):
    return ",".join(f"{h:010x}:{i:x}" for i, h in anchors(text))


def like(a, b):
    x, y = {h for _, h in anchors(a)}, {h for _, h in anchors(b)}
    return len(x & y) / len(x | y) if x or y else 1.0


def test_against_plain_python(spark):
    data = sorted(rows(), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "")))
    for df in (frame(spark), awkward(spark)):
        got = f.fingerprint_edits(df).collect()
        want = Counter()
        for i, d in enumerate(data):
            text, after = d[1] or "", data[(i + 1) % len(data)][1] or ""
            q = len(text) // 4
            edited = text[: len(text) - q] + after[:q]
            want[d[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(text), shown(edited), round(like(text, edited), 9), round(like(text, after), 9)] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
        published = lambda text: {a.split(":")[0] for a in text.split(",") if a}
        for r in got:  # likeness is that of what is published
            a, b = published(r.fingerprint), published(r.edited_fingerprint)
            assert abs(r.near_edited - (len(a & b) / len(a | b) if a or b else 1.0)) < 1e-9
    assert f.fingerprint_edits(empty(spark)).count() == 0


def test_positions_match_where_passages_stand(spark):
    a = " ".join(f"w{i}" for i in range(80))
    b = " ".join([*(f"x{i}" for i in range(7)), *(f"w{i}" for i in range(20, 60))])
    both = f.with_anchors(f.with_anchors(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    got = both.select(f.matched_positions("x", "y").alias("m"), "x", "y").first()
    assert [(p.position, p.anchor) for p in got.x] == anchors(a) and [(p.position, p.anchor) for p in got.y] == anchors(b)
    assert len(got.m) > 5 and {p.position_b - p.position_a for p in got.m} == {-13}


def test_ranges_by_levels(spark):
    import bisect

    for n in (0, 1, 63, 64, 65, 4096, 4097, 9000):
        bounds = [3 * i + 1 for i in range(n)]
        df = spark.createDataFrame([(k,) for k in [None, -5, *range(0, 3 * n + 9, 7)]], "doc_id long")
        for r in f.with_range(df, "doc_id", bounds, "x").collect():
            assert r.x == (0 if r.doc_id is None else bisect.bisect_right(bounds, r.doc_id))


def test_next_across_many_ranges(spark):
    data = [(i * 2, f"t{i}") for i in range(500)] + [(None, "n")] + [(10, "again")]
    got = f.with_next(spark.createDataFrame(data, "doc_id long, text string"), ["text"], len(data), per_part=3).collect()
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = Counter((d[0], d[1], order[(i + 1) % len(order)][1]) for i, d in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want
