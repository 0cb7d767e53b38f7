from collections import Counter

import pytest
from cases import awkward, empty, frame, rows
from stratalog.llm import decontamination

ITEMS = "item_id long, text string"


def items():
    passage = rows()[9][1].split()
    return [(1, " ".join(passage[5:17])), (2, "A b"), (2, "É 日本 x"), (3, ""), (4, None), (None, "a b"), (5, "V1 v2"), (10, " ".join(passage[20:29]))]


def plain(text, window=10):
    w = decontamination.fold((text or "").encode())
    hit, found = set(), set()
    for item, t in items():
        iw = decontamination.fold((t or "").encode())
        m = min(window, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m and item is not None else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_every_row_is_judged_by_itself(spark, block_bytes):
    bench = spark.createDataFrame(items(), ITEMS)
    got = decontamination.contaminated_spans(spark, frame(spark), bench, block_bytes=block_bytes).collect()
    shown = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), ",".join(r["items"])) for r in got)
    assert shown == Counter((d[0], *plain(d[1])) for d in rows())
    df = awkward(spark)
    clean = decontamination.remove_contaminated(spark, df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((d[0], d[1]) for d in rows() if not plain(d[1])[1])


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), ITEMS)
    assert decontamination.contaminated_spans(spark, empty(spark), bench).count() == 0
    got = decontamination.contaminated_spans(spark, frame(spark), bench.limit(0)).collect()
    assert len(got) == len(rows()) and not any(r.spans or r["items"] for r in got)
    assert decontamination.remove_contaminated(spark, empty(spark), bench).count() == 0


def test_shifts_skip_and_buckets_compare():
    m = decontamination.WuManber([tuple(b"a b c d e f g".split()), tuple(b"a b c d e f h".split())])
    text = b"a b c d e f g x a b c d e f h x c d e f g".split()
    assert [(s, i) for s, i in m.search(text)] == [(0, 0), (8, 1)]
    assert m.shift[b"e f g"] == 0 and m.shift[b"a b c"] == 4 and len(m.bucket) == 2
