import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from stratalog.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, word for word from its definition."""

    def __init__(self, texts, order):
        self.order, self.count = order, {order: Counter()}
        for t in texts:
            b = b"\0" * (order - 1) + t.encode()
            self.count[order].update(b[i : i + order] for i in range(len(b) - order + 1))
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])  # distinct left extensions
        self.d, self.follow = {}, {}
        for n, c in self.count.items():
            cc = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
            y = cc[0] / (cc[0] + 2 * cc[1])
            self.d[n] = [0.0] + [min(max(i - (i + 1) * y * cc[i] / cc[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
            self.follow[n] = defaultdict(list)
            for g, v in c.items():
                self.follow[n][g[:-1]].append(v)

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / 256
        after = self.follow[n].get(gram[:-1])
        if not after:
            return lower
        d, c = self.d[n], self.count[n].get(gram, 0)
        return (c - d[min(c, 3)]) / sum(after) + sum(d[min(v, 3)] for v in after) / sum(after) * lower

    def nats(self, text):
        b = b"\0" * (self.order - 1) + text.encode()
        return [-math.log(self.p(b[i : i + self.order])) for i in range(len(b) - self.order + 1)]


def passes(model, limits, text, quantile=0.995):
    """Whether a model and its limits find a text usual: its score for its length, and its worst word."""
    nats, raw = model.nats(text) if text else [], (text or "").encode()
    if not nats:
        return True
    worst, words, at = -math.inf, 0, 0
    while at < len(raw):
        end = at + 1
        while end < len(raw) and not (raw[end - 1] in b" \t\n" and raw[end] not in b" \t\n"):
            end += 1
        for a in range(at, end, quality.WORD):
            words += 1
            worst = max(worst, sum(x - limits.centre for x in nats[a : min(a + quality.WORD, end)]))
        at = end
    chance = words * quality.TAIL * math.exp((limits.tail_from - worst) / limits.tail_scale)
    room = limits.times * limits.spread * math.sqrt(limits.variance / len(raw))
    return abs(np.mean(nats) - limits.centre) <= room and chance >= 1 - quantile


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    parts = {"en": ["the", "er", "on", "an", "re"], "de": ["sch", "ung", "ein", "ß"]}
    text = lambda lang, k: " ".join("".join(rng.choices(parts[lang], k=rng.choice([1, 2, 3]))) for _ in range(k))
    rows = [(i, text("en", 40), "en", "s", 1) for i in range(n)] + [(1000 + i, text("de", 40), "de", "s", 1) for i in range(n)]
    junk = [(3000 + i, " ".join(rng.choices(["Zq#x", "%%kv", "JJJJ!"], k=12)), "en", "s", 1) for i in range(3)]
    mixed = [(4000 + i, text("en", 30) + " " + text("de", 30), "en", "s", 1) for i in range(3)]
    return rows + junk + mixed + [(2000, "Zq#x über 日本", "xx", "s", 1), (2001, None, None, None, None), (2002, "", "en", "s", 0)]


@pytest.mark.parametrize("entries", [16_000, 40])
def test_perplexity_thresholds_and_decisions_against_plain_python(spark, entries, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ENTRIES", entries)  # several shards a language
    rows = corpus()
    trusted = [r[0] for r in rows if r[0] < 2000]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(5, 1, 0)], LABELS)
    docs = frame(spark, rows)
    held = {r.text for r in quality.trusted_documents(docs, labels, held_out=True).collect()}
    used = [r for r in rows if r[0] < 2000 and r[1] not in held]
    models = {k: PlainKneserNey([r[1] for r in used if r[2] == k], quality.ORDER) for k in ("en", "de")}
    models["*"] = PlainKneserNey([r[1] for r in used], quality.ORDER)
    got = {r.doc_id: r for r in quality.classify(spark, docs, labels).collect()}
    for doc_id, text, lang, *_ in rows:
        nats = models.get(lang, models["*"]).nats(text) if text else []
        assert got[doc_id]._lm_score == pytest.approx(np.mean(nats) if nats else 0.0, abs=1e-5)
        assert got[doc_id]._lm_symbols == len(nats)
    held_rows = [r for r in rows if r[1] in held and r[1]]
    for lang in ("en", "de"):
        own = sorted((np.mean(models[lang].nats(r[1])), np.var(models[lang].nats(r[1]))) for r in held_rows if r[2] == lang)
        n = len(own)
        assert n >= quality.MIN_HELD_OUT
        centre, variance = own[(n + 1) // 2 - 1][0], sorted(v for _, v in own)[(n + 1) // 2 - 1]
        off = sorted(abs(s - centre) / math.sqrt(variance / len(r[1].encode())) for r in held_rows if r[2] == lang for s in [np.mean(models[lang].nats(r[1]))])
        spread = max(1.0, 1.4826 * off[(n + 1) // 2 - 1])
        for r in rows[: 2 * 60]:
            if r[2] == lang:
                room = quality._times(0.995, n) * spread * math.sqrt(variance / len(r[1].encode()))
                assert got[r[0]]._lm_threshold == pytest.approx(centre + room, abs=1e-4)
    held_frame, enough = quality.held_out(docs, labels)
    found = quality.limits(held_frame, quality.fit(spark, docs, labels, enough), 0.995)
    decided = [passes(models[lang if lang in models else "*"], found.get(lang, found["*"]), text) or passes(models["*"], found["*"], text) for _, text, lang, *_ in rows]
    assert decided == [got[r[0]]._lm_keep for r in rows] and not all(decided)
    assert got[2001]._lm_keep and got[2002]._lm_keep


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    keys, n = np.unique(quality.keys_of(data, np.array([0, 4000])), return_counts=True)
    tables = quality.lower_orders(keys, n)
    slots = [10 * o + i for o in tables for i in (1, 2, 3, 4)]
    values = [int((tables[o][1] == i).sum()) for o in tables for i in (1, 2, 3, 4)]
    pairs, c = np.unique(tables[3][0] & 0xFFFF, return_counts=True)
    model = quality.ShardModel(np.concatenate([slots, 1000 + pairs]), np.concatenate([values, c]), keys, n)
    for context in (0x616263, 0x616161, 0x7A7A61, 0x7A7A7A):
        assert model.probability((context << 8) + np.arange(256)).sum() == pytest.approx(1)


def test_clean_text_stays_and_junk_goes(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choices(["lorem", "ipsum", "dolor", "amet"], k=40)), "en", "s", 1) for i in range(80)]
    bad = [(100 + i, " ".join("".join(rng.choices("ZXQ#$%", k=7)) for _ in range(40)), "en", "s", 1) for i in range(5)]
    empty = [(200, None, None, None, None), (201, "", "xx", "s", 0)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0)], LABELS)
    got = {r.doc_id: r._lm_keep for r in quality.classify(spark, frame(spark, good + bad + empty), labels).collect()}
    assert all(got[d[0]] for d in good + empty) and not any(got[d[0]] for d in bad)
    assert quality.keep_good(spark, frame(spark, good), labels.limit(0)).count() == len(good)


def test_one_bad_word_and_repeated_common_words_go(spark):
    rng = random.Random(6)
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    text = lambda n: " ".join("".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3]))) for _ in range(n))
    good = [(i, text(rng.choice([60, 200, 400])), "en", "s", 1) for i in range(200)]
    sparse = [(1000 + i, f"{text(150)} worthless clown {text(150)}", "en", "s", 1) for i in range(6)]
    common = [(2000, "the " * 400, "en", "s", 1)]
    short = [(3000, "Zq#x Kv%j", "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], LABELS)
    got = {r.doc_id: r._lm_keep for r in quality.classify(spark, frame(spark, good + sparse + common + short), labels).collect()}
    assert not any(got[d[0]] for d in sparse + common + short)
    assert sum(not got[d[0]] for d in good) <= 6


def test_rare_languages_take_the_pooled_model_and_its_limits(spark):
    rng = random.Random(7)
    text = lambda parts, n: " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))
    a, b = ["the", "er", "on", "an", "re"], ["sch", "ung", "ein", "lich"]
    rows = [(i, text(a, 80), "en", "s", 1) for i in range(100)] + [(200 + i, text(b, 80), "de", "s", 1) for i in range(8)] + [(300, text(b, 80), "xx", "s", 1)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:-1]], LABELS)
    docs = frame(spark, rows)
    held, enough = quality.held_out(docs, labels)
    assert enough == {"en"}
    found = quality.limits(held, quality.fit(spark, docs, labels, enough), 0.995)
    assert set(found) == {"en", quality.POOLED}
    used = {r.text for r in quality.trusted_documents(docs, labels, held_out=False).collect()}
    pooled = PlainKneserNey([r[1] for r in rows if r[1] in used], quality.ORDER)
    got = {r.doc_id: r._lm_score for r in quality.classify(spark, docs, labels).collect()}
    assert all(got[r[0]] == pytest.approx(np.mean(pooled.nats(r[1])), abs=1e-5) for r in rows if r[0] >= 200)
    assert min(abs(found[quality.POOLED].centre - np.mean(pooled.nats(r[1]))) for r in rows if r[1] not in used) < 1e-5


def test_edges(spark):
    wide = SCHEMA + ", _lm_lang string, _lm_score string, block string, `a.b` int, model string"
    rows = [(*r, "l", "s", "b", 1, "m") for r in corpus(8)] + [(7, "x " * 400_000, "en", "s", 1, "l", "s", "b", 1, "m"), (None, "the er", "en", "s", 1, "l", "s", "b", 1, "m")]
    rows += [rows[3], (4, "another text with the id of four", "en", "s", 1, "l", "s", "b", 1, "m")]
    docs = spark.createDataFrame(rows, wide)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 2000 and r[0] != 7] + [(None, 1, 0), (3, None, None)], LABELS)
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
    out = {(r.doc_id, r.text) for r in kept.collect()}
    assert (2001, None) in out and (7, "x " * 400_000) not in out
    assert all(r._lm_lang == "l" and r._lm_score == "s" and r["a.b"] == 1 for r in kept.collect())
    judged = quality.classify(spark, docs, labels)
    assert judged.count() == len(rows) and judged.schema["_lm_score"].dataType.simpleString() == "double"
    none = frame(spark, [])
    assert quality.classify(spark, none, labels).count() == 0
    assert quality.keep_good(spark, docs, labels.limit(0)).count() == len(rows)
