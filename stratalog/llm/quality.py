"""Quality classifier: interpolated modified Kneser-Ney n-gram model over bytes, one for each language.

An n-gram is ORDER bytes of a document's UTF-8 text (zero bytes stand before its first), packed into an exact integer
key. Counts come from all trusted text (labels with quality 1 and toxic 0), summed in the tasks and then by key; lower
orders count distinct left extensions. Discounts D1, D2, D3+ come from the counts of counts of each language and order.

Sharding: n-grams are dealt by (language, hash of the two bytes before the last). The context, the shorter n-grams down
to three bytes and their contexts all have those two bytes, so a shard holds whole chains of orders. Only the two-byte
table (65,536 numbers a language at most) and the discounts are shared by a language's shards.

Scoring is a sharded count join. Documents are taken in blocks (neighbouring rows of a file). Each block asks for its
distinct n-grams, the requests are dealt to the shards (a shard's requests over several tasks, with a copy of the shard
in each), meet the shard's counts in sorted order, and the interpolated probabilities go back by block into one file of
the shared folder. The documents are then read again, and each block's file gives its documents' nats. Neither model
nor answers come to the driver, nothing is broadcast, and texts are not shuffled.

A document's score is its cross-entropy in nats a byte (perplexity = exp). A fifth of the trusted documents (by
hash) is kept out of the counts, and each language's limits come from them: median and spread of the score in
units of a document's sampling error, and the tail of the excess (nats above the median score) of single words, as
an exponential law past its upper TAIL. A model finds a document wanting if its score is too high or too low for its
length (one two-sided test), or if its worst word is one that a clean document of as many words holds with a chance
below 1 - `quantile`. A document is rejected if both its language's model and the model of all trusted text together find
it wanting, each by limits taken under itself: clean text of several languages, or under a wrong label, is not its
language's but is usual to the second, while junk and toxic words are usual to neither. Languages with fewer than
MIN_HELD_OUT held-out documents have the second model only.

Null or empty texts score 0 and stay; so does everything where there is no trusted text. Very long texts are scored
whole. Repeated rows and repeated doc_ids are scored row by row; a trusted doc_id's rows all count. A null doc_id is
labelled by nothing. Ties at a limit stay. A null language is the language "".
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, given_names, open_folder, own_names, scratch_path, shuffle_width, some_rows, stored, text_bytes, with_blocks, write_whole
from .words import NOT_SPACE, mix

ORDER = 4
#: Stands for all languages together.
POOLED = "*"
#: Trusted ids that are broadcast at most (16 bytes each); above it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Held-out documents below which a language takes the model and limits of all.
MIN_HELD_OUT = 5
#: Languages with a model of their own; more is an error (their limits are literals of a plan).
MAX_LANGUAGES = 1000
#: Bytes of a word that are judged as one.
WORD = 24
#: Share of words whose excess is taken for the tail, and the step in nats at which it is counted.
TAIL, BIN = 0.01, 0.05
#: n-grams that a shard has, about, and n-grams in a request at most.
SHARD_ENTRIES, REQUEST_KEYS = 16_000, 32_768
#: Blocks whose requests one task answers for a shard, about.
BLOCKS_A_TASK = 64


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram ending at each byte; zeros stand before a document's first byte."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for j in range(1, min(order, len(data))):
        before = data[:-j].astype(np.int64) << (8 * j)
        before[place[j:] < j] = 0
        out[j:] |= before
    return out


def chain_of(keys: np.ndarray) -> np.ndarray:
    """The two bytes before the last, mixed."""
    return mix(((keys >> 8) & 0xFFFF).astype(np.uint64))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (chain_of(keys) % np.uint64(shards)).astype(np.int32)


def trusted_documents(docs: DataFrame, labels: DataFrame, held_out: bool) -> DataFrame:
    """lang, text of the trusted documents that are kept out of the counts, or of the others; counted once however often labelled."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("label_id")).distinct()
    fifth = F.pmod(F.xxhash64("label_id"), F.lit(5)) == 0
    good = good.where(fifth if held_out else ~fifth)
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.join(good, F.col("doc_id") == F.col("label_id"), "left_semi")


def _merged(k: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key."""
    keys, at = np.unique(np.concatenate(k), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(n), minlength=len(keys)).astype(np.int64)


def count_ngrams(docs: DataFrame, own: frozenset[str]) -> DataFrame:
    """lang, key, n of the n-grams: each of the `own` languages, and all together under POOLED."""

    def run(batches):
        have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array([x if x in own else POOLED for x in batch.column("lang").to_pylist()], dtype=object)
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                keys = keys_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                of = np.repeat(langs[a:b], np.diff(offs[a : b + 1]))
                for lang in {*langs[a:b], POOLED}:
                    k, n = np.unique(keys if lang == POOLED else keys[of == lang], return_counts=True)
                    have[lang] = _merged([have[lang][0], k], [have[lang][1], n]) if lang in have else (k, n)
        for lang, (k, n) in have.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "key": pa.array(k, pa.int64()), "n": pa.array(n, pa.int64())})

    rows = docs.select("lang", text_bytes().alias("body")).mapInArrow(run, "lang string, key long, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


#: What meets in a shard: statistics (kind 0), counts (1) and requests (2), with two packed arrays each.
ROW = "lang string, shard int, salt int, kind int, block long, a binary, b binary"


def _row(lang: str, shard: int, kind: int, block: int | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    values = (lang, shard, 0, kind, block, a.tobytes(), b.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["lang", "shard", "salt", "kind", "block", "a", "b"])


def packed_shards(counts: DataFrame, shards: int, width: int) -> DataFrame:
    """One row of kind 1 for each language and shard: its n-grams, ascending, and their counts."""

    def deal(batches):
        for batch in batches:
            shard = shard_of(batch.column("key").to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["lang", "key", "n", "shard"])

    def pack(batches):
        now, k, n = None, [], []
        for batch in batches:
            langs, shard = batch.column("lang").to_pylist(), batch.column("shard").to_numpy()
            key, count = batch.column("key").to_numpy(), batch.column("n").to_numpy()
            a = 0
            while a < len(key):
                b = a
                while b < len(key) and (langs[b], shard[b]) == (langs[a], shard[a]):
                    b += 1
                if now is not None and now != (langs[a], int(shard[a])):
                    yield _row(*now, 1, None, np.concatenate(k), np.concatenate(n))
                    k, n = [], []
                now = langs[a], int(shard[a])
                k.append(key[a:b].copy())
                n.append(count[a:b].copy())
                a = b
        if now is not None:
            yield _row(*now, 1, None, np.concatenate(k), np.concatenate(n))

    dealt = counts.mapInArrow(deal, "lang string, key long, n long, shard int")
    grouped = dealt.repartition(width, "lang", "shard").sortWithinPartitions("lang", "shard", "key")
    return grouped.mapInArrow(pack, ROW)


def lower_orders(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of orders ORDER to 3 of a shard: each lower count is the number of distinct left extensions."""
    out = {ORDER: (keys, n)}
    for order in range(ORDER - 1, 2, -1):
        out[order] = np.unique(out[order + 1][0] & ((1 << (8 * order)) - 1), return_counts=True)
    return out


def language_statistics(shards: DataFrame) -> DataFrame:
    """One row of kind 0 for each language: counts of counts (slots 10 * order + 1 to 4), and two-byte counts (1000 + pair)."""

    def run(batches):
        for batch in batches:
            for lang, a, b in zip(batch.column("lang").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                tables = lower_orders(np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64))
                slots = [10 * o + i for o in tables for i in (1, 2, 3, 4)]
                values = [int((tables[o][1] == i).sum()) for o in tables for i in (1, 2, 3, 4)]
                pairs, n = np.unique(tables[3][0] & 0xFFFF, return_counts=True)
                at = np.concatenate([slots, 1000 + pairs])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "slot": pa.array(at, pa.int32()), "value": pa.array(np.concatenate([values, n]), pa.int64())})

    def pack(batches):
        have: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for lang, slot, value in zip(*(batch.column(c).to_pylist() for c in ("lang", "slot", "value")), strict=True):
                s, v = have.setdefault(lang, ([], []))
                s.append(slot)
                v.append(value)
        for lang, (s, v) in have.items():
            yield _row(lang, 0, 0, None, np.array(s, np.int32), np.array(v, np.int64))

    summed = shards.select("lang", "a", "b").mapInArrow(run, "lang string, slot int, value long").groupBy("lang", "slot").agg(F.sum("value").alias("value"))
    return summed.repartition("lang").mapInArrow(pack, ROW)  # 65,548 rows a language at most


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney, kept inside (0, i) where counts of counts are too thin."""
    n = [max(x, 1) for x in (n1, n2, n3, n4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))])


class ShardModel:
    """Interpolated probabilities of one language's n-grams of one shard."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, keys: np.ndarray, n: np.ndarray):
        of = dict(zip(slots[slots < 1000].tolist(), values[slots < 1000].tolist(), strict=True))
        pairs = np.zeros(65536, np.int64)
        pairs[slots[slots >= 1000] - 1000] = values[slots >= 1000]
        pairs = pairs.reshape(256, 256)
        single = (pairs > 0).sum(0)
        self._low = self._dense(pairs, self._dense(single[None, :], np.full((1, 256), 1 / 256))).ravel()
        self._orders = []
        for order, (k, c) in sorted(lower_orders(keys, n).items()):
            d = discounts(*(of.get(10 * order + i, 0) for i in (1, 2, 3, 4)))[np.minimum(c, 3)]
            contexts, at = np.unique(k >> 8, return_inverse=True)
            total = np.bincount(at, weights=c, minlength=len(contexts))
            gamma = np.bincount(at, weights=d, minlength=len(contexts)) / np.maximum(total, 1)
            lower = self.probability(k, order - 1)
            self._orders.append((order, k, (c - d) / total[at] + gamma[at] * lower, contexts, gamma))

    @staticmethod
    def _dense(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = discounts(*((counts == i).sum() for i in (1, 2, 3, 4)))[np.minimum(counts, 3)]
        total = counts.sum(1, keepdims=True)
        gamma = np.where(total > 0, d.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
        return np.where(total > 0, (counts - d) / np.maximum(total, 1), 0.0) + gamma * lower

    def probability(self, keys: np.ndarray, most: int = ORDER) -> np.ndarray:
        """Of each key's last byte after the bytes before it, from `most` bytes of it."""
        p = self._low[keys & 0xFFFF]
        for order, k, own, contexts, gamma in self._orders:
            if order > most or not len(k):
                continue
            q = keys & ((1 << (8 * order)) - 1)
            at = np.minimum(np.searchsorted(contexts, q >> 8), len(contexts) - 1)
            p = np.where(contexts[at] == q >> 8, gamma[at] * p, p)
            at = np.minimum(np.searchsorted(k, q), len(k) - 1)
            p = np.where(k[at] == q, own[at], p)
        return p


@dataclass(frozen=True)
class Model:
    """Stored tables of the shared folder: `shards` and `stats` as above."""

    shards: DataFrame
    stats: DataFrame
    count: int
    languages: frozenset[str]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, languages: frozenset[str]) -> Model | None:
    """The model of the `languages` and of all together; None where there is no trusted text."""
    width = shuffle_width(spark)
    counts = stored(count_ngrams(trusted_documents(docs, labels, held_out=False), languages), "quality-counts")
    most = counts.groupBy("lang").count().agg(F.max("count").alias("m"), F.collect_set("lang").alias("have")).first()
    if not most["m"]:
        return None
    shards = max(1, -(-most["m"] // SHARD_ENTRIES))
    table = stored(packed_shards(counts, shards, width), "quality-shards")
    return Model(table, stored(language_statistics(table), "quality-statistics"), shards, languages & frozenset(most["have"]))


def _pieces(batch: pa.RecordBatch, text: str):
    """(rows, block, language, bytes, offsets) of chunks of one block and language."""
    data, offs = binary_parts(batch.column(text))
    blocks = batch.column("block").to_numpy()
    langs, code = np.unique(np.array(batch.column("model").to_pylist(), dtype=str), return_inverse=True)
    names, at = np.unique(blocks, return_inverse=True)
    group = at * len(langs) + code
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        flat, cut = some_rows(data, offs, mine)
        for a, b in chunks(cut):
            yield mine[a:b], int(names[g // len(langs)]), str(langs[g % len(langs)]), flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a]


def requests(docs: DataFrame, text: str, shards: int) -> DataFrame:
    """Rows of kind 2: the distinct n-grams of each block, for its languages and for all together, by shard."""

    def run(batches):
        have: dict[tuple[int, str], list[np.ndarray]] = {}

        def ask(key):
            keys = np.unique(np.concatenate(have.pop(key)))
            shard = shard_of(keys, shards)
            for s in np.unique(shard):
                mine = keys[shard == s]
                for a in range(0, len(mine), REQUEST_KEYS):
                    yield _row(key[1], int(s), 2, key[0], mine[a : a + REQUEST_KEYS], mine[:0])

        for batch in batches:
            seen = set()
            for _, block, lang, data, offs in _pieces(batch, text):
                keys = np.unique(keys_of(data, offs))
                for model in {lang, POOLED}:
                    own = have.setdefault((block, model), [])
                    own.append(keys)
                    if sum(map(len, own)) > 2_000_000:
                        own[:] = [np.unique(np.concatenate(own))]
                seen.add(block)
            for key in [k for k in have if k[0] not in seen]:
                yield from ask(key)
        for key in list(have):
            yield from ask(key)

    return docs.select("block", "model", text).mapInArrow(run, ROW)


def answers(model: Model, docs: DataFrame, text: str, rows: int) -> str:
    """The folder with one file a block: for each language, its documents' distinct n-grams and their nats."""
    spark = docs.sparkSession
    width, folder = shuffle_width(spark), scratch_path(spark, "quality-answers")
    salts = max(1, -(-rows // (16_384 * BLOCKS_A_TASK)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    columns = ["lang", "shard", "salt", "kind", "block", "a", "b"]
    known = model.shards.withColumn("salt", spread).select(*columns)
    about = model.stats.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(model.count - 1)))).withColumn("salt", spread).select(*columns)
    asked = requests(docs, text, model.count).withColumn("salt", F.pmod("block", F.lit(salts)).cast("int")).select(*columns)

    def answer(batches):
        at, stats, shard = None, None, None
        for batch in batches:
            for lang, s, salt, kind, block, a, b in zip(*(batch.column(c) for c in columns), strict=True):
                kind = kind.as_py()
                if kind == 0:
                    at, shard = (lang.as_py(), s.as_py(), salt.as_py()), None
                    stats = np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.int64)
                    counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                elif kind == 1:
                    counts = np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)
                else:
                    if (lang.as_py(), s.as_py(), salt.as_py()) != at:
                        raise RuntimeError("a request without its language's statistics")
                    if shard is None:
                        shard = ShardModel(*stats, *counts)
                    nats = -np.log(shard.probability(np.frombuffer(a.as_py(), np.int64))).astype(np.float32)
                    yield pa.RecordBatch.from_pydict({"block": [block.as_py()], "lang": [lang.as_py()], "a": pa.array([a.as_py()], pa.binary()), "b": pa.array([nats.tobytes()], pa.binary())})

    def write(batches):
        def save(block, have):
            def put(out):
                for lang, parts in sorted(have.items()):
                    k, at = np.unique(np.concatenate([np.frombuffer(a, np.int64) for a, _ in parts]), return_index=True)
                    v = np.concatenate([np.frombuffer(b, np.float32) for _, b in parts])[at]
                    name = lang.encode()
                    out.write(np.array([len(name), len(k)], "<i8").tobytes() + name + k.tobytes() + v.tobytes())

            write_whole(folder, f"{block}.nats", put)

        now, have, done = None, {}, []
        for batch in batches:
            for block, lang, a, b in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "a", "b")), strict=True):
                if block != now and have:
                    save(now, have)
                    done.append(now)
                    have = {}
                now = block
                have.setdefault(lang, []).append((a, b))
        if have:
            save(now, have)
            done.append(now)
        yield pa.RecordBatch.from_pydict({"block": pa.array(done, pa.int64())})

    met = about.unionByName(known).unionByName(asked).repartition(width, "lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", "kind")
    back = met.mapInArrow(answer, "block long, lang string, a binary, b binary").repartition(width, "block").sortWithinPartitions("block")
    stored(back.mapInArrow(write, "block long"), "quality-answered")
    return folder


class Answers:
    """The nats of the blocks that are being read; one block's file is held at a time."""

    def __init__(self, folder: str):
        self._folder, self._block, self._of = folder, None, {}

    def nats(self, block: int, lang: str, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Nats of each byte under the language's model and under that of all together."""
        if not len(data):
            return [np.zeros(0)] * 2
        if block != self._block:
            store, path = open_folder(self._folder)
            with store.open_input_stream(f"{path}/{block}.nats") as f:
                raw = f.read()
            self._block, self._of, at = block, {}, 0
            while at < len(raw):
                name, n = np.frombuffer(raw, "<i8", 2, at).tolist()
                at += 16
                own, at = raw[at : at + name].decode(), at + name
                self._of[own] = np.frombuffer(raw[at : at + 8 * n], np.int64), np.frombuffer(raw[at + 8 * n : at + 12 * n], np.float32)
                at += 12 * n
        keys, back = np.unique(keys_of(data, offsets), return_inverse=True)
        out = []
        for model in dict.fromkeys((lang, POOLED)):
            known, values = self._of[model]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            if not np.array_equal(known[at], keys):
                raise RuntimeError("the documents changed between two passes")
            out.append(values[at].astype(np.float64)[back])
        return [out[0], out[-1]]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, each with the white space after it; a longer word is cut into pieces of WORD bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = ~NOT_SPACE[data]
    begins = np.concatenate([[True], space[:-1] & ~space[1:]])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.arange(len(data))
    return np.flatnonzero((at - np.maximum.accumulate(np.where(begins, at, 0))) % WORD == 0)


STATS = {"_lm_score": "double", "_lm_var": "double", "_lm_symbols": "long", "_lm_words": "long", "_lm_worst": "double"}
#: The same under the model of all trusted text together.
POOLED_STATS = {"_lm_pooled_score": "double", "_lm_pooled_var": "double", "_lm_pooled_worst": "double"}
EVERY = STATS | POOLED_STATS


def score(lp: np.ndarray, data: np.ndarray, offsets: np.ndarray, centre: float) -> tuple[np.ndarray, ...]:
    """Of each document: cross-entropy, variance of a byte's nats, bytes, words, and the worst word's nats above `centre` a byte."""
    n = np.diff(offsets)
    s1, s2 = (np.concatenate([[0], np.cumsum(x)]) for x in (lp, lp * lp))
    m = np.maximum(n, 1)
    mean = (s1[offsets[1:]] - s1[offsets[:-1]]) / m
    var = np.maximum((s2[offsets[1:]] - s2[offsets[:-1]]) / m - mean * mean, 0)
    starts = word_starts(data, offsets)
    words, worst = np.zeros(len(n), np.int64), np.zeros(len(n))
    if len(starts):
        of = np.searchsorted(offsets, starts, side="right") - 1
        full, first, words_of = np.unique(of, return_index=True, return_counts=True)
        words[full] = words_of
        worst[full] = np.maximum.reduceat(np.add.reduceat(lp - centre, starts), first)
    return mean, var, n, words, worst


def _scored(docs: DataFrame, text: str, folder: str, centre: dict[str, float]) -> DataFrame:
    """`docs` (with block and model), STATS and POOLED_STATS."""
    kept = docs.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + ", ".join(f"{k} {t}" for k, t in EVERY.items())

    def run(batches):
        known = Answers(folder)
        for batch in batches:
            out = [np.zeros(batch.num_rows, np.int64 if t == "long" else np.float64) for t in EVERY.values()]
            for rows, block, lang, data, offs in _pieces(batch, text):
                own, pooled = known.nats(block, lang, data, offs)
                mine = score(own, data, offs, centre.get(lang, 0.0))
                other = mine if lang == POOLED else score(pooled, data, offs, centre.get(POOLED, 0.0))
                for column, values in zip(out, (*mine, other[0], other[1], other[4]), strict=True):
                    column[rows] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*kept, *EVERY])

    return docs.mapInArrow(run, schema)


def _word_histogram(docs: DataFrame, text: str, folder: str, centre: dict[str, float]) -> DataFrame:
    """model, bin, n: the words by their nats above `centre` in steps of BIN."""

    def run(batches):
        known = Answers(folder)
        for batch in batches:
            for _, block, lang, data, offs in _pieces(batch, text):
                starts = word_starts(data, offs)
                if not len(starts):
                    continue
                for model, lp in dict(zip((lang, POOLED), known.nats(block, lang, data, offs), strict=True)).items():
                    excess = np.add.reduceat(lp - centre[model], starts)
                    bins, n = np.unique(np.floor(excess / BIN).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"model": pa.array([model] * len(bins), pa.string()), "bin": pa.array(bins), "n": pa.array(n, pa.int64())})

    return docs.select("block", "model", text).mapInArrow(run, "model string, bin long, n long").groupBy("model", "bin").agg(F.sum("n").alias("n"))


@dataclass
class Limits:
    """What a language's clean documents score: see the module's text."""

    centre: float
    variance: float
    spread: float
    times: float
    tail_from: float
    tail_scale: float


def _times(quantile: float, n: int) -> float:
    """Student's quantile (Cornish-Fisher) of a two-sided test of one more document against n others."""
    z, v = NormalDist().inv_cdf((1 + quantile) / 2), max(n - 1, 1)
    return (z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)) * (1 + 1 / n) ** 0.5


def _tail(bins: list[tuple[int, int]]) -> tuple[float, float]:
    """Where the upper TAIL of the words begins, and the scale of their excess past it, from the median so that a few outliers don't set it."""
    bins = sorted(bins)
    total = sum(n for _, n in bins)

    def above(share: float) -> float:
        left = share * total
        for at, n in reversed(bins):
            left -= n
            if left < 0:
                return (at + 1) * BIN
        return bins[0][0] * BIN

    start = above(TAIL)
    # a model that is right gives words of excess x a chance of exp(-x) at most, so no tail is steeper than 1 nat
    return start, max(1.0, (above(TAIL / 2) - start) / np.log(2))


def held_out(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """The held-out documents (stored) and the languages that have enough of them."""
    held = stored(trusted_documents(docs, labels, held_out=True).where("length(text) > 0"), "quality-held-out")
    enough = held.groupBy("lang").count().where(F.col("count") >= MIN_HELD_OUT).limit(MAX_LANGUAGES + 1).collect()
    if len(enough) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return held, frozenset(r["lang"] for r in enough)


def limits(held: DataFrame, model: Model, quantile: float) -> dict[str, Limits]:
    """By language, and POOLED, of documents under their own languages' models and of all under that of POOLED."""
    rows, named = with_blocks(held.select("lang", "text"))
    lang = F.col(named["lang"])
    own = F.when(lang.isin(sorted(model.languages)), lang).otherwise(F.lit(POOLED)) if model.languages else F.lit(POOLED)
    rows = rows.select("block", own.alias("model"), F.col(named["text"]).alias("text"))
    folder = answers(model, rows, "text", rows.count())
    scored = stored(_scored(rows, "text", folder, {}).select("model", *EVERY), "quality-held-out-scores")
    pooled = scored.select(F.lit(POOLED).alias("model"), F.col("_lm_pooled_score").alias("_lm_score"), F.col("_lm_pooled_var").alias("_lm_var"), "_lm_symbols")
    scored = scored.where(F.col("model") != POOLED).select("model", "_lm_score", "_lm_var", "_lm_symbols").unionByName(pooled)
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    found = {r["model"]: r for r in scored.groupBy("model").agg(median("_lm_score").alias("centre"), median("_lm_var").alias("variance"), F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return {}
    of = lambda name: _lookup("model", {k: float(r[name]) for k, r in found.items()})
    off = scored.withColumn("z", F.abs(F.col("_lm_score") - of("centre")) / F.sqrt(F.greatest(of("variance"), F.lit(1e-9)) / F.col("_lm_symbols")))
    spread = {r["model"]: r["s"] for r in off.groupBy("model").agg(median("z").alias("s")).collect()}
    bins: dict[str, list] = {}
    for r in _word_histogram(rows, "text", folder, {k: r["centre"] for k, r in found.items()}).collect():  # some hundred bins a language
        bins.setdefault(r["model"], []).append((r["bin"], r["n"]))
    return {k: Limits(r["centre"], max(r["variance"], 1e-9), max(1.0, 1.4826 * spread[k]), _times(quantile, r["n"]), *_tail(bins[k])) for k, r in found.items()}


def _lookup(column: str, values: dict[str, float]) -> Column:
    out = F.lit(values[POOLED])
    for lang, q in values.items():
        if lang != POOLED:
            out = F.when(F.col(column) == lang, F.lit(q)).otherwise(out)
    return out


def _judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float) -> tuple[DataFrame, dict[str, str]]:
    """The documents under own names with STATS, _lm_threshold and _lm_keep, and the names they had."""
    held, enough = held_out(docs, labels)
    model = fit(spark, docs, labels, enough)
    found = limits(held, model, quantile) if model is not None else {}
    if not found:
        plain, named = own_names(docs)
        nothing = {k: F.lit(0).cast(t) for k, t in EVERY.items()}
        return plain.withColumns(nothing | {"_lm_threshold": F.lit(float("inf")), "_lm_keep": F.lit(True)}), named
    plain, named = with_blocks(docs)
    plain = plain.drop("at")
    lang = F.coalesce(F.col(named["lang"]), F.lit(""))
    plain = plain.withColumn("model", F.when(lang.isin(sorted(set(found) - {POOLED})), lang).otherwise(F.lit(POOLED)))
    folder = answers(model, plain, named["text"], docs.count())
    own = lambda name: _lookup("model", {k: float(getattr(v, name)) for k, v in found.items()})
    every = lambda name: F.lit(float(getattr(found[POOLED], name)))
    room = lambda of: of("times") * of("spread") * F.sqrt(of("variance") / F.greatest(F.col("_lm_symbols"), F.lit(1)))

    def passes(of, score_: str, worst: str) -> Column:
        rare = F.col("_lm_words") * TAIL * F.exp((of("tail_from") - F.col(worst)) / of("tail_scale")) < 1 - quantile
        return (F.abs(F.col(score_) - of("centre")) <= room(of)) & ~rare

    out = _scored(plain, named["text"], folder, {k: v.centre for k, v in found.items()}).withColumn("_lm_threshold", own("centre") + room(own))
    good = passes(own, "_lm_score", "_lm_worst") | passes(every, "_lm_pooled_score", "_lm_pooled_worst")
    return out.withColumn("_lm_keep", (F.col("_lm_symbols") == 0) | good), named


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """The documents with STATS, POOLED_STATS, _lm_threshold (the upper limit of the score at the document's length under
    its language's model) and _lm_keep.

    All rows and columns are kept, but for a column that has one of these names: it gives way to the result.
    """
    out, named = _judged(spark, docs, labels, quantile)
    return given_names(out, named, *[F.col(c) for c in (*EVERY, "_lm_threshold", "_lm_keep")])


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever these are called."""
    out, named = _judged(spark, docs, labels, quantile)
    return given_names(out.where("_lm_keep"), named)
