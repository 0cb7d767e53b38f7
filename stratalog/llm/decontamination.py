"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items (`window` consecutive words; a shorter item is one window). For each
pattern length m a shift table maps a block of B words to how far the search may advance; blocks that no pattern has
shift by m - B + 1. Where the shift is 0, the bucket of the block's last occurrence selects patterns, and a direct
comparison of all m words confirms one. Documents are streamed against broadcast patterns. Items of more than
`block_bytes` of text in all are dealt into blocks of about that size; each is brought to the driver, broadcast, searched
over all documents and dropped before the next, and the hits of a row are put together by a number of its own.

Words: bytes 0-9, A-Z (lowered), a-z and everything above U+007F; the rest separates. Null texts have no words, items
without an id, text or words match nothing. Repeated items and windows count for each item that has them. Each row of
the documents is judged by itself, whatever its doc_id (null and repeated ones too). Very long texts are searched whole.
Without documents there are no rows; without items nothing is hit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given_names, numbered, own_names, stored

#: Lower-cases A-Z and turns every separating byte into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def fold(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = len(patterns[0])
        self.block = 3 if self.m >= 6 else min(2, self.m)
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[tuple[bytes, ...], int]] = {}
        for index, p in enumerate(patterns):
            for end in range(self.block, self.m + 1):
                key = b" ".join(p[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.m), self.m - end)
            self.bucket.setdefault(b" ".join(p[-self.block :]), {})[p] = index

    def search(self, words: list[bytes]):
        """(start, pattern index) of every occurrence."""
        m, b, shift, bucket, far = self.m, self.block, self.shift, self.bucket, self.m - self.block + 1
        i, n = m, len(words)
        while i <= n:
            key = b" ".join(words[i - b : i])
            s = shift.get(key, far)
            if s:
                i += s
                continue
            found = bucket[key].get(tuple(words[i - m : i]))  # the direct comparison, of all m words
            if found is not None:
                yield i - m, found
            i += 1


class Matcher:
    """All windows of some items, by length; items[k] are those that have pattern k."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item_id, text in items:
            words = fold(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item_id)
        self.parts = [(WuManber(list(p)), [sorted(x) for x in p.values()]) for p in by_length.values()]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans [start, end) in words, in order, and the items."""
        found, items = [], set()
        for search, owners in self.parts:
            for start, k in search.search(words):
                found.append((start, start + search.m))
                items.update(owners[k])
        out: list[list[int]] = []
        for s, e in sorted(found):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [tuple(x) for x in out], items


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(rows: DataFrame, text: str, matcher, window: int) -> DataFrame:
    """The rows without `text`, and n_words, spans, items."""
    kept = [f for f in rows.schema if f.name != text]

    def run(batches):
        m = Matcher(matcher.value, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            for body in batch.column(text).cast(pa.binary()).to_pylist():
                words = fold(body or b"")
                found, of = m.spans(words)
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(of))
            found = pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *found], names=[*(f.name for f in kept), "n_words", "spans", "items"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, schema + "n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def _hits_by_block(spark: SparkSession, rows: DataFrame, text: str, blocks: list[DataFrame], window: int) -> DataFrame:
    """row, n_words, spans, items of stored rows, of all blocks of items together."""
    parts = []
    for block in blocks:
        patterns = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in block.collect()])
        found = _search(rows.select("row", text), text, patterns, window)
        parts.append(stored(found if not parts else found.where(F.size("spans") > 0), "decontamination"))
        patterns.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")))
    joined = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["end"] >= x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer(acc, x))).otherwise(F.concat(acc, F.array(x))),
    )
    return merged.withColumn("spans", joined)


def _judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """All columns of the documents under own names with n_words, spans, items; and the names they had."""
    plain, named = own_names(docs)
    text = named["text"]
    blocks = _item_blocks(benchmark, block_bytes)
    if len(blocks) == 1:  # one pass, and rows are carried through it
        patterns = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in blocks[0].collect()])
        return _search(plain.withColumn("body", F.col(text)), "body", patterns, window), named
    rows = numbered(plain, "decontamination-rows")
    return rows.join(_hits_by_block(spark, rows, text, blocks, window), "row").drop("row"), named


def contaminated_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, spans (word ranges inside occurrences) and items (ids as strings), a row for every row of the documents."""
    found, named = _judged(spark, docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select(F.col(named["doc_id"]).alias("doc_id"), "n_words", "spans", "items")


def hit_words(spans: str | Column) -> Column:
    """Number of words in disjoint spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def remove_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents without an occurrence, with their own columns, whatever these are called (repeated rows included)."""
    found, named = _judged(spark, docs, benchmark, window, block_bytes)
    return given_names(found.where(F.size("spans") == 0), named)
