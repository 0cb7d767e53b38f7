"""Phrase search by a positional inverted index.

The index has blocks of postings as Parquet in buckets by token: a token, the records of one block of texts that have it,
and its positions in each, delta-coded. A record's tokens are turned round in the task that reads its text, so the only
shuffle of a build is that of finished blocks. A table says how many records have each token. A phrase takes the postings
of its rarest token first, then those of the next rarest, and the other tokens only in records that are left with both: what
moves is postings of asked tokens, never a text. What is left after each step is written, so its size is known and Spark
broadcasts it below its own threshold, and shuffles above.

A record names one text. Tokens are the runs of letters and digits of the lower-cased text (another pattern may be given). A null text, and one without
tokens, is in no posting; a phrase without tokens finds nothing; a repeated token is matched at each of its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

#: What separates tokens: everything that is no letter and no digit.
SEPARATORS = r"[^\p{L}\p{N}]+"
BUCKETS = 64
#: Up to so many buckets are named in a read; phrases that need more read the whole index.
NAMED_BUCKETS = 16
#: Tokens of texts that are turned round at once, in one task's memory; a longer text is a block of its own.
BLOCK_TOKENS = 2_000_000


def tokens(text: Column, separators: str = SEPARATORS) -> Column:
    return F.filter(F.split(F.lower(text), separators), lambda w: w != "")


def absolute(coded: Column) -> Column:
    """The reverse of `deltas`: running sums."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, d: F.struct(F.concat(acc["out"], F.array(acc["at"] + d)).alias("out"), (acc["at"] + d).alias("at"))
    return F.aggregate(coded, start, step, lambda acc: acc["out"])


def spans(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `most` tokens together, or of one row with more."""
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def inverted(records: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """token, records, ends, coded of a block: each token's records, where each one's positions end in `coded`, and the first
    position of each record followed by the steps to its others."""
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    by_token = words.flatten().dictionary_encode()
    codes = by_token.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    at = np.arange(len(codes), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(codes, kind="stable")  # rows and positions stay in order within a token
    codes, row, at = codes[order], row[order], at[order]
    new_token = np.diff(codes, prepend=-1) != 0
    new_pair = new_token | (np.diff(row, prepend=-1) != 0)
    coded = np.where(new_pair, at, np.diff(at, prepend=0)).astype(np.int32)
    token_at, pair_at = np.flatnonzero(new_token), np.flatnonzero(new_pair)
    pair_token = np.cumsum(new_token)[pair_at] - 1
    ends = np.append(pair_at[1:], len(codes)) - token_at[pair_token]
    pair_offsets = pa.array(np.append(np.flatnonzero(new_token[pair_at]), len(pair_at)).astype(np.int32))
    coded_offsets = pa.array(np.append(token_at, len(codes)).astype(np.int32))
    columns = [by_token.dictionary.take(pa.array(codes[token_at])), pa.ListArray.from_arrays(pair_offsets, records.take(pa.array(row[pair_at])))]
    columns += [pa.ListArray.from_arrays(pair_offsets, pa.array(ends.astype(np.int32))), pa.ListArray.from_arrays(coded_offsets, pa.array(coded))]
    return pa.RecordBatch.from_arrays(columns, names=["token", "records", "ends", "coded"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """A row for each (token, record) of blocks, other columns kept."""
    start = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    one = lambda r, i: F.struct(r.alias("record"), F.slice("coded", start(i) + 1, F.get("ends", i) - start(i)).alias("coded"))
    other = [c for c in blocks.columns if c not in ("records", "ends", "coded")]
    return blocks.select(*other, F.inline(F.transform("records", one)))


@dataclass(frozen=True)
class PhraseIndex:
    """Blocks (bucket, token, records, ends, coded) and frequencies (bucket, token, records) under one folder."""

    spark: SparkSession
    folder: str
    record_type: str
    buckets: int = BUCKETS
    separators: str = SEPARATORS

    def blocks(self) -> DataFrame:
        columns = f"token string, records array<{self.record_type}>, ends array<int>, coded array<int>"
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.folder}/postings")

    def postings(self) -> DataFrame:
        """token, bucket, record, coded."""
        return unpacked(self.blocks())

    def frequencies(self) -> DataFrame:
        return self.spark.read.schema("token string, records long, bucket int").parquet(f"{self.folder}/frequencies")

    def bucket(self, token: str = "token") -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")


def build_index(records: DataFrame, folder: str, buckets: int = BUCKETS, separators: str = SEPARATORS, block_tokens: int = BLOCK_TOKENS) -> PhraseIndex:
    """Index of records (record, text), written to `folder`.

    Blocks hold at most `block_tokens` tokens, so a frequent token has many rows: AQE splits a bucket that is too large for
    a task between them.
    """
    spark, kind = records.sparkSession, records.schema["record"].dataType.simpleString()
    index = PhraseIndex(spark, folder.rstrip("/"), kind, buckets, separators)

    def turned(batches):
        for batch in batches:
            words = batch.column("w")
            for first, end in spans(words.value_lengths().to_numpy(zero_copy_only=False), block_tokens):
                yield inverted(batch.column("record").slice(first, end - first), words.slice(first, end - first))

    read = records.select("record", tokens(F.col("text"), separators).alias("w")).where(F.size("w") > 0)
    rows = read.mapInArrow(turned, f"token string, records array<{kind}>, ends array<int>, coded array<int>").withColumn("bucket", index.bucket())
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{index.folder}/postings")
    n = index.blocks().groupBy("bucket", "token").agg(F.sum(F.size("records")).alias("records"))
    n.select("token", "records", "bucket").write.partitionBy("bucket").parquet(f"{index.folder}/frequencies")
    return index


def search(index: PhraseIndex, phrases: DataFrame) -> DataFrame:
    """phrase, record, starts: the places where each phrase (phrase, text) begins in a record."""
    asked = phrases.select("phrase", tokens(F.col("text"), index.separators).alias("w")).where(F.size("w") > 0)
    each = asked.select("phrase", F.size("w").alias("length"), F.posexplode("w").alias("k", "token")).withColumn("bucket", index.bucket())
    each = cut(each, "asked")
    named = [r[0] for r in each.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
    part = (lambda df: df.where(F.col("bucket").isin(named))) if len(named) <= NAMED_BUCKETS else (lambda df: df)
    known = each.join(part(index.frequencies()).select("bucket", "token", "records"), ["bucket", "token"], "left")
    # a phrase with a token that no record has is over; the others in order of rareness
    whole = F.count_if(F.col("records").isNull()).over(Window.partitionBy("phrase")) == 0
    rare = F.row_number().over(Window.partitionBy("phrase").orderBy("records", "k"))
    ranked = cut(known.withColumn("order", rare).withColumn("whole", whole).where("whole").drop("whole", "records"), "asked")
    blocks = part(index.blocks())
    of = lambda tokens: unpacked(blocks.join(tokens.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi"))
    begin = lambda: F.transform(absolute(F.col("coded")), lambda p: p - F.col("k"))
    kept = F.filter("starts", lambda s: s >= 0)

    # the rarest token's places, with what to look for next: one row, as a phrase has one second token at most
    second = ranked.where("order = 2").select("phrase", "bucket", "token", "k")
    first = unpacked(ranked.where("order = 1").select("bucket", "token", "phrase", "length", "k").join(blocks, ["bucket", "token"]))
    first = first.select("phrase", "length", "record", begin().alias("starts")).withColumn("starts", kept).where(F.size("starts") > 0)
    first = cut(first.join(second, "phrase", "left"), "phrases-first")
    both = of(second).join(first.where("length > 1"), ["bucket", "token", "record"])
    left = cut(both.select("phrase", "length", "record", F.array_intersect("starts", begin()).alias("starts")).where(F.size("starts") > 0), "phrases-both")

    rest = cut(left.where("length > 2").join(ranked.where("order > 2").select("phrase", "bucket", "token", "k"), "phrase"), "phrases-rest")
    others = of(rest).join(rest, ["bucket", "token", "record"])
    hits = others.select("phrase", "record", "length", F.explode(F.array_intersect("starts", begin())).alias("start"))
    full = hits.groupBy("phrase", "record", "start", "length").agg(F.count(F.lit(1)).alias("n")).where("n = length - 2")
    longer = full.groupBy("phrase", "record").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    found = lambda df: df.select("phrase", "record", F.sort_array("starts").alias("starts"))
    return found(first.where("length = 1")).unionByName(found(left.where("length = 2"))).unionByName(longer)


def bounded(hits: DataFrame, request: str, entity: str, order: list[Column], most_rows: int, most_entities: int) -> DataFrame:
    """The rows of each request in order, at most `most_rows` read and `most_entities` entities kept, with `place` and
    `sentinel`: the one row past the bound, which says that there is more.

    `order` begins with the entity. A row of a further entity is the sentinel; where the rows end first, the last one that
    was read is.
    """
    w = Window.partitionBy(request).orderBy(*order)
    rows = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_rows)  # a top-k of each task first
    nth = F.dense_rank().over(Window.partitionBy(request).orderBy(order[0]))
    rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= most_entities + 1)
    beyond = F.row_number().over(Window.partitionBy(request, entity).orderBy("place"))
    rows = rows.withColumn("_again", beyond).where((F.col("_nth") <= most_entities) | (F.col("_again") == 1))
    any_beyond = F.max(F.col("_nth") > most_entities).over(Window.partitionBy(request))
    sentinel = F.when(any_beyond, F.col("_nth") > most_entities).otherwise(F.col("place") == most_rows)
    return rows.withColumn("sentinel", sentinel).drop("_nth", "_again")
