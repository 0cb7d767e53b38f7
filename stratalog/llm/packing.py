"""Packing into fixed windows by minimum bin slack.

A document of n ids is cut into full windows and one rest of fewer ids. The rests are packed by their lengths: the
longest that remains opens a window, and a subset-sum dynamic programme over bitsets (one Python integer of
window + 1 bits for each length, counts split into powers of two) finds the sum closest to capacity, with the counts
traced back. A found multiset is used as often as the counts allow, so the plan depends on the histogram of lengths
(at most window - 1 numbers), never on the number of documents; documents then take their places in the plan by
their gapless rank among those of the same length.

A window is padded to its size, except where its length is a power of two. Null or empty texts hold the end id only.
Rows are packed one by one whatever their doc_ids are (null and repeated ones too); rows of equal length, doc_id and text
take their places in any order. Very long texts are cut into as many full windows as they fill. Empty tables give no
pieces. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, chunks, free_memory, gapless, salts_for, stored, text_bytes
from .tokens import encoder


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths whose sum is the largest up to capacity."""
    items = [(length, 1 << k) for length, most in sorted(counts.items(), reverse=True) for k in range((min(most, capacity // length)).bit_length())]
    limit = {length: min(most, capacity // length) for length, most in counts.items()}
    steps, reach, mask, seen = [], 1, (1 << (capacity + 1)) - 1, {}
    for length, power in items:
        use = min(power, limit[length] - seen.get(length, 0))
        if use <= 0:
            continue
        seen[length] = seen.get(length, 0) + use
        steps.append((length, use, reach))
        reach |= (reach << (length * use)) & mask
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, use, before in reversed(steps):  # a step was needed where the sum wasn't reached without it
        if not before >> best & 1:
            out[length] = out.get(length, 0) + use
            best -= length * use
    return out


def plan(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """[(counts by length, times used)] for all rests; every length is used exactly as often as it occurs."""
    left, out = dict(histogram), []
    while left:
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v - (k == longest) > 0 and k <= window - longest}
        chosen = fill(others, window - longest) if others else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens and for each piece its crc32 (and its ids if asked for): windows first, then the rest."""

    def run(batches):
        free_memory()
        enc = encoder(tokenizer)
        for batch in batches:
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                ids, n = enc.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ids = ids.astype("<u4")
                ends = np.cumsum(n)
                crcs, bodies = [], []
                for e, m in zip(ends.tolist(), n.tolist(), strict=True):
                    own = ids[e - m : e].tobytes() + end_id.to_bytes(4, "little")
                    pieces = [own[i : i + 4 * window] for i in range(0, len(own), 4 * window)]
                    crcs.append([zlib.crc32(p) for p in pieces])
                    bodies.append(pieces if keep_ids else None)
                out = [batch.column("doc_id").slice(a, b - a), batch.column("row_key").slice(a, b - a), pa.array(n + 1), pa.array(crcs, pa.list_(pa.int64())), pa.array(bodies, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row_key", "doc_tokens", "crcs", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, row_key long, doc_tokens long, crcs array<long>, ids array<binary>")


_PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("p_rest", "p_from", "p_to", "p_seq", "p_each", "p_offset")])


def place_rests(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first window, how many of the length in a window, offset of the first)."""
    out, seq, used = [], 0, dict.fromkeys(histogram, 0)
    for chosen, times in plan(histogram, window):
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            out.append((length, used[length], used[length] + each * times, seq, each, offset))
            used[length] += each * times
            offset += length * each
        seq += times
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for)."""
    rows = stored(token_pieces(docs, tokenizer, end_id, window, keep_ids), "packing-pieces")
    rows = rows.withColumn("n_full", F.expr(f"doc_tokens div {window}")).withColumn("rest", F.expr(f"doc_tokens % {window}"))
    # bounded: one number for each length below the window
    histogram = {r["rest"]: r["count"] for r in rows.where("rest > 0").groupBy("rest").count().collect()}
    long = rows.where("n_full > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_full"), F.lit(0)).alias("t")).first()
    # each length is numbered in as many parts as its own rows need
    parts = F.lit([salts_for(histogram.get(rest, 0), 20_000) for rest in range(window)])
    salt = F.pmod(F.col("row_key"), F.get(parts, F.col("rest").cast("int")))
    long_salt = F.pmod(F.col("row_key"), F.lit(salts_for(long["n"], 20_000)))
    order = [F.col("doc_id"), F.col("row_key")]
    full = gapless(rows.where("n_full > 0"), [], order, long_salt, "n_full", "first_full")
    windows = full.select("doc_id", "doc_tokens", "first_full", F.posexplode(F.slice("crcs", F.lit(1), F.col("n_full").cast("int"))).alias("i", "ids_crc32"), "ids")
    windows = windows.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.get("ids", F.col("i")).alias("ids"))
    rests = gapless(rows.where("rest > 0"), ["rest"], order, salt, None, "rank")
    where = F.broadcast(spark.createDataFrame(place_rests(histogram, window), _PLAN))  # bounded by the lengths below the window
    rests = rests.join(where, (F.col("rest") == F.col("p_rest")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    k = F.col("rank") - F.col("p_from")
    rests = rests.select("doc_id", (F.col("n_full") * window).alias("start"), F.col("rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", (F.lit(long["t"]) + F.col("p_seq") + F.expr("(rank - p_from) div p_each")).alias("sequence_id"), (F.col("p_offset") + k % F.col("p_each") * F.col("rest")).alias("offset"), F.element_at("ids", -1).alias("ids"))
    out = windows.unionByName(rests)
    return out if keep_ids else out.drop("ids")
