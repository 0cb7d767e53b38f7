"""Hierarchical residual packing: best fit in every partition, then a tree of merges over what stays underfull.

Documents are encoded and cut where they are longer than a window; a window's length is a bin of its own. Each partition packs
its rests by decreasing best fit (the bin with the least room that still fits) and gives out bins. Nearly full bins are
done. Underfull ones are items of the next round, dealt to groups of MERGE_ITEMS and packed by best fit again, until one
group holds them all or a round merges less than a tenth of them, so that long documents without short partners end the tree
and never gather in one task. A bin carries its pieces (at most as many as the window has ids); every round is a written
table of the shared folder.

Partitions with fewer than LEAF_LEAST rests would waste room, so they pass them on singly. Within a group only lengths
decide, so equal lengths take their places in any order.

Defined cases. Null and empty texts are the end id alone. Null and repeated doc_ids and repeated rows are packed row by row.
Very long texts are cut into as many windows as they fill. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, stored, text_bytes
from .tokens import encoder

#: Items that one best fit takes at most: a partition packs them as they come, a round deals them to groups of so many.
LEAF_ITEMS = MERGE_ITEMS = 20_000
LEAF_LEAST = 4000
#: A round that leaves more than this share of its items as bins is the last.
STALLED = 0.9
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_BINS = "fill long, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint,ids:binary>>"


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins): longest first, each into the bin with the least room that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, with_room, rooms, n = np.empty(len(lengths), np.int64), [[] for _ in range(window + 1)], 0, 0
    for item, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> length  # bit r of rooms: some bin has room r
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen, n = window, n, n + 1
        bins[item] = chosen
        room -= length
        if room:
            with_room[room].append(chosen)
            rooms |= 1 << room
    return bins, n


def _as_bins(pieces: pa.StructArray, of: np.ndarray, n: int) -> pa.RecordBatch:
    """Bins 0 to n - 1 of the pieces, with the pieces' offsets in their bins."""
    order = np.argsort(of, kind="stable")
    pieces, of = pieces.take(pa.array(order)), of[order]
    lengths = pieces.field("length").to_numpy()
    fill = np.bincount(of, weights=lengths, minlength=n).astype(np.int64)
    offset = np.cumsum(lengths) - lengths - (np.cumsum(fill) - fill)[of]
    columns = [pa.array(offset) if name == "offset" else pieces.field(name) for name, _ in _PIECE]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(columns, [name for name, _ in _PIECE]))
    return pa.RecordBatch.from_arrays([pa.array(fill), lists], names=["fill", "pieces"])


def _packed(batches: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Best fit over the bins of these batches, each bin one item."""
    table = pa.Table.from_batches(batches).combine_chunks()
    lists = table.column("pieces").chunk(0)
    bins, n = best_fit(table.column("fill").to_numpy(), window)
    return _as_bins(lists.flatten(), np.repeat(bins, lists.value_lengths().to_numpy()), n)


def _small(batch: pa.RecordBatch, rows: int = 2000):
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def leaf_bins(docs: DataFrame, tokenizer: str, end_id: int, window: int, keep_ids: bool) -> DataFrame:
    """Bins of each partition: full windows, and its rests packed."""

    def pieces(column: pa.Array, data: np.ndarray, offs: np.ndarray, enc) -> pa.StructArray:
        ids, n = enc.encode(data, offs)
        ids, ends = ids.astype("<u4"), np.cumsum(n)
        row, number, lengths, crcs, bodies = [], [], [], [], []
        for i, (e, m) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
            own = ids[e - m : e].tobytes() + end_id.to_bytes(4, "little")
            for k, at in enumerate(range(0, len(own), 4 * window)):
                part = own[at : at + 4 * window]
                row.append(i)
                number.append(k)
                lengths.append(len(part) // 4)
                crcs.append(zlib.crc32(part))
                bodies.append(part if keep_ids else None)
        number = np.array(number, np.int64)
        columns = [column.take(pa.array(row, pa.int64())), number, number * window, lengths, crcs, np.zeros(len(row), np.int64), bodies]
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _PIECE, strict=True)], [name for name, _ in _PIECE])

    def run(batches):
        enc, waiting, held, packed = encoder(tokenizer), [], 0, False
        for batch in batches:
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                some = pieces(batch.column("doc_id").slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], enc)
                single = _as_bins(some, np.arange(len(some)), len(some))
                full = single.column("fill").to_numpy() == window
                yield from _small(single.filter(pa.array(full)))
                rests = single.filter(pa.array(~full))
                waiting.append(rests)
                held += rests.num_rows
                if held >= LEAF_ITEMS:
                    yield from _small(_packed(waiting, window))
                    waiting, held, packed = [], 0, True
        if held and (packed or held >= LEAF_LEAST):
            waiting = [_packed(waiting, window)]
        for rests in waiting:
            yield from _small(rests)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(run, _BINS)


def merged(bins: DataFrame, groups: int, window: int) -> DataFrame:
    """Best fit over bins as items, dealt evenly to so many groups."""

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= 2 * MERGE_ITEMS:
                yield from _small(_packed(waiting, window))
                waiting, held = [], 0
        if held:
            yield from _small(_packed(waiting, window))

    return bins.repartition(groups).mapInArrow(run, _BINS)


def pack_whole_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 2048, keep_ids: bool = False, nearly_full: int | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    nearly_full = window - window // 128 if nearly_full is None else nearly_full
    bins = stored(leaf_bins(docs, tokenizer, end_id, window, keep_ids), "residual-leaf")
    done, n_open = [], bins.where(F.col("fill") < nearly_full).count()
    for round_ in range(1, 65):
        groups = -(-n_open // MERGE_ITEMS)
        if not groups:
            break
        done.append(bins.where(F.col("fill") >= nearly_full))
        bins = stored(merged(bins.where(F.col("fill") < nearly_full), groups, window), f"residual-{round_}")
        before, n_open = n_open, bins.where(F.col("fill") < nearly_full).count()
        if groups == 1 or n_open > STALLED * before:
            break
    for part in done:
        bins = bins.unionByName(part)
    bins = bins.withColumn("sequence_id", F.monotonically_increasing_id())  # before explode, so that a bin has one number
    rows = bins.select("sequence_id", F.explode("pieces").alias("p"))
    out = rows.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset", "p.ids")
    return out if keep_ids else out.drop("ids")
