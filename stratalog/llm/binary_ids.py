"""Token-id files with Simple-8b word-aligned coding.

An id stream is cut into blocks of BLOCK ids. Each 64-bit word holds a selector (4 bits) and as many ids as fit in 60
bits at the selector's width; a value of more than 60 bits is escaped: a word with the escape selector, then the value
itself. Offsets of the blocks' words are stored, and all blocks of a chunk are coded and decoded at once with numpy.

A file is a magic number and chunks of some documents each: a header (counts), document ids, ids per document, words per
block, words; all little-endian. Chunks are written and read as a stream, so a task holds one of them. Files are written
under a name of their own attempt and then renamed, so a retried task leaves one whole file; their order is that of the
manifest's parts.

Null or empty texts are documents with the end id only. Documents without a doc_id come first, as nulls do in Spark's
order, in chunks of their own kind, and are read back as null. Rows of a repeated doc_id follow each other, ordered by
a hash of the text, and equal rows are written as often as they stand there. A very long text is a chunk of its own. Empty tables
give no files and no rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, open_folder, scratch_path, stored, text_bytes, write_whole
from .tokens import encoder

MAGIC = b"S8BIDS01"
BLOCK = 256
ESCAPE = 0
#: Selectors 1 .. 14: (ids in a word, bits of each), fixed by the coding.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: Ids that are coded at once.
SPAN = 1 << 20
#: Bytes of text in a file, about.
FILE_BYTES = 32 << 20


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each value (0 counts as 1); a value near a power of two above 2^53 may count one more."""
    exact = np.maximum(ids, np.uint64(1)).astype(np.float64)
    return ((exact.view(np.uint64) >> np.uint64(52)).astype(np.int64) - 1022).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words per block) of unsigned ids."""
    words, counts = [], []
    for a in range(0, len(ids), SPAN):
        w, c = _encode_span(ids[a : a + SPAN].astype(np.uint64))
        words.append(w)
        counts.append(c)
    return (np.concatenate(words), np.concatenate(counts)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _encode_span(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    bits = np.zeros(blocks * BLOCK + 64, np.uint8)  # beyond the end: no bits, so the last word may be short
    bits[:n] = _widths(ids)
    selector = np.zeros(blocks * BLOCK, np.uint8)
    most = {1: bits}
    for s, (count, width) in reversed(list(enumerate(LAYOUT, 1))):
        if count not in most:
            half = max(c for c in most if c < count)
            while half < count:  # the widest of `count` ids from the widest of fewer, which may overlap
                step = min(half, count - half)
                left = most[half]
                most[half + step] = np.maximum(left[: len(left) - step], left[step:])
                half += step
        fits = most[count][: len(selector)] <= width
        selector[fits[: len(selector)]] = s
    left = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    count_of = np.array([1] + [c for c, _ in LAYOUT], np.int64)
    at, live, begin = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):  # the next word of every unfinished block
        pos = live * BLOCK + at[live]
        begin.append(np.stack([live, pos]))
        at[live] += count_of[selector[pos]]
        live = live[at[live] < left[live]]
    block, pos = np.concatenate(begin, 1)
    order = np.argsort(pos, kind="stable")
    block, pos = block[order], pos[order]
    sel = selector[pos]
    words = sel.astype(np.uint64) << np.uint64(60)
    stop = np.minimum(block * BLOCK + BLOCK, n)
    for s, (count, width) in enumerate(LAYOUT, 1):
        mine = np.flatnonzero(sel == s)
        for j in range(count if len(mine) else 0):
            p = pos[mine] + j
            inside = p < stop[mine]
            words[mine[inside]] |= ids[p[inside]] << np.uint64(j * width)
    raw = np.flatnonzero(sel == ESCAPE)
    if len(raw):
        words = np.insert(words, raw + 1, ids[pos[raw]])
    return words, np.bincount(block, minlength=blocks) + np.bincount(block[raw], minlength=blocks)


def decode(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The n ids of whole blocks."""
    out = np.zeros(n, np.uint64)
    step = SPAN // BLOCK
    first = np.concatenate([[0], np.cumsum(per_block)])
    for a in range(0, len(per_block), step):
        b = min(len(per_block), a + step)
        _decode_span(words[first[a] : first[b]], per_block[a:b], out[a * BLOCK : b * BLOCK])
    return out


def _decode_span(words: np.ndarray, per_block: np.ndarray, out: np.ndarray) -> None:
    block = np.repeat(np.arange(len(per_block)), per_block)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a word after an escape is a value, whatever its top bits are
        follows = np.zeros(len(words), bool)
        i = 0
        marks = np.flatnonzero(sel == ESCAPE)
        while i < len(marks):
            m = marks[i]
            if not follows[m]:
                follows[m + 1] = True
            i += 1
    else:
        follows = np.zeros(len(words), bool)
    count_of = np.array([1] + [c for c, _ in LAYOUT] + [1], np.int64)
    n_ids = np.where(follows, 0, count_of[sel])
    before = np.cumsum(n_ids) - n_ids
    first = np.concatenate([[0], np.cumsum(per_block)])[:-1]
    padded = np.cumsum(np.bincount(block, weights=n_ids, minlength=len(per_block)).astype(np.int64))
    base = np.concatenate([[0], padded])[:-1]
    del first
    pos = block * BLOCK + before - base[block]
    stop = np.minimum(block * BLOCK + BLOCK, len(out))
    for s, (count, width) in enumerate(LAYOUT, 1):
        mine = np.flatnonzero((sel == s) & ~follows)
        mask = np.uint64((1 << width) - 1)
        for j in range(count if len(mine) else 0):
            p = pos[mine] + j
            inside = p < stop[mine]
            out[p[inside]] = (words[mine[inside]] >> np.uint64(j * width)) & mask
    raw = np.flatnonzero((sel == ESCAPE) & ~follows)
    out[pos[raw]] = words[raw + 1]


#: Fields of a chunk's header: whether its documents have ids, documents, blocks, words.
HEADER = 4


def pack_chunk(doc_ids: np.ndarray | None, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One chunk; doc_ids is None for documents without one."""
    words, per_block = encode(ids)
    head = np.array([doc_ids is not None, len(lengths), len(per_block), len(words)], "<i8")
    own = np.zeros(len(lengths), "<i8") if doc_ids is None else doc_ids
    parts = (head, "<i8"), (own, "<i8"), (lengths, "<i8"), (per_block, "<i4"), (words, "<u8")
    return b"".join(np.ascontiguousarray(x, dtype=kind).tobytes() for x, kind in parts)


def read_chunks(stream):
    """(doc ids or None, ids per document, ids) of each chunk of an open file."""
    if stream.read(8) != MAGIC:
        raise ValueError("not a token-id file")
    while head := stream.read(8 * HEADER):
        has_ids, n, blocks, n_words = np.frombuffer(head, "<i8").tolist()
        doc_ids, lengths = (np.frombuffer(stream.read(8 * n), "<i8") for _ in range(2))
        per_block = np.frombuffer(stream.read(4 * blocks), "<i4")
        words = np.frombuffer(stream.read(8 * n_words), "<u8")
        yield doc_ids if has_ids else None, lengths, decode(words, per_block, int(lengths.sum()))


def write_id_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text and write files in ascending doc_id order; a manifest row (part, file, n_docs, n_ids) for each.

    Rows are dealt by ranges of doc_id and a hash of the text, about `file_bytes` of text each.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        counted = [0, 0]

        def write(out):
            out.write(MAGIC)
            for batch in itertools.chain([first], batches):
                data, offs = binary_parts(batch.column("body"))
                names = batch.column("doc_id")
                has = names.is_valid().to_numpy(zero_copy_only=False)
                values = names.fill_null(0).to_numpy()
                some = int((~has).sum())  # they come first
                for lo, hi in ((0, some), (some, batch.num_rows)):
                    for a, b in chunks(offs[lo : hi + 1]):
                        a, b = lo + a, lo + b
                        ids, n = enc.encode(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                        own = np.full(len(ids) + len(n), end_id, np.uint64)
                        keep = np.ones(len(own), bool)
                        keep[np.cumsum(n + 1) - 1] = False
                        own[keep] = ids
                        out.write(pack_chunk(values[a:b] if has[a] else None, n + 1, own))
                        counted[0] += b - a
                        counted[1] += len(own)

        file = write_whole(folder, f"part-{part:09d}.s8b", write)
        kinds = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [file], "n_docs": counted[:1], "n_ids": counted[1:]}, schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).withColumn("order", F.xxhash64("body"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0)).alias("n")).first()["n"]
    ordered = rows.repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "order").sortWithinPartitions("doc_id", "order").drop("order")
    return ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long")


def read_id_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document, from the files."""
    from pyspark.sql.window import Window

    # a row a file: the running sum is over the manifest only
    before = Window.partitionBy("_all").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("_all", F.lit(0)).select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            store, _ = open_folder(folder)
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(file) as f:
                    for doc_ids, lengths, ids in read_chunks(f):
                        ends = np.concatenate([[0], np.cumsum(lengths)])
                        named = pa.nulls(len(lengths), pa.int64()) if doc_ids is None else pa.array(doc_ids)
                        body = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                        yield pa.RecordBatch.from_arrays([named, pa.array(base + ends[:-1]), pa.array(lengths), body], names=["doc_id", "start", "n_tokens", "ids"])
                        base += int(ends[-1])

    spread = based.repartitionByRange(max(1, manifest.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files of all documents to the shared folder and read them back."""
    folder = scratch_path(spark, "ids")
    manifest = stored(write_id_files(docs, tokenizer, end_id, folder, file_bytes), "ids-manifest")
    return read_id_files(manifest, folder)
