"""N-gram Jaccard join by T-occurrence search, and the groups of documents that its links connect.

A document's set is its distinct 5-word shingles (64-bit hashes); two documents link where 100 * shared >= 80 * union.

1. Equal sets collapse to their smallest doc_id, so copies cost one row each.
2. Prefix filter: in one global order of shingles (rare before frequent, then by hash), linked sets share a shingle
   among the first n - ceil(0.8 n) + 1 of each. Frequent shingles are counted over all documents in the tasks and
   the hottest are broadcast (HOT_SHINGLES at most); the order only steers cost, any order gives the same links.
3. The prefixes are the inverted lists, one of those with the same documents. A list names its smallest document as
   centre; each other document on it is searched against the centre, never against all the others.
4. Each set has a sketch: the parities of how many of its shingles fall on each of some 10 n bits. Two sets differ in
   at least as many shingles as their sketches in bits, so candidates whose sketches differ too much go, and no link
   does. A sketch folds to a smaller one; the folded ones are compared first, and the texts move only for what is left.
5. T-occurrence search (DivideSkip) answers a centre over a block of the documents that asked for it: inverted lists
   of the block's shingles that the centre has are divided into long and short ones, the short ones are merged with a
   heap, and the long ones are probed by binary search for the documents that can still reach the required overlap.
6. Linked documents are joined into components (large-star, small-star, all by joins). Lists that still hold
   several components go on: the sketches of short lists are compared with each other in memory and those of long
   lists, dealt in blocks, with more centres each round, until no list is left. Only documents of different components
   whose sketches are near enough become rows, so every link between different components is found.

Nulls and texts without words have empty sets: alone in their component. Fewer than k words are one shingle. Rows are
told apart by numbers of their own, whatever their doc_ids are; equal rows are copies like any other. Very long texts
are taken whole. A similarity of just 0.8 links. Empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, given_names, numbered, own_names, stored, text_bytes
from .words import Words, grams, mix

SHINGLE = 5
SHARE, OF = 80, 100
#: Hottest shingles that get a place at the end of the global order (12 bytes each, broadcast).
HOT_SHINGLES = 200_000
#: Documents that a search block holds.
BLOCK_DOCS = 128
#: Lists up to this many documents are compared whole after the first round; longer ones in blocks of as many.
SHORT_LIST = 1024
#: From the third round on, lists up to so many are compared whole: what is left then is of documents that seldom link.
LATE_LIST = 8 * SHORT_LIST
#: Up to so many candidates are verified at once, and up to MANY_PAIRS meet with whole sketches at once: a pass over few
#: rows costs more than what it rules out.
FEW_PAIRS, MANY_PAIRS = 2000, 100_000
#: Bits of a set's sketch: a power of two from 10 for each shingle, within these. Lists carry the least.
SKETCH_BITS = 2048, 262_144
#: Candidates meet first with sketches of a quarter of the bits, those left with the whole ones.
COARSE = 4
#: Within a list, sketches of so many bits are compared first.
FIRST_BITS = 512
#: Ids of documents to be searched that are broadcast at most (8 bytes each), so that only their texts are shuffled.
BROADCAST_IDS = 2_000_000
#: A list counts as long where it has at least 1 / LONG of a block's documents.
LONG = 4


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes sorted within each document, bounds of the documents); distinct."""
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    g = grams(h, k)
    n_docs = len(w.count)
    per = np.where(w.count >= k, w.count - k + 1, 0)
    of = np.repeat(np.arange(n_docs), per)
    at = np.repeat(w.first[:-1] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    values = g[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = w.count[short] > j
            whole[has] = mix(whole[has] + h[w.first[short[has]] + j] + np.uint64(j + 1))
        of, values = np.concatenate([of, short]), np.concatenate([values, mix(whole + np.uint64(7919))])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    of, values = of[keep], values[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))]).astype(np.int64)


def needed(n_a, n_b):
    """Least overlap of two linked sets: shared * (OF + SHARE) >= SHARE * (n_a + n_b)."""
    return -(-SHARE * (n_a + n_b) // (OF + SHARE))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (-(-SHARE * n // OF)) + 1, 0)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (last axis) cut down to `words` 64-bit words: a bit is the parity of those that fall on it."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def sketches(v: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """For each set, its size and the words of its sketch."""
    n = np.diff(cut)
    least, most = SKETCH_BITS
    words = (np.clip(2 ** np.ceil(np.log2(np.maximum(10 * n, 1))), least, most) // 64).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(words + 1)])
    flat = np.zeros(base[-1], np.uint64)
    at = np.repeat(base[:-1] + 1, n) + ((v & np.repeat(words * 64 - 1, n).astype(np.uint64)) >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(flat, at, np.uint64(1) << (v & np.uint64(63)))
    flat[base[:-1]] = n
    return [flat[i:j] for i, j in zip(base[:-1], base[1:], strict=True)]


def near_sketches(centre: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Indices of the sketches whose sets may link with the centre's."""
    out = []
    sizes = np.array([len(x) for x in others])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        some = np.stack([others[i] for i in at])
        words = min(size, len(centre)) - 1
        apart = np.bitwise_count(folded(some[:, 1:], words) ^ folded(centre[1:], words)).sum(1, dtype=np.int64)
        n_a, n_b = int(centre[0]), some[:, 0].astype(np.int64)
        out.extend(at[apart <= n_a + n_b - 2 * needed(n_a, n_b)].tolist())
    return out


def coarse(sketch: np.ndarray) -> np.ndarray:
    """A sketch (size first) folded to 1 / COARSE of its bits."""
    return np.concatenate([sketch[:1], folded(sketch[1:], (len(sketch) - 1) // COARSE)])


def set_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (size and 128-bit digest of each set), sketch, coarse (it folded), and least (the smallest, without the size)."""

    def run(batches):
        for batch in batches:
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                v, cut = sets_of(data[offs[a] : offs[b]], offs[a : b + 1])
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(v + np.uint64(s)))]) for s in (1, 2)]
                bits = sketches(v, cut)
                least = [folded(x[1:], SKETCH_BITS[0] // 64).tobytes() for x in bits]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(cut)), *(pa.array((x[cut[1:]] - x[cut[:-1]]).view(np.int64)) for x in sums), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([coarse(x).tobytes() for x in bits], pa.binary()), pa.array(least, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sketch", "coarse", "least"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, coarse binary, least binary")


def frequent_shingles(docs: DataFrame, most: int = HOT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts (sorted by hash) and their counts; each task passes on those it saw twice."""

    def run(batches):
        have = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merge():
            v, n = np.unique(np.concatenate([have[0][:0], *held]), return_counts=True)
            new = (n > 1) | np.isin(v, have[0], assume_unique=True)  # seen once and never before: not passed on
            v, at = np.unique(np.concatenate([have[0], v[new]]), return_inverse=True)
            return v, np.bincount(at, weights=np.concatenate([have[1], n[new]]), minlength=len(v)).astype(np.int64)

        seen = 0
        for batch in batches:
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                held.append(sets_of(data[offs[a] : offs[b]], offs[a : b + 1])[0])
                seen += len(held[-1])
                if seen > 2_000_000:
                    have, held, seen = merge(), [], 0
        v, n = merge()
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counted = docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where("n > 4").orderBy(F.desc("n"), "shingle").limit(most).toArrow()  # bounded by `most`
    v, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(v)
    return v[order], n[order]


def prefixes(docs: DataFrame, hot) -> DataFrame:
    """shingle, doc_id, n, hot of each set's prefix in the global order; n is the set's size, hot says that `hot` has the shingle."""

    def run(batches):
        hot_v, hot_n = hot.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offs = binary_parts(batch.column("body"))
            for a, b in chunks(offs):
                v, cut = sets_of(data[offs[a] : offs[b]], offs[a : b + 1])
                n = np.diff(cut)
                of = np.repeat(np.arange(a, b), n)
                rank = np.zeros(len(v), np.int64)
                if len(hot_v) and len(v):
                    at = np.minimum(np.searchsorted(hot_v, v), len(hot_v) - 1)
                    rank = np.where(hot_v[at] == v, hot_n[at], 0)
                order = np.lexsort((v, rank, of))
                place = np.arange(len(v)) - np.repeat(cut[:-1], n)
                keep = place < np.repeat(prefix_length(n), n)
                v, rank, of = v[order][keep], rank[order][keep], of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(ids[of]), pa.array(n[of - a].astype(np.int32)), pa.array(rank > 0)], names=["shingle", "doc_id", "n", "hot"])

    return docs.mapInArrow(run, "shingle long, doc_id long, n int, hot boolean")


def shared_lists(posted: DataFrame, width: int) -> DataFrame:
    """shingle, doc_id, n of the postings whose shingle is posted more than once; those of hot shingles all stay.

    One shuffle: the others meet by shingle, sorted, and a list of one goes. Hot shingles are known to be shared, so
    their postings need not meet here and are dealt by document.
    """

    def run(batches):
        last, waiting = None, None  # the shingle before, and its only posting so far
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("shingle").to_numpy()
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            same = v[1:] == v[:-1]
            keep = hot.copy()
            keep[1:] |= same
            keep[:-1] |= same
            rows = batch.select(["shingle", "doc_id", "n"])
            if last is not None and v[0] == last:
                keep[0] = True
                if waiting is not None:
                    yield waiting
            waiting = None if keep[-1] else rows.slice(batch.num_rows - 1)
            last = v[-1]
            yield rows.filter(pa.array(keep))

    meet = F.when(F.col("hot"), F.xxhash64("doc_id")).otherwise(F.col("shingle"))
    dealt = posted.withColumn("meet", meet).repartition(width, "meet").drop("meet").sortWithinPartitions("shingle")
    return dealt.mapInArrow(run, "shingle long, doc_id long, n int")


def merge_short(lists: list[np.ndarray], n: int) -> np.ndarray:
    """How many of the inverted lists (ascending) each of n documents stands on, by a heap over the lists' heads."""
    have = np.zeros(n, np.int64)
    heap = [(int(x[0]), i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        doc, i, at = heap[0]
        have[doc] += 1
        if at + 1 < len(lists[i]):
            heapq.heapreplace(heap, (int(lists[i][at + 1]), i, at + 1))
        else:
            heapq.heappop(heap)
    return have


def search_block(centre: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Indices of the sets that link with the centre's: T-occurrence search over an inverted index of the block.

    DivideSkip: the longest lists (those of at least 1 / LONG of the documents) are set aside, the short ones are merged
    with a heap, and documents that can still reach the required overlap are looked up in the long ones by binary search.
    """
    if not others or not len(centre):
        return []
    sizes = np.array([len(x) for x in others])
    of = np.repeat(np.arange(len(others)), sizes)
    v = np.concatenate(others)
    at = np.minimum(np.searchsorted(centre, v), len(centre) - 1)
    inside = centre[at] == v
    # the inverted index: postings of the centre's shingles only, by shingle and document
    slot, of = at[inside], of[inside]
    order = np.argsort(slot, kind="stable")
    slot, of = slot[order], of[order]
    length = np.bincount(slot, minlength=len(centre))
    begin = np.cumsum(length) - length
    need = needed(len(centre), sizes)
    is_long = length >= max(2, -(-len(others) // LONG))
    have = merge_short([of[begin[i] : begin[i] + length[i]] for i in np.flatnonzero(~is_long & (length > 0))], len(others))
    left = int(is_long.sum())
    live = np.flatnonzero(have + left >= need)
    if len(live) and left:
        keep = is_long[slot]
        key = slot[keep].astype(np.int64) * len(others) + of[keep]  # long lists end to end, each ascending
        long_slots = np.flatnonzero(is_long)
        long_slots = long_slots[np.argsort(-length[long_slots], kind="stable")]
        for a in range(0, len(long_slots), 32):
            some = long_slots[a : a + 32]
            probe = some[:, None] * len(others) + live[None, :]
            at = np.minimum(np.searchsorted(key, probe), len(key) - 1)
            have[live] += (key[at] == probe).sum(0)
            left -= len(some)
            live = live[have[live] + left >= need[live]]
            if not len(live):
                break
    return [int(i) for i in live if have[i] >= need[i]]


def _read_sets(data: np.ndarray, offs: np.ndarray):
    for a, b in chunks(offs):
        v, cut = sets_of(data[offs[a] : offs[b]], offs[a : b + 1])
        for i in range(b - a):
            yield v[cut[i] : cut[i + 1]]


def _read_sketches(data: np.ndarray, offs: np.ndarray):
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        yield data[a:b].view(np.uint64)


def _searched(pairs: DataFrame, bodies: DataFrame, width: int, read, search) -> DataFrame:
    """The pairs (centre, other) that `search` finds, as a, b. `bodies`: doc_id, body; hot centres go in blocks of documents."""
    sizes = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("asked"))
    blocks = F.expr(f"cast(ceil(asked / {BLOCK_DOCS}) as int)")
    centres = sizes.join(bodies, sizes["centre"] == bodies["doc_id"]).select("centre", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("other"), "body")
    others = pairs.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("other"), blocks).cast("int"))
    others = others.join(bodies, others["other"] == bodies["doc_id"]).select("centre", "block", "other", "body")

    def found(state) -> pa.RecordBatch:
        (centre, _), centre_bodies, ids, held = state
        hit = sorted({ids[i] for own in centre_bodies for i in search(own, held)}) if held else []
        return pa.RecordBatch.from_arrays([pa.array([centre] * len(hit), pa.int64()), pa.array(hit, pa.int64())], names=["a", "b"])

    def run(batches):
        state = None  # (key, centre's bodies, ids, bodies) of the group that is being read
        for batch in batches:
            centre, block, other = (batch.column(c).to_pylist() for c in ("centre", "block", "other"))
            for i, own in enumerate(read(*binary_parts(batch.column("body")))):
                if state is None or state[0] != (centre[i], block[i]):
                    if state:
                        yield found(state)
                    state = ((centre[i], block[i]), [], [], [])
                if other[i] is None:
                    state[1].append(own)
                else:
                    state[2].append(other[i])
                    state[3].append(own)
                if len(state[2]) >= 2 * BLOCK_DOCS:
                    yield found(state)
                    state = (state[0], state[1], [], [])
        if state:
            yield found(state)

    grouped = centres.unionByName(others).repartition(width, "centre", "block").sortWithinPartitions("centre", "block", F.col("other").asc_nulls_first())
    return grouped.mapInArrow(run, "a long, b long")


def _asked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The bodies of the documents in the pairs; beyond BROADCAST_IDS of those, all."""
    ids = pairs.select(F.explode(F.array("centre", "other")).alias("doc_id")).distinct()
    return bodies.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else bodies


def may_link(pairs: DataFrame, digests: DataFrame, width: int) -> DataFrame:
    """The pairs (centre, other) whose sketches, first the coarse and then the whole ones, allow a link; of few pairs, all."""
    asked = pairs.count()
    if asked <= FEW_PAIRS:
        return pairs
    for column in ("coarse", "sketch") if asked > MANY_PAIRS else ("sketch",):
        bodies = _asked(pairs, digests.select("doc_id", F.col(column).alias("body")))
        near = _searched(pairs, bodies, width, _read_sketches, near_sketches).select(F.col("a").alias("centre"), F.col("b").alias("other"))
        pairs = stored(near, f"join-{column}") if column == "coarse" else near
    return pairs


def verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (centre, other) that link, as a, b. `texts`: doc_id, body."""
    return _searched(pairs, _asked(pairs, texts).repartition(width, "doc_id"), width, _read_sets, search_block)


def near_in_lists(members: DataFrame, heads: DataFrame, width: int, whole: int = SHORT_LIST) -> DataFrame:
    """centre, other: documents of one list and different roots whose sketches allow a link.

    `members`: shingle, m (its length), doc_id, n, root, least; `heads`: the same, the centres of lists over `whole`.
    """
    count = F.expr(f"cast(ceil(m / {SHORT_LIST}) as int)")
    columns = ["shingle", "block", "head", "doc_id", "n", "root", "least"]
    dealt = members.withColumn("block", F.when(F.col("m") <= whole, 0).otherwise(F.pmod(F.xxhash64("doc_id"), count)).cast("int")).withColumn("head", F.lit(False))
    every = heads.withColumn("block", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("head", F.lit(True))
    rows = dealt.select(*columns).unionByName(every.select(*columns))

    def compare(head, doc, n, root, bits):
        if head.any():
            left, right = np.flatnonzero(head), np.flatnonzero(~head)
        else:
            left = right = np.arange(len(doc))
        first = folded(bits, FIRST_BITS // 64)
        for a in range(0, len(left), 64):
            some = left[a : a + 64]
            apart = np.zeros((len(some), len(right)), np.int32)
            for word in range(first.shape[1]):
                apart += np.bitwise_count(first[some, word][:, None] ^ first[right, word][None, :])
            both = n[some][:, None] + n[right][None, :]
            near = (apart <= both - 2 * needed(n[some][:, None], n[right][None, :])) & (root[some][:, None] != root[right][None, :])
            if left is right:
                near &= doc[some][:, None] < doc[right][None, :]
            i, j = np.nonzero(near)
            i, j = some[i], right[j]
            for at in range(0, len(i), 8192):
                p, q = i[at : at + 8192], j[at : at + 8192]
                keep = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= n[p] + n[q] - 2 * needed(n[p], n[q])
                yield doc[p[keep]], doc[q[keep]]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = binary_parts(batch.column("least"))
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:-1]]
            now.append(data.view(np.uint64).reshape(batch.num_rows, -1))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            starts = np.flatnonzero(np.concatenate([[True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]))
            out = [pair for a, b in zip(starts[:-1], starts[1:], strict=True) for pair in compare(*(x[a:b] for x in now[2:]))]
            held = [x[starts[-1] :].copy() for x in now]
            yield from emit(out)
        if held is not None:
            yield from emit(list(compare(*held[2:])))

    def emit(out):
        if out:
            pairs = np.unique(np.stack([np.concatenate([x[k] for x in out]) for k in (0, 1)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["centre", "other"])

    grouped = rows.repartition(width, "shingle", "block").sortWithinPartitions("shingle", "block")
    return grouped.mapInArrow(run, "centre long, other long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of the edges (a, b); nodes without edges to others are left out.

    Large-star and small-star rounds: every step is a grouped minimum and a join, so a node with very many edges is
    combined in the tasks first. Each round is written to the shared folder.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while not _is_star(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low2, "u")
        small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = stored(small, "components")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _is_star(edges: DataFrame) -> bool:
    """Whether every u (u > v) has one v, and no v is itself a u: then v is the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    about = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n"))
    return about.where("out > 1 or (out = 1 and n > 1)").isEmpty()


def _classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, root (the least doc_id reachable) of documents whose doc_ids differ."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digests = stored(set_digests(docs), "join-digests")
    # equal sets: the smallest doc_id stands for them
    first = digests.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("first"))
    copies = stored(digests.join(first, ["n_shingles", "d1", "d2"]).select("doc_id", "first"), "join-copies")
    own = copies.where("doc_id = first").select("doc_id")
    mere = stored(copies.where("doc_id != first").select("doc_id").distinct().join(own, "doc_id", "left_anti"), "join-mere-copies")
    few = mere.count() <= BROADCAST_IDS
    texts = _rows(docs)
    if few:
        texts = texts.join(F.broadcast(mere), "doc_id", "left_anti")
    hot = spark.sparkContext.broadcast(frequent_shingles(texts))
    # lists of at least two documents; the rest of the corpus ends here
    shared = stored(shared_lists(prefixes(texts, hot), width), "join-lists")
    if not few:
        shared = shared.join(mere, "doc_id", "left_anti")
    known, step = None, 0
    while True:
        if known is not None:
            shared = shared.drop("root").join(known, shared["doc_id"] == known["node"], "left").select("shingle", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
        else:
            shared = shared.withColumn("root", F.col("doc_id"))
        which = [F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))).alias("y")]
        about = shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r1"), F.max("root").alias("r2"), *which).where("m > 1 and r1 < r2")
        # lists of the same documents ask the same
        about = about.groupBy("m", "r1", "r2", "x", "y").agg(F.min("shingle").alias("shingle"))
        shared = stored(shared.join(about.select("shingle", "m"), "shingle"), f"join-lists-{step}")
        if shared.isEmpty():
            break
        # the first round has one centre a list; later ones take short lists whole and eight times as many centres of long ones
        whole = SHORT_LIST if step < 2 else LATE_LIST
        short = F.lit(False) if step == 0 else F.col("m") <= whole
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(1 if step == 0 else 2 * 8**step))
        heads = shared.where(~short).groupBy("shingle", salt.alias("salt")).agg(F.min(F.struct("doc_id", "n", "root", "m")).alias("head"))
        heads = heads.select("shingle", "head.*")
        if step == 0:
            centres = heads.select("shingle", F.col("doc_id").alias("centre"), F.col("n").alias("cn"))
            near = (F.col("n") * OF >= F.col("cn") * SHARE) & (F.col("cn") * OF >= F.col("n") * SHARE) & (F.col("doc_id") != F.col("centre"))
            asked = shared.join(centres, "shingle").where(near).select("centre", F.col("doc_id").alias("other"))
        else:
            least = digests.select("doc_id", "least")
            asked = near_in_lists(shared.join(least, "doc_id"), heads.join(least, "doc_id"), width, whole)
        asked = stored(asked.distinct(), f"join-asked-{step}")
        pairs = may_link(asked, digests, width)
        pairs = pairs if pairs is asked else stored(pairs, f"join-pairs-{step}")
        found = stored(verify(pairs, texts, width), f"join-links-{step}")
        if not found.isEmpty():
            # what is linked already is carried by its root
            more = found if known is None else found.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
            known = stored(components(more), "join-components")
        # a centre has met its whole list, and short lists have met all their pairs
        rest = shared.where(~short).select("shingle", "doc_id", "n", "root")
        shared = rest.join(heads.select("shingle", "doc_id"), ["shingle", "doc_id"], "left_anti")
        step += 1
    roots = copies if known is None else copies.join(known, copies["first"] == known["node"], "left").select("doc_id", F.coalesce("root", "first").alias("first"))
    out = digests.select("doc_id", "n_shingles").join(roots, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("root"))


def _classified(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(row, root, n_shingles), the stored documents under own names with `row`, and the names they had."""
    plain, named = own_names(docs)
    rows = numbered(plain, "join-rows")
    return _classes(spark, rows.select(F.col("row").alias("doc_id"), F.col(named["text"]).alias("text"))).withColumnRenamed("doc_id", "row"), rows, named


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, a row for every row of the documents.

    Rows of a repeated doc_id are documents of their own. A null doc_id is no smallest one: its row takes the component's
    smallest other, and null where there is none.
    """
    found, rows, named = _classified(spark, docs.select("doc_id", "text"))
    found = stored(found, "join-classes")
    ids = rows.select("row", F.col(named["doc_id"]).cast("long").alias("doc_id"))
    every = ids.join(found, "row")
    # most documents are alone or the first of their component: their own row is the root
    least = every.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return every.join(least, "root").select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component (the one with its smallest doc_id; of several such rows, the first), with its own
    columns, whatever these are called. Documents without words are linked with nothing, so they all stay."""
    found, rows, named = _classified(spark, docs)
    ids = rows.select("row", F.col(named["doc_id"]).cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    stay = ids.join(found, "row").groupBy("root").agg(first).select(F.col("first.row").alias("row"))
    return given_names(rows.join(stay, "row", "left_semi"), named)
