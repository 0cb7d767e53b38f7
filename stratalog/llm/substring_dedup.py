"""Exact substring deduplication by suffix automata of reference shards.

A word goes where some window of `window` consecutive words covers it whose words also start earlier (smaller doc_id,
or the same document before); windows are judged on the input.

Streaming every document against the automaton of every shard would be documents times shards, so shards are made by
content, and a document meets only those that can hold one of its windows:

1. Each window has an anchor: the least hash of its 6-word grams. A segment is a run of up to SEGMENT windows of one
   document with one anchor. Equal windows have equal anchors, so a window can only repeat within its anchor's shard.
   An anchor of more than HOT_SEGMENTS segments is hot: there each window is a segment of its own, whose shard is
   named by all its words, so that no shard grows beyond that bound.
2. Anchors that occur once end here. The blocks (neighbouring rows of a file) name their anchors, these meet by anchor,
   and each block gets back those of its own that occur again.
3. Blocks name the distinct segments of these anchors. Of equal segments the first is known when they meet, and the
   windows of the others are repeats: their matching statistics would be those of the first.
4. The distinct segments of a shard, in order of document and start, are streamed through its suffix automaton over
   words. Matching statistics (the longest suffix of what was read that occurs before) of `window` or more mark the
   window that ends there; then the word is added, so the automaton always holds exactly what stands earlier.
5. The marks go back to the blocks, and a last pass over the documents removes the words.

Texts are read in four passes and never shuffled; what a block is sent lies in one file of the shared folder.

Words are compared by 64-bit hashes, and anchors and segments with them. Null and empty texts have no words. Very long
texts are taken whole. Rows without a doc_id have no place in the order: they stay whole and make nothing a repeat.
Rows of a repeated doc_id are documents of their own, in a fixed order among themselves, so of equal rows one stays.
Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, given_names, read_block, shuffle_width, some_rows, with_blocks, write_blocks
from .words import Words, _WORD_MUL, _table, grams, mix, window_min

WINDOW, GRAM = 20, 6
#: Windows in a segment at most; start * 64 + windows fits a long.
SEGMENT = 60
#: Segments of an anchor (distinct ones in each block, summed) above which its windows are shards of their own.
HOT_SEGMENTS = 2_000
#: Rows that a block gathers before equal segments collapse.
HELD = 1_000_000


class SuffixAutomaton:
    """Of several word sequences, built word by word while they are matched against it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def begin(self) -> None:
        self.last = 0

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, c: int) -> None:
        nxt, link, length, p = self.next, self.link, self.length, self.last
        q = nxt[p].get(c)
        if q is not None:  # a later sequence runs along what is there
            self.last = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            return
        now = self._new(length[p] + 1, 0, {})
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        self.last = now

    def stream(self, words: list[int]) -> list[int]:
        """Matching statistics of the sequence against all before it and its own earlier part; then it is in."""
        self.begin()
        nxt, link, length = self.next, self.link, self.length
        v, have, out = 0, 0, []
        for c in words:
            while v and c not in nxt[v]:
                v = link[v]
                have = length[v]
            if c in nxt[v]:
                v, have = nxt[v][c], have + 1
            out.append(have)
            self.add(c)
            while v and have <= length[link[v]]:  # a state may have been split meanwhile
                v = link[v]
        return out


class Segments:
    """The segments of one chunk: document, start within it, windows, anchor, digest, and whether the anchor's gram recurs."""

    def __init__(self, h: np.ndarray, first: np.ndarray, window: int):
        self._h, self._window = h, window
        count = np.diff(first)
        per = np.maximum(count - window + 1, 0)
        of = np.repeat(np.arange(len(count)), per)
        place = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        at = first[:-1][of] + place
        if not len(at):
            self.of = self.start = self.n = self._word = np.zeros(0, np.int64)
            self.anchor = self.digest = np.zeros(0, np.uint64)
            self.twice = np.zeros(0, bool)
            return
        g = grams(h, GRAM)
        least = window_min(g, window - GRAM + 1)[at]
        begins = np.ones(len(at), bool)
        begins[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
        b = np.flatnonzero(begins)
        run = np.diff(np.concatenate([b, [len(at)]]))
        inside = np.arange(len(at)) - np.repeat(b, run)
        b = np.flatnonzero(inside % SEGMENT == 0)
        n = np.diff(np.concatenate([b, [len(at)]]))
        start = at[b]
        powers, back = _table("word", _WORD_MUL, len(h)), _table("word-back", pow(_WORD_MUL, -1, 1 << 64), len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
        self.digest = mix((total[start + n + window - 1] - total[start]) * back[start] + n.astype(np.uint64))
        span = n + window - GRAM
        ends = np.cumsum(span)
        same = g[np.repeat(start - (ends - span), span) + np.arange(int(ends[-1]))] == np.repeat(least[b], span)
        self.twice = np.add.reduceat(same.astype(np.int64), ends - span) > 1
        self.of, self.start, self.n, self.anchor, self._word = of[b], place[b], n, least[b], start

    def cut(self, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, windows, key, digest, twice); segments of `hot` anchors (sorted) go as single windows."""
        is_hot = np.isin(self.anchor, hot) if len(hot) else np.zeros(len(self.of), bool)
        cold = np.flatnonzero(~is_hot)
        out = [x[cold] for x in (self.of, self.start, self.n, self.anchor, self.digest, self.twice)]
        i = np.flatnonzero(is_hot)
        if len(i):
            n = self.n[i]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(i, n)
            whole = grams(self._h, self._window)[self._word[i] + step]
            more = self.of[i], self.start[i] + step, np.ones(len(i), np.int64), whole, whole, np.zeros(len(i), bool)
            out = [np.concatenate([x, y]) for x, y in zip(out, more, strict=True)]
        return tuple(out)


def _chunks_of(batch: pa.RecordBatch, text: str):
    """(rows, block, words) of chunks of one block each."""
    data, offs = binary_parts(batch.column(text))
    blocks = batch.column("block").to_numpy()
    for block in np.unique(blocks):
        mine = np.flatnonzero(blocks == block)
        flat, cut = some_rows(data, offs, mine)
        for a, b in chunks(cut):
            yield mine[a:b], int(block), flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a]


def _by_block(rows: DataFrame, text: str, take, give, schema: str) -> DataFrame:
    """Run over the rows that have a doc_id: take(state, block, ids, at, data, offsets), and give(block, state) when the block ends."""

    def run(batches):
        have: dict[int, list] = {}
        for batch in batches:
            ids, at = batch.column("doc").to_numpy(), batch.column("at").to_numpy()
            seen = set()
            for mine, block, data, offs in _chunks_of(batch, text):
                state = have.setdefault(block, [])
                take(state, block, ids[mine], at[mine], data, offs)
                seen.add(block)
                if sum(len(x[0]) for x in state) > HELD:
                    yield from give(block, state)
                    state.clear()
            for block in [b for b in have if b not in seen]:
                yield from give(block, have.pop(block))
        for block, state in have.items():
            yield from give(block, state)

    return rows.where("doc is not null").select("block", "at", "doc", text).mapInArrow(run, schema)


def _columns(state: list) -> list[np.ndarray]:
    return [np.concatenate([x[i] for x in state]) for i in range(len(state[0]))]


def repeated_anchors(rows: DataFrame, text: str, window: int) -> str:
    """Files by block: its anchors that occur more than once anywhere, and whether they are hot."""
    width = shuffle_width(rows.sparkSession)

    def take(state, block, ids, at, data, offs):
        w = Words(data, offs)
        s = Segments(w.hashes(), w.first, window)
        state.append((s.anchor, s.digest, s.twice))

    def give(block, state):
        if not state:
            return
        anchor, digest, twice = _columns(state)
        if not len(anchor):
            return
        order = np.lexsort((digest, anchor))
        anchor, digest, twice = anchor[order], digest[order], twice[order]
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = np.flatnonzero(new)
        distinct = np.add.reduceat((new | np.concatenate([[True], digest[1:] != digest[:-1]])).astype(np.int64), first)
        again = (np.diff(np.concatenate([first, [len(anchor)]])) > 1) | (np.add.reduceat(twice.astype(np.int64), first) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(np.full(len(first), block)), pa.array(distinct * 2 + again)], names=["anchor", "block", "n"])

    def meet(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("anchor", "block", "n")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last anchor may go on
            held = [x[cut:].copy() for x in now]
            yield from judge([x[:cut] for x in now])
        if held is not None:
            yield from judge(held)

    def judge(now):
        anchor, block, n = now
        if not len(anchor):
            return
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        many = np.diff(np.concatenate([first, [len(anchor)]]))
        total = np.add.reduceat(n >> 1, first)
        stay = np.repeat((many > 1) | (np.bitwise_or.reduceat(n & 1, first) > 0), many)
        hot = np.repeat(total > HOT_SEGMENTS, many)
        yield pa.RecordBatch.from_arrays([pa.array(block[stay]), pa.array(anchor[stay]), pa.array(hot[stay].astype(np.int64))], names=["block", "anchor", "hot"])

    named = _by_block(rows, text, take, give, "anchor long, block long, n long")
    met = named.repartition(width, "anchor").sortWithinPartitions("anchor").mapInArrow(meet, "block long, anchor long, hot long")
    return write_blocks(met, ["hot", "anchor"], "dedup-anchors")


class Anchors:
    """What repeated_anchors wrote for the block that is being read."""

    def __init__(self, folder: str):
        self._folder, self._block = folder, None

    def of(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(all, hot), sorted."""
        if block != self._block:
            hot, anchor = read_block(self._folder, block, 2)
            anchor = anchor.view(np.uint64)
            self._block, self._all, self._hot = block, np.sort(anchor), np.sort(anchor[hot == 1])
        return self._all, self._hot


def _inside(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def first_segments(rows: DataFrame, text: str, window: int, anchors: str) -> str:
    """Files by block. Kind 0: a segment that occurs again, with the place of the first occurrence of all if it is in
    this block (else -1). Kind 1: the place of a segment whose words are wanted, and its shard."""
    width, known = shuffle_width(rows.sparkSession), Anchors(anchors)

    def take(state, block, ids, at, data, offs):
        w = Words(data, offs)
        s = Segments(w.hashes(), w.first, window)
        every, hot = known.of(block)
        of, start, n, key, digest, twice = s.cut(hot)
        keep = _inside(key, every)
        keep[len(keep) - int((_inside(s.anchor, hot) * s.n).sum()) :] = True  # windows of hot anchors, at the end
        of = of[keep]
        state.append((key[keep], digest[keep], ids[of], at[of], start[keep] * 64 + n[keep], np.ones(len(of), np.int64), twice[keep].astype(np.int64)))

    def give(block, state):
        if not state:
            return
        key, digest, doc, at, place, n, twice = _columns(state)
        if not len(key):
            return
        order = np.lexsort((place, at, doc, digest, key))
        key, digest = key[order], digest[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        own = order[first]
        cols = key[first].view(np.int64), digest[first].view(np.int64), doc[own], np.full(len(first), block), at[own], place[own], count * 2 + twice[own]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    names = ["shard", "segment", "doc", "block", "at", "place", "n"]

    def meet(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[cut:].copy() for x in now]
            yield from judge([x[:cut] for x in now])
        if held is not None:
            yield from judge(held)

    def judge(now):
        shard, segment, doc, block, at, place, n = now
        if not len(shard):
            return
        new = np.concatenate([[True], shard[1:] != shard[:-1]])
        first = np.flatnonzero(new | np.concatenate([[True], segment[1:] != segment[:-1]]))
        many = np.diff(np.concatenate([first, [len(shard)]]))
        again = np.repeat(np.add.reduceat(n >> 1, first) > 1, many)
        here = block == np.repeat(block[first], many)
        first_at, first_place = (np.where(here, np.repeat(x[first], many), -1) for x in (at, place))
        shards = np.flatnonzero(new[first])
        distinct = np.diff(np.concatenate([shards, [len(first)]]))
        own = np.add.reduceat(n[first] & 1, shards) > 0
        wanted = first[np.repeat((distinct > 1) | own, distinct)]
        kind = np.concatenate([np.zeros(int(again.sum()), np.int64), np.ones(len(wanted), np.int64)])
        cols = (block, block), (segment, shard), (first_at, at), (first_place, place)
        out = [np.concatenate([x[again], y[wanted]]) for x, y in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (out[0], kind, *out[1:])], names=["block", "kind", "a", "b", "c"])

    named = _by_block(rows, text, take, give, ", ".join(f"{c} long" for c in names))
    dealt = named.repartition(width, "shard").sortWithinPartitions(*names[:-1])
    return write_blocks(dealt.mapInArrow(meet, "block long, kind long, a long, b long, c long"), ["kind", "a", "b", "c"], "dedup-segments")


def automaton_marks(rows: DataFrame, text: str, window: int, segments: str) -> str:
    """Files by block: row and place (start * 64 + windows) of windows that a shard's automaton had before."""
    width = shuffle_width(rows.sparkSession)

    def words_of(batches):
        now, wanted = None, None
        for batch in batches:
            ids, places = batch.column("doc").to_numpy(), batch.column("at").to_numpy()
            blocks, (data, offs) = batch.column("block").to_numpy(), binary_parts(batch.column(text))
            for block in np.unique(blocks):
                if block != now:
                    kind, shard, at, place = read_block(segments, int(block), 4)
                    one = np.flatnonzero(kind == 1)
                    one = one[np.argsort(at[one], kind="stable")]
                    now, wanted = block, (at[one], shard[one], place[one])
                mine = np.flatnonzero(blocks == block)
                mine = mine[_inside(places[mine], wanted[0])]
                flat, cut = some_rows(data, offs, mine)
                for a, b in chunks(cut):
                    w = Words(flat[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
                    h = w.hashes()
                    out: list[list] = [[] for _ in range(6)]
                    for i in range(a, b):
                        lo, hi = np.searchsorted(wanted[0], [places[mine[i]], places[mine[i]] + 1])
                        base = int(w.first[i - a])
                        for j in range(lo, hi):
                            start, n = divmod(int(wanted[2][j]), 64)
                            row = (wanted[1][j], ids[mine[i]], block, places[mine[i]], wanted[2][j], h[base + start : base + start + n + window - 1].tobytes())
                            for column, value in zip(out, row, strict=True):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(out)], names=names)

    names = ["shard", "doc", "block", "at", "place", "words"]

    def stream(batches):
        shard, automaton = None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for s, block, at, place, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "at", "place", "words")), strict=True):
                if s != shard:
                    shard, automaton = s, SuffixAutomaton()
                got = automaton.stream(np.frombuffer(words, np.uint64).tolist())
                hit = np.concatenate([[False], np.array(got[window - 1 :]) >= window, [False]])
                for a, b in np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2).tolist():
                    for column, value in zip(out, (block, at, (place // 64 + a) * 64 + b - a), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["block", "at", "place"])

    asked = rows.where("doc is not null").select("block", "at", "doc", text).mapInArrow(words_of, "shard long, doc long, block long, at long, place long, words binary")
    ordered = asked.repartition(width, "shard").sortWithinPartitions(*names[:-1])
    return write_blocks(ordered.mapInArrow(stream, "block long, at long, place long"), ["at", "place"], "dedup-marks")


class Marks:
    """The words of a block's documents that go."""

    def __init__(self, window: int, anchors: str, segments: str, marks: str):
        self._window, self._known, self._segments, self._marks, self._block = window, Anchors(anchors), segments, marks, None

    def _read(self, block: int) -> None:
        kind, segment, at, place = read_block(self._segments, block, 4)
        zero = np.flatnonzero(kind == 0)
        segment = segment[zero].view(np.uint64)
        order = np.argsort(segment, kind="stable")
        self._segment, self._first = segment[order], (at[zero][order], place[zero][order])
        self._at, self._place = read_block(self._marks, block, 2)
        self._block = block

    def gone(self, block: int, at: np.ndarray, has_id: np.ndarray, w: Words) -> np.ndarray:
        """For each word of a chunk, whether it goes."""
        if block != self._block:
            self._read(block)
        cover = np.zeros(len(w.start) + 1, np.int64)
        if len(self._segment):
            of, start, n, _, digest, _ = Segments(w.hashes(), w.first, self._window).cut(self._known.of(block)[1])
            i = np.minimum(np.searchsorted(self._segment, digest), len(self._segment) - 1)
            first = (self._first[0][i] == at[of]) & (self._first[1][i] == start * 64 + n)
            hit = (self._segment[i] == digest) & ~first & has_id[of]
            begin = w.first[of[hit]] + start[hit]
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + n[hit] + self._window - 1, -1)
        if len(self._at):
            order = np.argsort(at, kind="stable")
            a, b = np.searchsorted(self._at, [at.min(), at.max() + 1])
            i = np.minimum(np.searchsorted(at[order], self._at[a:b]), len(at) - 1)
            mine = at[order][i] == self._at[a:b]
            begin = w.first[order[i[mine]]] + self._place[a:b][mine] // 64
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + self._place[a:b][mine] % 64 + self._window - 1, -1)
        return np.cumsum(cover[:-1]) > 0


def _joined(data: np.ndarray, w: Words, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each document's words that stay, joined by one space."""
    i = np.flatnonzero(stay)
    n = np.bincount(w.doc[i], minlength=len(w.count))
    size = w.end[i] - w.start[i] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(i) else 0, 32, np.uint8)
    inside = size - 1
    total = int(inside.sum())
    step = np.arange(total) - np.repeat(np.cumsum(inside) - inside, inside)
    out[np.repeat(ends - size, inside) + step] = data[np.repeat(w.start[i], inside) + step]
    last = np.cumsum(n)[n > 0] - 1  # no space behind a document's last word
    keep = np.ones(len(out), bool)
    keep[ends[last] - 1] = False
    bytes_of = np.bincount(w.doc[i], weights=size, minlength=len(w.count)).astype(np.int64) - (n > 0)
    return out[keep], np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int64)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(w: Words, gone: np.ndarray) -> pa.Array:
    """The word ranges that go, by document."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[w.first] = True
    before = np.concatenate([[False], gone[:-1]]) & ~edge[:-1]
    after = np.concatenate([gone[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    of = w.doc[start]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(w.count)))]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(start - w.first[of]), pa.array(end - w.first[of])], fields=list(SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _marked(docs: DataFrame, window: int) -> tuple[DataFrame, dict[str, str], str, str, str, str]:
    """(documents under own names with block, at and doc, names, name of the text, the three folders)."""
    rows, named = with_blocks(docs)
    rows = rows.withColumn("doc", F.col(named["doc_id"]).cast("long"))
    text = named["text"]
    anchors = repeated_anchors(rows, text, window)
    segments = first_segments(rows, text, window, anchors)
    return rows, named, text, anchors, segments, automaton_marks(rows, text, window, segments)


def deduplicate(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (removed word ranges), kept (the words that stay, joined by one space), a row a document."""
    rows, _, text, *folders = _marked(docs.select("doc_id", "text"), window)

    def run(batches):
        marks = Marks(window, *folders)
        for batch in batches:
            ids, at = batch.column("doc"), batch.column("at").to_numpy()
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            for mine, block, data, offs in _chunks_of(batch, text):
                w = Words(data, offs)
                gone = marks.gone(block, at[mine], has_id[mine], w)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine)), pa.array(w.count), _spans(w, gone), _strings(*_joined(data, w, ~gone))], names=["doc_id", "n_words", "spans", "kept"])

    return rows.select("block", "at", "doc", text).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed from `text` (and `n_chars`, where there is one, following it).

    Columns and rows stay, whatever the columns are called; a text that loses nothing keeps its spacing, and a null
    text stays null.
    """
    rows, named, text, *folders = _marked(docs, window)
    fields = [f for f in rows.schema if f.name != "doc"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lost boolean"

    def run(batches):
        marks = Marks(window, *folders)
        for batch in batches:
            at = batch.column("at").to_numpy()
            has_id = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
            names = [f.name for f in fields]
            for mine, block, data, offs in _chunks_of(batch, text):
                w = Words(data, offs)
                gone = marks.gone(block, at[mine], has_id[mine], w)
                part = batch.take(pa.array(mine))
                loses = np.bincount(w.doc[gone], minlength=len(mine)) > 0
                short = np.flatnonzero(loses)
                kept = _strings(*_joined(data, w, ~gone)).take(pa.array(short))
                column = part.column(text)
                if len(short):
                    column = pa.chunked_array([pa.concat_arrays([column.cast(pa.string()), kept])]).take(pa.array(np.where(loses, len(mine) + np.cumsum(loses) - 1, np.arange(len(mine))))).combine_chunks()
                cols = [column if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(loses)], names=[*names, "lost"])

    out = rows.mapInArrow(run, schema)
    if "n_chars" in named:
        n = named["n_chars"]
        out = out.withColumn(n, F.when(F.col("lost"), F.length(text)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return given_names(out, named)
