"""Protobuf code-index files: a bounded reader and writer, and their mapping to facts.

The message layout is the published one: Index {documents = 2}, Document {relative_path = 1, occurrences = 2, symbols = 3},
Occurrence {range = 1, symbol = 2, symbol_roles = 3, single_line_range = 8, multi_line_range = 9}, SymbolInformation {symbol = 1,
relationships = 4, display_name = 6}, Relationship {symbol = 1, is_reference = 2, is_implementation = 3, is_type_definition = 4,
is_definition = 5}; the index's external_symbols = 3. A range stands in field 1 as three or four numbers, or typed in field 8
{line = 1, start = 2, end = 3} or 9 {start line = 1, start = 2, end line = 3, end = 4}; a typed one that is not all zero wins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the reader: bytes of a file and of a text, and numbers of a range.
MAX_BYTES, MAX_TEXT, MAX_RANGE = 256 << 20, 1 << 20, 4
#: Roles of an occurrence, as bits.
DEFINITION, IMPORT = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number that does not end")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; what has no known type is skipped by its wire type."""
    at, end = 0, len(data)
    while at < end:
        tag = data[at]  # numbers of one byte are read in place
        if tag < 128:
            at += 1
        else:
            tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0 or wire == 2:
            if at < end and data[at] < 128:
                value = data[at]
                at += 1
            else:
                value, at = _varint(data, at)
            if wire == 2:
                start, at = at, at + value
                if at > end:
                    raise ValueError("a field past the end")
                value = data[start:at]
            yield tag >> 3, value
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
            if at > end:
                raise ValueError("a field past the end")
        else:
            raise ValueError(f"wire type {wire}")


def _text(value: bytes) -> str:
    if len(value) > MAX_TEXT:
        raise ValueError("a text beyond the bound")
    return value.decode("utf-8", "replace")


def _range(parts: list) -> tuple[int, int, int, int] | None:
    """Three numbers (one line) or four, packed or one by one."""
    numbers: list[int] = []
    for p in parts:
        if isinstance(p, int):
            numbers.append(p)
        else:
            at = 0
            while at < len(p):
                n, at = _varint(p, at)
                numbers.append(n)
    if len(numbers) == 3:
        return numbers[0], numbers[1], numbers[0], numbers[2]
    return tuple(numbers) if len(numbers) == MAX_RANGE else None


def _typed_range(body: bytes, one_line: bool) -> tuple[int, int, int, int]:
    """A range of field 8 (one line) or 9; absent numbers are 0."""
    at = {n: v for n, v in fields(body) if isinstance(v, int)}
    if one_line:
        return at.get(1, 0), at.get(2, 0), at.get(1, 0), at.get(3, 0)
    return at.get(1, 0), at.get(2, 0), at.get(3, 0), at.get(4, 0)


def _symbol(body: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """symbol, name, [(other, kind)] of a SymbolInformation."""
    symbol, name, related = "", "", []
    for k, x in fields(body):
        if k == 1:
            symbol = _text(x)
        elif k == 6:
            name = _text(x)
        elif k == 4:
            flags = dict(fields(x))
            related += [(_text(flags.get(1, b"")), kind) for flag, kind in ((3, "IMPLEMENTS"), (4, "TYPE_DEFINITION"), (5, "DEFINED_BY")) if flags.get(flag)]
    return symbol, name, related


def external_symbols(data: bytes) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """symbol, name, [(other, kind)] of the symbols that an index names and does not define."""
    if len(data) > MAX_BYTES:
        raise ValueError("an index beyond the bound")
    for number, body in fields(data):
        if number == 3 and not isinstance(body, int):
            yield _symbol(body)


def decode_index(data: bytes) -> Iterator[dict]:
    """path, occurrences [(range, symbol, roles)], symbols [(symbol, name, [(other, kind)])] of each document."""
    if len(data) > MAX_BYTES:
        raise ValueError("an index beyond the bound")
    for number, body in fields(data):
        if number != 2 or isinstance(body, int):
            continue
        doc: dict = {"path": "", "occurrences": [], "symbols": []}
        for n, v in fields(body):
            if n == 1:
                doc["path"] = _text(v)
            elif n == 2:
                spans, typed, symbol, roles = [], None, "", 0
                for k, x in fields(v):
                    if k == 1:
                        spans.append(x)
                    elif k == 2:
                        symbol = _text(x)
                    elif k == 3:
                        roles = x
                    elif k in (8, 9) and not isinstance(x, int):
                        typed = _typed_range(x, k == 8)
                doc["occurrences"].append((typed if typed and any(typed) or typed and not spans else _range(spans), symbol, roles))
            elif n == 3:
                doc["symbols"].append(_symbol(v))
        yield doc


_ONE_BYTE = [bytes([n]) for n in range(128)]


def _number(n: int) -> bytes:
    if n < 128:
        return _ONE_BYTE[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def encode_index(documents: list[dict], form: str = "packed", external: list[tuple] = ()) -> bytes:
    """The inverse of decode_index and external_symbols. Ranges are written `packed` or `plain` (one by one) in field 1, on one
    line with three numbers, or `typed` in fields 8 and 9."""

    def information(symbol: str, name: str, related: list[tuple[str, str]]) -> bytes:
        flag = {"IMPLEMENTS": 3, "TYPE_DEFINITION": 4, "DEFINED_BY": 5}
        return _put(1, symbol.encode()) + b"".join(_put(4, _put(1, s.encode()) + _put(flag[k], 1)) for s, k in related) + _put(6, name.encode())

    def range_of(span: tuple) -> bytes:
        one_line = span[0] == span[2]
        numbers = [span[0], span[1], span[3]] if one_line else list(span)
        if form == "typed":
            return _put(8 if one_line else 9, b"".join(_put(i + 1, n) for i, n in enumerate(numbers)))
        if form == "plain":
            return b"".join(_put(1, n) for n in numbers)
        return _put(1, b"".join(map(_number, numbers)))

    out = []
    for doc in documents:
        body = [_put(1, doc["path"].encode())]
        body += [_put(2, range_of(span) + _put(2, symbol.encode()) + (_put(3, roles) if roles else b"")) for span, symbol, roles in doc["occurrences"]]
        body += [_put(3, information(*s)) for s in doc["symbols"]]
        out.append(_put(2, b"".join(body)))
    return b"".join(out) + b"".join(_put(3, information(*s)) for s in external)


DOCUMENT = "path string, occurrences array<struct<start_line: long, start_char: long, end_line: long, end_char: long, symbol: string, roles: long>>, symbols array<struct<symbol: string, name: string, related: array<struct<symbol: string, kind: string>>>>"


_SPAN = ("start_line", "start_char", "end_line", "end_char")
_RELATED = pa.struct([("symbol", pa.string()), ("kind", pa.string())])
_SYMBOL = pa.struct([("symbol", pa.string()), ("name", pa.string()), ("related", pa.list_(_RELATED))])
#: Bytes of the files that are decoded at once (a longer file is alone).
BATCH = 1 << 21


def _batch(docs: list[dict]) -> pa.RecordBatch:
    """DOCUMENT rows, built by column."""
    flat = [o for doc in docs for o in doc["occurrences"]]
    ends = list(itertools.accumulate((len(doc["occurrences"]) for doc in docs), initial=0))
    spans = [r or (None,) * 4 for r, _, _ in flat]
    columns = [pa.array([r[i] for r in spans], pa.int64()) for i in range(4)] + [pa.array([s for _, s, _ in flat], pa.string()), pa.array([k for _, _, k in flat], pa.int64())]
    occurrences = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [*_SPAN, "symbol", "roles"]))
    symbols = [[{"symbol": s, "name": n, "related": [{"symbol": a, "kind": b} for a, b in rel]} for s, n, rel in doc["symbols"]] for doc in docs]
    return pa.RecordBatch.from_arrays([pa.array([doc["path"] for doc in docs], pa.string()), occurrences, pa.array(symbols, pa.list_(_SYMBOL))], ["path", "occurrences", "symbols"])


class Unusual(Exception):
    """What the lockstep reader leaves to the plain one, errors among it."""


def _read_varints(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that begin at some places of `buf` (zeros follow its end), and the places behind them."""
    value = buf[at].astype(np.int64)
    at = at + 1
    more = np.flatnonzero(value > 127)
    value[more] &= 127
    shift = 7
    while len(more):
        if shift > 56:
            raise Unusual
        b = buf[at[more]].astype(np.int64)
        at[more] += 1
        value[more] |= (b & 127) << shift
        more = more[b > 127]
        shift += 7
    return value, at


#: Fields of a few long messages that are read in lockstep at most; longer ones are left to the plain reader.
FEW, LONG = 16, 512


def _read_fields(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Fields of many messages in lockstep, the first of all, then the second of all: (message, number, is text, value or start, end)."""
    live = np.flatnonzero(start < end)
    at, end = start[live], end[live]
    rounds = 0
    while len(live):
        rounds += 1
        if rounds > LONG and len(live) < FEW:
            raise Unusual
        tag, at = _read_varints(buf, at)
        wire = tag & 7
        if ((wire != 0) & (wire != 2)).any():
            raise Unusual
        value, at = _read_varints(buf, at)
        text = wire == 2
        if (text & (value > MAX_BYTES)).any():
            raise Unusual
        begin = np.where(text, at, value)
        at = np.where(text, at + value, at)
        if (at > end).any():
            raise Unusual
        yield live, tag >> 3, text, begin, at
        going = at < end
        live, at, end = live[going], at[going], end[going]


def _some_fields(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """All that _read_fields gives, by message and place."""
    got = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 2, *_read_fields(buf, start, end)]
    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _text_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    if (size > MAX_TEXT).any():
        raise Unusual
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = buf[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    try:
        return out.cast(pa.string())  # checks it
    except pa.ArrowInvalid:
        raise Unusual from None


def _last(n: int, of: np.ndarray, value: np.ndarray, default: int = 0) -> np.ndarray:
    out = np.full(n, default, np.int64)
    out[of] = value  # of equal places the last one stays
    return out


def _ranges(buf: np.ndarray, n: int, fields: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The four numbers of each occurrence, and whether it has none."""
    of, number, text, begin, end = fields
    plain = (number == 1) & ~text
    packed = np.flatnonzero((number == 1) & text)
    if (begin[packed] == end[packed]).any():
        raise Unusual
    if len(packed) and (plain.any() or (np.bincount(of[packed], minlength=n) > 1).any()):
        if (np.bincount(of[number == 1], minlength=n)[of[packed]] > 1).any():
            raise Unusual  # a range in several parts
    owner, place, value = [of[plain]], [np.flatnonzero(plain)], [begin[plain]]
    live, at, stop = of[packed], begin[packed], end[packed]
    step = 0
    while len(live):
        going = at < stop
        live, at, stop = live[going], at[going], stop[going]
        if not len(live):
            break
        if step == 5:
            raise Unusual
        v, at = _read_varints(buf, at)
        if (at > stop).any():
            raise Unusual
        owner.append(live)
        place.append(np.full(len(live), step))
        value.append(v)
        step += 1
    owner, place, value = (np.concatenate(x) for x in (owner, place, value))
    order = np.lexsort((place, owner))
    owner, value = owner[order], value[order]
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    get = lambda k: np.where(count > k, value[np.minimum(first + k, max(len(value) - 1, 0))] if len(value) else 0, 0)
    a, b, c, d = (get(k) for k in range(4))
    span = [a, b, np.where(count == 3, a, c), np.where(count == 3, c, d)]
    none = (count != 3) & (count != 4)
    for kind in (8, 9):
        at = np.flatnonzero((number == kind) & text)
        if not len(at):
            continue
        owners = of[at]
        if (np.bincount(of[((number == 8) | (number == 9)) & text], minlength=n) > 1).any():
            raise Unusual
        sub, k, is_text, v, _ = _some_fields(buf, begin[at], end[at])
        keep = ~is_text
        part = [_last(len(at), sub[keep & (k == i)], v[keep & (k == i)]) for i in range(1, 5)]
        typed = [part[0], part[1], part[0], part[2]] if kind == 8 else part
        use = (np.stack(typed) != 0).any(0) | (count[owners] == 0)
        for s, t in zip(span, typed, strict=True):
            s[owners[use]] = t[use]
        none[owners[use]] = False
    return span, none


def _lockstep(files: list[bytes]) -> tuple[pa.RecordBatch, list[tuple]]:
    """DOCUMENT rows of index files, their occurrences read side by side; and their external symbols."""
    size = np.array([len(f) for f in files], np.int64)
    if (size > MAX_BYTES).any():
        raise Unusual
    buf = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    stop = np.cumsum(size)
    _, number, text, begin, end = _some_fields(buf, stop - size, stop)
    at = (number == 3) & text
    external = [_symbol(bytes(buf.data[a:b])) for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
    doc = (number == 2) & text
    begin, end = begin[doc], end[doc]
    n = len(begin)
    of, number, text, begin, end = _some_fields(buf, begin, end)
    if (~text & (number < 4) & (number > 0)).any():
        raise Unusual
    at = number == 1
    paths = _text_array(buf, _last(n, of[at], begin[at]), _last(n, of[at], end[at]))
    at = number == 3
    symbols: list[list] = [[] for _ in range(n)]
    raw = buf.data
    for i, a, b in zip(of[at].tolist(), begin[at].tolist(), end[at].tolist(), strict=True):
        s, name, related = _symbol(bytes(raw[a:b]))
        symbols[i].append({"symbol": s, "name": name, "related": [{"symbol": x, "kind": y} for x, y in related]})
    at = number == 2
    count = np.bincount(of[at], minlength=n)
    m = int(count.sum())
    fields_ = _some_fields(buf, begin[at], end[at])
    of, number, text, begin, end = fields_
    if ((number == 2) & ~text | (number == 3) & text).any():
        raise Unusual
    span, none = _ranges(buf, m, fields_)
    at = number == 2
    names = _text_array(buf, _last(m, of[at], begin[at]), _last(m, of[at], end[at]))
    roles = _last(m, of[number == 3], begin[number == 3])
    columns = [pa.array(s, pa.int64(), mask=none) for s in span] + [names, pa.array(roles)]
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    occurrences = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, [*_SPAN, "symbol", "roles"]))
    return pa.RecordBatch.from_arrays([paths, occurrences, pa.array(symbols, pa.list_(_SYMBOL))], ["path", "occurrences", "symbols"]), external


def lockstep(files: list[bytes]) -> tuple[pa.RecordBatch, list[tuple]]:
    """DOCUMENT rows and external symbols of index files; Unusual where only the plain reader takes one of them."""
    try:
        return _lockstep(files)
    except (IndexError, TypeError, ValueError, pa.ArrowException) as e:
        raise Unusual from e


def decoded_batch(files: list[bytes]) -> pa.RecordBatch:
    """DOCUMENT rows of index files: in lockstep, or one by one where a file is unusual or broken."""
    try:
        return lockstep(files)[0]
    except Unusual:
        return _batch([doc for data in files for doc in decode_index(data)])


def decoded(indexes: DataFrame) -> DataFrame:
    """DOCUMENT rows of index files (content binary); an occurrence without a valid range has none."""

    def run(batches):
        files, held = [], 0
        for batch in batches:
            for data in batch.column("content"):
                files.append(data.as_py() or b"")
                held += len(files[-1])
                if held >= BATCH:
                    yield decoded_batch(files)
                    files, held = [], 0
        if files:
            yield decoded_batch(files)

    return indexes.select("content").mapInArrow(run, DOCUMENT)


def canonical_key(path: Column, raw: Column) -> Column:
    """A global symbol's key, or one that names the document for a local symbol."""
    return F.when(raw.startswith("local "), F.concat(F.lit("scip-local:"), path, F.lit(":"), raw)).otherwise(F.concat(F.lit("scip:"), raw))


def map_documents(documents: DataFrame) -> DataFrame:
    """path, record (symbol or relation), type, source, target, confidence of decoded documents.

    All records of a document are made from it at once: a branch for each kind would decode every file again.
    """
    path, none = F.col("path"), F.lit(None).cast("string")
    row = lambda record, kind, source, target: F.struct(F.lit(record).alias("record"), kind.alias("type"), source.alias("source"), target.alias("target"))
    has = lambda o, role: F.coalesce(o["roles"].bitwiseAND(role) != 0, F.lit(False))
    key = lambda x: canonical_key(path, x["symbol"])
    only = lambda when, x: F.when(when, x)
    of = F.transform("occurrences", lambda o: F.array(
        only(has(o, DEFINITION), row("symbol", F.lit("definition"), key(o), none)), row("relation", F.lit("REFERENCES"), path, key(o)), only(has(o, IMPORT), row("relation", F.lit("IMPORTS"), path, key(o)))))
    related = F.transform("symbols", lambda s: F.transform(s["related"], lambda r: row("relation", r["kind"], key(s), key(r))))
    every = F.concat(F.flatten(of), F.flatten(related))
    return documents.select("path", F.explode(every).alias("r")).where("r IS NOT NULL").select("path", "r.*", F.lit(0.97).alias("confidence"))


def document_digest(documents: DataFrame) -> DataFrame:
    """path, digest: the same for any order of occurrences and symbols."""
    occ = F.transform("occurrences", lambda o: F.concat_ws(":", o["start_line"], o["start_char"], o["end_line"], o["end_char"], o["symbol"], o["roles"]))
    sym = F.transform("symbols", lambda s: F.concat_ws(":", s["symbol"], s["name"], F.array_join(F.array_sort(F.transform(s["related"], lambda r: F.concat_ws(">", r["kind"], r["symbol"]))), ",")))
    body = F.concat(F.array_join(F.array_sort(occ), "\n"), F.lit("\u001f"), F.array_join(F.array_sort(sym), "\n"))
    return documents.select("path", F.sha2(body, 256).alias("digest"))
