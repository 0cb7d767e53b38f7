"""Token counts of fields and sections by offset mapping.

A document is its fields joined by line feeds and encoded once as a whole, so no section changes how its neighbours
are cut. Sections are the fields; the last field is cut further into its lines, each with its line feed. Token byte
lengths give every token's span, and an interval join (binary search on the sorted section bounds) gives its section.

A token that crosses a bound belongs to one section by `rule`: `start` (that of its first byte), `end` (of its last)
or `majority` (of most of its bytes; equal parts: the earliest). Counts of a document's sections sum to its tokens.
Null fields are empty; a document without any text has empty sections with no tokens beyond the joining line feeds.
Bytes that are not UTF-8 count as the replacement character, before anything is measured. Very long texts are encoded
whole. Every row is counted by itself, whatever its doc_id; equal rows get equal counts. Empty tables give empty
results. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts

RULES = ("start", "end", "majority")

_loaded: dict[str, tuple] = {}


def byte_encoder(path: str):
    """(encoding, bytes of each id) of a tiktoken rank file; one per worker process."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _loaded[path]


def allocate(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a bound); bounds: the sections' first bytes, ascending from 0."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, token_ends - 1, side="right") - 1
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    out = first.copy()
    for t in np.flatnonzero(crosses):
        inner = np.concatenate([[starts[t]], bounds[first[t] + 1 : last[t] + 1], [token_ends[t]]])
        out[t] = first[t] + int(np.argmax(np.diff(inner)))
    return out, crosses


def count_sections(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "majority") -> DataFrame:
    """doc_id, n_tokens, sections: array<struct<field, line, char_start, char_end, n_tokens, n_crossing>>."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    section = pa.struct([("field", pa.string()), ("line", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def run(batches):
        enc, sizes = byte_encoder(tokenizer)
        for batch in batches:
            counts, offsets, cols = [], [0], [[] for _ in range(6)]
            parts = [binary_parts(batch.column(f"f{i}")) for i in range(len(fields))]
            for d in range(batch.num_rows):
                raw = [data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace").encode() for data, offs in parts]
                body = b"\n".join(raw)
                ids = np.array(enc.encode_ordinary(body.decode()), np.int64)
                flat = np.frombuffer(body, np.uint8)
                head = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
                lines = head[-1] + np.flatnonzero(flat[head[-1] :] == 10) + 1
                bounds = np.concatenate([head, lines[lines < len(flat)]])
                own, crosses = allocate(np.cumsum(sizes[ids]), bounds, rule)
                chars = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
                cuts = chars[np.minimum(np.concatenate([bounds, [len(flat)]]), len(flat))]
                n, k = len(bounds), len(fields)
                cols[0] += [*fields[:-1], *[fields[-1]] * (n - k + 1)]
                cols[1].append(np.concatenate([np.zeros(k - 1, np.int64), np.arange(n - k + 1)]))
                cols[2].append(cuts[:-1])
                cols[3].append(cuts[1:])
                cols[4].append(np.bincount(own, minlength=n))
                cols[5].append(np.bincount(own[crosses], minlength=n))
                counts.append(len(ids))
                offsets.append(offsets[-1] + n)
            values = pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols[1:])], fields=list(section))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "n_tokens", "sections"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).cast("binary").alias(f"f{i}") for i, f in enumerate(fields)])
    schema = "doc_id long, n_tokens long, sections array<struct<field: string, line: long, char_start: long, char_end: long, n_tokens: long, n_crossing: long>>"
    return rows.mapInArrow(run, schema)
