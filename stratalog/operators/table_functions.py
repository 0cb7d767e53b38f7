"""Extractors in SQL: Python table functions that take a TABLE argument.

    SELECT * FROM index_records(TABLE(SELECT content FROM indexes))
    SELECT * FROM file_facts(TABLE(SELECT path, content FROM files))

A row of the argument gives any number of rows. A null content gives none; one that can't be decoded gives one row `error`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..session import ship_package
from . import extractors, scip

INDEX_RECORDS = "record string, path string, symbol string, name string, start_line long, start_char long, end_line long, end_char long, roles long, other string, kind string"
_RECORDS = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in INDEX_RECORDS.split(", ")])
FILE_FACTS = "path string, record string, kind string, name string, start_byte long, end_byte long, confidence double"


class IndexRecords:
    """occurrence, symbol, related and external rows of code-index files (content), which come in Arrow batches."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files, held = [], 0
        for data in batch.column("content"):
            if data.is_valid:
                files.append(data.as_py())
                held += len(files[-1])
            if held >= scip.BATCH:
                yield from self._records(files)
                files, held = [], 0
        yield from self._records(files)

    def _records(self, files: list[bytes]) -> Iterator[pa.RecordBatch]:
        try:
            docs, external = scip.lockstep(files)
        except scip.Unusual:  # one by one: only the broken ones give an error
            yield self._batch([row for data in files for row in self._file(data)])
            return
        occurrences, rows = docs.column("occurrences"), []
        per = np.diff(occurrences.offsets.to_numpy())
        flat = occurrences.values
        n = len(flat)
        none = pa.nulls(n, pa.string())
        path = docs.column("path").take(pa.array(np.repeat(np.arange(len(per)), per)))
        at = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        yield pa.RecordBatch.from_arrays([pa.repeat("occurrence", n), path, at["symbol"], none, *[at[c] for c in scip._SPAN], at["roles"], none, none], schema=_RECORDS)
        for path, symbols in zip(docs.column("path").to_pylist(), docs.column("symbols").to_pylist(), strict=True):
            for x in symbols:
                rows += self._symbol("symbol", path, x["symbol"], x["name"], [(r["symbol"], r["kind"]) for r in x["related"]])
        rows += [row for x in external for row in self._symbol("external", None, *x)]
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(_RECORDS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)

    def _file(self, data: bytes) -> list[tuple]:
        try:
            return list(self._rows(data))
        except ValueError as e:
            return [("error", None, None, str(e), *[None] * 7)]

    @staticmethod
    def _symbol(record: str, path: str | None, symbol: str, name: str, related: list[tuple[str, str]]) -> Iterator[tuple]:
        none = (None,) * 5
        yield (record, path, symbol, name, *none, None, None)
        for other, kind in related:
            yield ("related", path, symbol, name, *none, other, kind)

    def _rows(self, data: bytes) -> Iterator[tuple]:
        none = (None,) * 4
        for doc in scip.decode_index(data):
            for span, symbol, roles in doc["occurrences"]:
                yield ("occurrence", doc["path"], symbol, None, *(span or none), roles, None, None)
            for x in doc["symbols"]:
                yield from self._symbol("symbol", doc["path"], *x)
        for x in scip.external_symbols(data):
            yield from self._symbol("external", None, *x)


class FileFacts:
    """Symbols, relationships and diagnostics of files (path, content), by their names' endings."""

    def eval(self, row: Row) -> Iterator[tuple]:
        content = row["content"]
        if content is None:
            return
        data = content.encode() if isinstance(content, str) else bytes(content)
        for record, kind, name, _, start, end, confidence in extractors.scan(row["path"] or "", data):
            yield row["path"], record, kind, name, start, end, confidence


def register(spark: SparkSession) -> SparkSession:
    """Make index_records and file_facts known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("index_records", arrow_udtf(IndexRecords, returnType=INDEX_RECORDS))
    spark.udtf.register("file_facts", udtf(FileFacts, returnType=FILE_FACTS))
    return spark
