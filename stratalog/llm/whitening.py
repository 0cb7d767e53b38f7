"""Whitening of embeddings: MLlib's RowMatrix over exactly centred rows, a local eigh, broadcast whitening.

An entry c becomes the long x = floor(scale * c) + shift. With n rows and their sums S, the rows n * x - S are centred without
any rounding (longs, exact as doubles below 2^53). computeGramianMatrix of those, divided by n (and by n^2 for the factor n
of the rows), is the covariance V; its eigenvectors are found on the driver (dimensions squared, whatever the rows are) and
go to the tasks as a broadcast. The covariance of what comes out is taken from the written rows, centred first.

Defined cases. Vectors that are null or hold null, NaN or infinite entries are left out; so are those of another length than
the most frequent one (the greater of equally frequent ones), and empty ones. Null and repeated ids and repeated rows are
rows like any other. Components whose eigenvalue is not above LEAST of the first are directions without spread, which can't
be whitened: there are as many components as the rest, none for a single row, equal rows or an empty table, which give no
rows. The sign of a component is that which makes its entry of the greatest size positive. An entry too great for a long
after scaling is an error. Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Eigenvalues up to this share of the first are rounding.
LEAST = 1e-12
_OUT = "id {id}, n long, deviation decimal(38,0), whitened array<double>"


def quantised(table: DataFrame, key: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """(rows `id`, `x` array<long> of the vectors that count, their length)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = table.select(F.col(f"`{key}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    x = F.transform("v", lambda e: F.floor(F.lit(float(scale)) * e) + F.lit(shift).cast("long"))
    rows = stored(rows.select("id", x.alias("x")), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows, 0) if common is None else (rows.where(F.size("x") == common.d), common.d)


def _matrix(column: pa.Array, d: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, d)


def sums(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """Sums of an array column's entries, by place: partial sums of each batch, added by Spark; exact for longs."""
    kind = rows.schema[column].dataType.elementType.simpleString()
    as_numpy = np.int64 if kind == "bigint" else np.float64

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"place": pa.array(range(d), pa.int32()), "s": pa.array(_matrix(b.column(0), d, as_numpy).sum(0))})

    total = rows.select(column).mapInArrow(run, f"place int, s {kind}").groupBy("place").agg(F.sum("s").alias("s"))
    found = {r.place: r.s for r in total.collect()}  # one number for each dimension
    return np.array([found[i] for i in range(d)], as_numpy)


def covariance(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of the long arrays `x` whose sums are `total`."""
    d = len(total)
    centred = F.zip_with("x", F.lit(total.tolist()).cast("array<bigint>"), lambda a, s: (F.lit(n).cast("long") * a - s).cast("double"))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("z")), "z")
    gram = RowMatrix(vectors, n, d).computeGramianMatrix().toArray()
    return gram / n / float(n) / float(n)


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns), those with spread, `most` at most."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    keep = values > max(LEAST * values[0], 0.0)
    values, vectors = values[keep], vectors[:, keep]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])


def _squares(z: np.ndarray) -> list[Decimal]:
    """Exact sums of squares by row; beyond 64 bits with Python's integers."""
    if (z.astype(np.float64) ** 2).sum(1).max(initial=0) < 9e18:
        return [Decimal(s) for s in (z * z).sum(1).tolist()]
    return [Decimal(sum(e * e for e in row)) for row in z.tolist()]


def whiten(spark: SparkSession, table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """id, n, deviation decimal(38,0) (exact sum of (n * x - S)^2), whitened (array), explained (array), identity_error."""
    rows, d = quantised(table, key, vector, scale, shift)
    kind = rows.schema["id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"{_OUT.format(id=kind)}, explained array<double>, identity_error double")
    n = rows.count()
    if not n:
        return nothing
    total = sums(rows, "x", d)
    v = covariance(rows, n, total)
    values, vectors = principal(v, components)
    if not len(values):
        return nothing
    shared = spark.sparkContext.broadcast((n, total, vectors / np.sqrt(values) / n))  # dimensions times components

    def run(frames):
        n, total, to_white = shared.value
        for f in frames:
            z = n * np.stack(f["x"].to_numpy()) - total if len(f) else np.zeros((0, len(total)), np.int64)
            yield pd.DataFrame({"id": f["id"], "n": n, "deviation": _squares(z), "whitened": list(z.astype(np.float64) @ to_white)})

    white = stored(rows.mapInPandas(run, _OUT.format(id=kind)), "whitening-white")
    error = identity_error(white, n, len(values))
    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    return white.withColumns({"explained": explained, "identity_error": F.lit(error)})


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The greatest absolute entry of the rows' covariance less the identity; rows are centred before they are multiplied."""
    mean = sums(white, "whitened", k) / n

    def run(batches):
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column(0), k, np.float64) - mean
                yield pa.RecordBatch.from_pydict({"p": pa.array([(z.T @ z).ravel()], pa.list_(pa.float64()))})

    products = sums(white.select("whitened").mapInArrow(run, "p array<double>"), "p", k * k).reshape(k, k)
    return float(np.abs(products / n - np.eye(k)).max())
