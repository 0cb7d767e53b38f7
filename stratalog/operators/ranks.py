"""Exact nearest ranks of groups of any size, by radix refinement.

A value becomes a 64-bit key whose signed order is the values' order. Equal values of a group are counted first, so a value
repeated any number of times is one row. Then the group's rank is narrowed by DIGIT bits at a time: counts by leading bits say
which bucket holds the rank, and only that bucket's rows are counted by the next bits. No task holds a group, and no hash map
all of its values.

The nearest rank of a share p of n values is the ceil(p n)-th, the first for p = 0. Nulls don't count; a group of nulls only
has no row; NaN is the greatest value, and -0.0 equals 0.0.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

DIGIT = 16
#: Asked ranks that are broadcast to the counts; more are joined by a shuffle.
BROADCAST_RANKS = 50_000
_FLIP = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def _keys(values: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits)


def _with_keys(rows: DataFrame, groups: list[str]) -> DataFrame:
    """groups, key of rows (groups, value): longs are their own keys."""
    if rows.schema["value"].dataType.typeName() != "double":
        return rows.select(*groups, F.col("value").cast("long").alias("key"))
    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)

    def run(batches):
        for b in batches:
            keys = pa.array(_keys(b.column("value").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*(b.column(g) for g in groups), keys], names=[*groups, "key"])

    return rows.mapInArrow(run, f"{kinds}, key long")


def _values(found: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """The doubles of key columns."""
    names = [*groups, *columns]
    kinds = ", ".join([f"`{g}` {found.schema[g].dataType.simpleString()}" for g in groups] + [f"`{c}` double" for c in columns])

    def run(batches):
        for b in batches:
            keys = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            back = [pa.array(np.where(k < 0, k ^ _FLIP, k).view(np.float64)) for k in keys]
            yield pa.RecordBatch.from_arrays([*(b.column(g) for g in groups), *back], names=names)

    return found.select(*names).mapInArrow(run, kinds)


def nearest_ranks(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups and a column for each share: the nearest rank of `value` (a whole number or double)."""
    double = rows.schema[value].dataType.typeName() in ("double", "float")
    named = {g: f"g{i}" for i, g in enumerate(groups)}
    keys = list(named.values())
    v = F.col(value).cast("double") if double else F.col(value)
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(g).alias(n) for g, n in named.items()], v.alias("value"))
    distinct = cut(_with_keys(rows, keys).groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n")), "ranks")
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]

    total = distinct.groupBy(*keys).agg(F.sum("n").alias("total"))
    exact = {name: Decimal(repr(p)) for name, p in shares.items()}
    wanted = [F.struct(F.lit(name).alias("share"), F.greatest(F.ceil(F.lit(p) * F.col("total").cast("decimal(20,0)")).cast("long"), F.lit(1)).alias("rank")) for name, p in exact.items()]
    asked = total.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*[F.col(k).alias(f"a_{k}") for k in keys], "w.share", "w.rank", F.lit(None).cast("long").alias("prefix"))
    asked = cut(asked, "ranks-asked")
    small = asked.count() <= BROADCAST_RANKS
    for shift in range(64 - DIGIT, -1, -DIGIT):
        at = F.shiftright("key", shift)
        on = [F.col(f"a_{k}").eqNullSafe(F.col(k)) for k in keys]
        if shift + DIGIT < 64:
            on.append(F.col("prefix") == F.shiftright("key", shift + DIGIT))
        hit = distinct.join(F.broadcast(asked) if small else asked, on)
        of = [f"a_{k}" for k in keys] + ["share", "rank"]
        counts = hit.groupBy(*of, at.alias("bucket")).agg(F.sum("n").alias("n"))  # 2^DIGIT buckets at most
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        asked = cut(found.select(*[f"a_{k}" for k in keys], "share", (F.col("rank") - F.col("before")).alias("rank"), F.col("bucket").alias("prefix")), "ranks-asked")
    one = [F.max(F.when(F.col("share") == name, F.col("prefix"))).alias(f"s{i}") for i, name in enumerate(shares)]
    wide = asked.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys]).agg(*one)
    if double:
        wide = _values(wide, keys, [f"s{i}" for i in range(len(shares))])
    return wide.select(*[F.col(n).alias(g) for g, n in named.items()], *[F.col(f"s{i}").alias(name) for i, name in enumerate(shares)])
