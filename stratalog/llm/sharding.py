"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each node every child draws -ln(u) / weight, with u from a hash of
the key and the child's path, and the least draw wins (equal draws: the earlier child). A child's chance is its share
of the weight, and a change of one weight moves keys only into or out of the subtree it lies in: draws of the other
children stay. A new shard opens a region of its own (`Topology.grow`), so it takes rows only into itself.

Nulls: a null doc_id is a key like any other (the empty string); a null text has no bytes and checksum 0. Repeated rows
and repeated doc_ids go to one shard, each row with a slot of its own; ties in the order of slots fall either way. Very
long texts are only measured. Empty tables give empty results. `place` keeps every column of its input (one that has the
name asked for gives way), `shard_documents` gives the listed ones only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, salts_for

#: Hex digits of the hash that make u; 2^48 values are exact in a double.
_DIGITS = 12


@dataclass(frozen=True)
class Topology:
    """weights[region][rack] = weights of the rack's shards; shards are numbered in this order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def uniform(cls, regions: int = 3, racks: int = 2, shards: int = 4) -> Topology:
        return cls(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    @property
    def size(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    def grow(self, weight: float = 1.0) -> Topology:
        return Topology((*self.weights, ((weight,),)))

    def reweight(self, shard: int, weight: float) -> Topology:
        out, n = [], 0
        for region in self.weights:
            racks = []
            for rack in region:
                racks.append(tuple(weight if n + i == shard else w for i, w in enumerate(rack)))
                n += len(rack)
            out.append(tuple(racks))
        return Topology(tuple(out))


def _table(values, kind: str) -> Column:
    """A nested literal, folded once at planning."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _winner(key: Column, path: Column, weights: Column) -> Column:
    """Index of the child with the least draw among the weights of a node's children; those without weight take none."""

    def draw(w: Column, i: Column) -> Column:
        digest = F.substring(F.md5(F.concat(key, path, F.lit("/"), i.cast("string"))), 1, _DIGITS)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        return F.struct(F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf"))).alias("draw"), i.alias("child"))

    return F.when(F.size(weights) == 1, F.lit(0)).otherwise(F.array_min(F.transform(weights, draw))["child"])


def place(df: DataFrame, key: Column, topology: Topology, out: str) -> DataFrame:
    """Add `out`, the shard of `key`. One projection a level, so that a row is hashed along its own path only."""
    t = topology.weights
    first, n = [], 0
    for region in t:
        first.append([])
        for rack in region:
            first[-1].append(n)
            n += len(rack)
    by_region = _table([sum(map(sum, region)) for region in t], "array<double>")
    by_rack = _table([[sum(rack) for rack in region] for region in t], "array<array<double>>")
    by_shard, begins = _table(t, "array<array<array<double>>>"), _table(first, "array<array<int>>")
    mine, region, rack = (_free(df, name) for name in ("key", "region", "rack"))
    ref = lambda name: F.col(f"`{name}`")
    df = df.withColumn(mine, F.coalesce(key.cast("string"), F.lit("")))
    df = df.withColumn(region, _winner(ref(mine), F.lit(""), by_region))
    at = F.concat(F.lit("/"), ref(region).cast("string"))
    df = df.withColumn(rack, _winner(ref(mine), at, F.get(by_rack, ref(region))))
    at = F.concat(at, F.lit("/"), ref(rack).cast("string"))
    leaf = _winner(ref(mine), at, F.get(F.get(by_shard, ref(region)), ref(rack)))
    return df.withColumn(out, F.get(F.get(begins, ref(region)), ref(rack)) + leaf).drop(mine, region, rack)


def _free(df: DataFrame, name: str) -> str:
    """A name like this that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shard_documents(docs: DataFrame, topology: Topology, grown: Topology | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all documents under the law `key`.

    Slots are numbered in parts of about 50,000 rows of a shard, so no shard is sorted in one task.
    """
    grown = grown or topology.grow()
    rows = docs.count() if rows is None else rows
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    out = place(out, F.col("doc_id"), topology, "shard")
    out = place(out, F.col("doc_id"), grown, "grown_shard")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts_for(rows // max(1, topology.size))))
    return gapless(out, ["shard"], [F.col("doc_id"), F.col("text_crc32")], salt, None, "slot")
