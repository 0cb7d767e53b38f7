"""Merkle trees over ranges of key hashes: one digest of a table of any size, and what differs between two of them.

A row (key, value) lies in the range that the first hex digits of its key's sha256 name. A leaf's digest is that of its rows in
the order of their hashes; a node's is that of its 16 parts. The depth follows from the number of rows, so a leaf holds about
LEAF_ROWS of them and no task more than one leaf. Two trees are descended together: below equal nodes nothing is read, so the
work follows what differs and not the tables.

Equal rows are counted in a leaf, not listed, so a row repeated any number of times is one entry. A null key or value is an
entry of its own ("\\N"); an empty table has the digest of the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import cut, shared_folder

#: Rows that a leaf holds on average, at most.
LEAF_ROWS = 4096
_NODES = "level int, node string, n long, digest string"
_ROWS = "h string, key string, value string, n long, top string"


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Hex digits that name a leaf."""
    depth = 0
    while rows > leaf_rows * 16**depth:
        depth += 1
    return depth


@dataclass(frozen=True)
class Tree:
    """Stored nodes and, if they were asked for, the rows in folders by their first two digits."""

    nodes: DataFrame
    depth: int
    rows: DataFrame | None = None

    def root(self) -> DataFrame:
        """One row: n, digest."""
        return self.nodes.where("level = 0").select("n", "digest")


def _texts(table: DataFrame, key: Column, value: Column) -> DataFrame:
    text = lambda c, name: F.coalesce(c.cast("string"), F.lit("\\N")).alias(name)
    return table.select(text(key, "key"), text(value, "value"))


def entries(table: DataFrame, key: Column, value: Column) -> DataFrame:
    return _texts(table, key, value).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def tree(table: DataFrame, key: Column, value: Column, keep_rows: bool = False, leaf_rows: int = LEAF_ROWS, depth: int | None = None, repeats: bool = True) -> Tree:
    """The tree of a table's rows (key, value); depth as given, so that two tables share it, or by the number of rows.

    Hashes are made where they are used and move with no row. Without `repeats` (few rows are equal), rows are counted where
    their leaf is made, in one shuffle; else equal rows are combined first.
    """
    if keep_rows:
        rows = _by_top(entries(table, key, value).withColumn("h", F.sha2("key", 256)))
    elif repeats:
        rows = cut(entries(table, key, value), "merkle-rows")
    else:
        rows = _texts(table, key, value).withColumn("n", F.lit(1).cast("long"))
        rows = cut(rows, "merkle-rows") if depth is None else rows
    if depth is None:
        depth = depth_for(rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, leaf_rows)
    level = _leaves(rows.select("key", "value", "n"), depth, combined=keep_rows or repeats)
    nodes = level = cut(level.select(F.lit(depth).alias("level"), "node", "n", "digest"), "merkle-nodes")
    for d in range(depth - 1, -1, -1):
        part = F.concat_ws(":", "node", "digest")  # 16 parts at most
        level = level.groupBy((F.substring("node", 1, d) if d else F.lit("")).alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("digest"))
        level = cut(level.select(F.lit(d).alias("level"), "node", "n", "digest"), "merkle-nodes")
        nodes = nodes.unionByName(level)
    if nodes.where("level = 0").isEmpty():
        spark = table.sparkSession
        nodes = spark.createDataFrame([(0, "", 0)], "level int, node string, n long").withColumn("digest", F.sha2(F.lit(""), 256))
    return Tree(nodes, depth, rows if keep_rows else None)


def _leaves(rows: DataFrame, depth: int, combined: bool) -> DataFrame:
    """node, n, digest of rows (key, value, n): one shuffle, by leaf."""
    h = F.sha2("key", 256)
    dealt = rows.withColumn("node", F.substring(h, 1, depth) if depth else F.lit("")).repartition("node")
    if not combined:
        dealt = dealt.groupBy("node", "key", "value").agg(F.sum("n").alias("n"))
    line = F.concat_ws("\u001f", h, "key", "value", "n")
    return dealt.groupBy("node").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def _by_top(rows: DataFrame) -> DataFrame:
    """Stored in folders by two digits and sorted by hash, so that a range is read alone."""
    import uuid

    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/merkle-kept-{uuid.uuid4().hex}"
    dealt = rows.withColumn("top", F.substring("h", 1, 2)).repartitionByRange("top", "h").sortWithinPartitions("top", "h")
    dealt.select("h", "key", "value", "n", "top").write.partitionBy("top").parquet(path)
    return spark.read.schema(_ROWS).parquet(path)


def differing_leaves(a: Tree, b: Tree) -> DataFrame:
    """node of the leaves whose digests differ: level by level, only below nodes that differ."""
    if a.depth != b.depth:
        raise ValueError(f"the trees have {a.depth} and {b.depth} levels: make one with the other's depth")
    spark = a.nodes.sparkSession
    at = spark.createDataFrame([("",)], "node string")
    for level in range(a.depth + 1):
        asked = at if level == 0 else at.select("node", F.explode(F.split(F.lit("0123456789abcdef"), "")).alias("d")).select(F.concat("node", "d").alias("node"))
        side = lambda t, name, level=level: t.nodes.where(F.col("level") == level).select("node", F.col("digest").alias(name))
        both = asked.join(side(a, "x"), "node", "left").join(side(b, "y"), "node", "left")
        at = cut(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "merkle-differs")
    return at


def differences(a: Tree, b: Tree) -> DataFrame:
    """key, change (added, removed, modified), before, after: read from the differing leaves of both alone.

    A key with several values in one of the tables is modified where the values, sorted and counted, differ.
    """
    leaves = differing_leaves(a, b)
    tops = [r[0] for r in leaves.select(F.substring("node", 1, 2).alias("top")).distinct().collect()]  # 256 at most
    size = a.depth

    def part(t: Tree, name: str) -> DataFrame:
        rows = t.rows.where(F.substring("top", 1, min(size, 2)).isin(tops)) if size else t.rows
        rows = rows.withColumn("node", F.substring("h", 1, size) if size else F.lit("")).join(leaves, "node", "left_semi")
        listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "value", F.when(F.col("n") > 1, F.col("n"))))), ",")
        return rows.groupBy("key").agg(listed.alias(name))

    both = part(a, "before").join(part(b, "after"), "key", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("key", change.alias("change"), "before", "after")


class Sealed:
    """Digests under names that are written once: an equal one again is a replay, another one a conflict."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def seal(self, name: str, found: Tree) -> str:
        """sealed, replayed or conflict; the nodes of the first stay."""
        there = self.read(name)
        if there is None:
            found.nodes.write.parquet(f"{self.folder}/{name}")
            return "sealed"
        old, new = (t.where("level = 0").first() for t in (there, found.nodes))
        return "replayed" if (old.n, old.digest) == (new.n, new.digest) else "conflict"

    def read(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(_NODES).parquet(f"{self.folder}/{name}")


def root_sql(rows: str, name: str, leaf_rows: int = LEAF_ROWS) -> str:
    """CTEs of DuckDB whose last, `name`, is (n, digest) of the query `rows` (key, value): the same tree in SQL."""
    depth = " ".join(f"WHEN total <= {leaf_rows * 16**d} THEN {d}" for d in range(6))
    return f"""{name}_e AS (SELECT coalesce(key::VARCHAR, '\\N') AS key, coalesce(value::VARCHAR, '\\N') AS value, count(*) AS n FROM ({rows}) GROUP BY ALL),
{name}_d AS (SELECT *, sha256(key) AS h, sum(n) OVER () AS total FROM {name}_e),
{name}_l AS (SELECT (CASE {depth} END)::INTEGER AS level, h[1 : CASE {depth} END] AS node, sum(n)::BIGINT AS n, sha256(string_agg(concat_ws(chr(31), h, key, value, n), chr(10) ORDER BY concat_ws(chr(31), h, key, value, n))) AS digest FROM {name}_d GROUP BY 1, 2),
{name}_t AS (SELECT level, node, n, digest FROM {name}_l UNION ALL SELECT level - 1, node[1 : level - 1], sum(n)::BIGINT, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) FROM {name}_t WHERE level > 0 GROUP BY 1, 2),
{name} AS (SELECT coalesce(max(n), 0)::BIGINT AS n, coalesce(max(digest), sha256('')) AS digest FROM {name}_t WHERE level = 0)"""
