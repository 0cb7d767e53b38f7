"""Graph operators over edges: bounded breadth-first traces and impact."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses and kinds of resolutions that a resolved trace follows.
RESOLVED = ("resolved_symbol", "resolved_file")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A `local` session without that setting uses a folder of its
    own; on a cluster its absence is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.stratalog.graph", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalog-graph-")
        spark.conf.set("spark.stratalog.graph", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a level to the shared folder and read it again, so that plans stay short and a level is not computed again for
    each later one."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trace(edges: DataFrame, seeds: DataFrame, max_depth: int, outbound: bool = True) -> DataFrame:
    """Edges met by a breadth-first walk from `seeds` (node): depth, source, type, target.

    A node is expanded once, at its least depth. Edges to visited nodes are given but not followed, so cycles end.
    The depth bound is the only loop; each level is a join and an anti join.
    """
    here, there = ("source", "target") if outbound else ("target", "source")
    frontier = seeds.select("node").distinct()
    visited, out = frontier, None
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.withColumnRenamed("node", here), here).select(F.lit(depth).alias("depth"), "source", "type", "target").distinct()
        step = cut(step, "trace")
        out = step if out is None else out.unionByName(step)
        frontier = cut(step.select(F.col(there).alias("node")).distinct().join(visited, "node", "left_anti"), "trace-frontier")
        if depth < max_depth:
            visited = visited.unionByName(frontier)
    return out


#: Kinds of targets that an impact looks at.
IMPACT_KINDS = ("path", "external")


def _literal_tail(seed: Column) -> Column:
    """What follows the last wildcard of a seed."""
    return F.element_at(F.split(seed, "[%_]"), -1)


def suffix_matches(targets: DataFrame, seeds: DataFrame) -> DataFrame:
    """target, seed: targets that are a seed or end with it, ASCII and other case aside; `%` and `_` in a seed are wildcards.

    An equi join on hashes: every distinct target gives one row for each length that the seeds' literal tails have, with the
    hash of its last so many characters. A hit is then confirmed on the texts. Seeds' lengths are few, whatever their number.
    """
    s = seeds.select(F.col("node").alias("seed")).distinct().withColumn("like", F.regexp_replace(F.lower("seed"), r"^(\./)+", "")).withColumn("tail", _literal_tail(F.col("like")))
    s = s.withColumn("length", F.char_length("tail"))
    lengths = sorted(r[0] for r in s.select("length").distinct().collect())  # one number a length
    low = F.lower("target")
    ends = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.char_length(low)), lambda n: F.struct(n.alias("length"), F.xxhash64(F.when(n == 0, F.lit("")).otherwise(F.substring(low, -n, n))).alias("h")))
    t = targets.select("target").distinct().select("target", F.inline(ends))
    s = s.select("seed", "like", "length", F.xxhash64("tail").alias("h"))
    hit = F.like(F.lower("target"), F.concat(F.lit("%"), F.col("like")))
    exact = targets.select("target").distinct().join(s.select("seed", F.col("seed").alias("target")), "target")
    return t.join(s, ["length", "h"]).where(hit).select("target", "seed").unionByName(exact.select("target", "seed")).distinct()


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One hop inbound of the seeds (node) by exact or suffix match, without the seeds themselves: dependent, is_test.

    Where edges have `ref_kind`, only IMPACT_KINDS count; where they have `status`, `verified` and `uncertain` say whether a
    resolved and an unresolved edge led there (a dependent may be both)."""
    if "ref_kind" in edges.columns:
        edges = edges.where(F.col("ref_kind").isin(*IMPACT_KINDS))
    hits = suffix_matches(edges, seeds).select("target").distinct()
    found = edges.join(hits, "target", "left_semi").withColumnRenamed("source", "dependent")
    parts = []
    if "status" in edges.columns:
        good = F.col("status").startswith("resolved_")
        parts = [F.max(good).alias("verified"), F.max(~good).alias("uncertain")]
    found = found.groupBy("dependent").agg(*parts, F.lit(1).alias("_")).drop("_") if parts else found.select("dependent").distinct()
    own = seeds.select(F.col("node").alias("dependent")).distinct()
    low = F.lower("dependent")
    return found.join(own, "dependent", "left_anti").withColumn("is_test", low.contains("test") | low.contains("spec"))


def trace_flags(steps: DataFrame, max_depth: int, max_records: int) -> DataFrame:
    """The first `max_records` steps by (depth, source, type, target) with both truncation flags on every row.

    truncated_by_depth: a node was first met at the last depth. truncated_by_records: there were more steps.
    """
    first = steps.groupBy("target").agg(F.min("depth").alias("first"))
    deep = first.agg(F.coalesce(F.max(F.col("first") == max_depth), F.lit(False)).alias("truncated_by_depth"))
    n = steps.agg((F.count(F.lit(1)) > max_records).alias("truncated_by_records"))
    page = steps.orderBy("depth", "source", "type", "target").limit(max_records)
    return page.crossJoin(F.broadcast(deep)).crossJoin(F.broadcast(n))  # single rows


def trace_resolved(edges: DataFrame, members: DataFrame, seeds: DataFrame, max_depth: int, outbound: bool) -> DataFrame:
    """trace() over resolved edges by their resolved value. Outbound edges must belong to a member file; inbound ones
    need no membership, only a resolution in the generation."""
    rows = edges.where(F.col("status").isin(*RESOLVED)).withColumn("target", F.coalesce("resolved_value", "target"))
    if outbound:
        rows = rows.join(members.select("file_id").distinct(), "file_id", "left_semi")
    return trace(rows.select("source", "target", "type"), seeds, max_depth, outbound)
