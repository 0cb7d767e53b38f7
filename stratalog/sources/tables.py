"""The catalogue model derived from tabular data: files, symbols, edges, events, coverage, generations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


@dataclass(frozen=True)
class Catalog:
    """Lazy model tables over one data folder."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return ship_package(self.spark).read.parquet(f"{self.root}/{name}.parquet")

    def files(self) -> DataFrame:
        """Generation 1: one file per document."""
        d = self.table("documents")
        return d.select(
            F.concat(F.lit("f:"), F.col("doc_id").cast("string")).alias("file_id"),
            F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
            F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"), "lang", "source", "doc_id",
        )

    def next_files(self) -> DataFrame:
        """Generation 2: some documents deleted, renamed, edited; others are new in it."""
        d = self.table("documents").where("doc_id % 11 != 0")
        text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
        path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
        return d.select(
            F.concat(F.lit("f:"), F.col("doc_id").cast("string")).alias("file_id"), F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"),
            F.sha2(text.cast("binary"), 256).alias("content_hash"), F.octet_length(text).cast("long").alias("byte_size"), "lang", "source", "doc_id",
        )

    def generation(self, number: int) -> DataFrame:
        """The members of generation 1 or 2; documents divisible by 17 are in the second only."""
        return self.files().where("doc_id % 17 != 0") if number == 1 else self.next_files()

    def symbols(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("symbol_key"), F.col("p_name").alias("display_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("path"), F.round((F.col("p_size") % 10) / 10.0 + 0.05, 2).alias("confidence"), F.col("p_size").cast("long").alias("start_byte"), "p_partkey")

    def edges(self) -> DataFrame:
        """source, target (`kind:key`), type and a fact id."""
        name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
        part = lambda df, a, b, t: df.select(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
        li, o, c, s, n = (self.table(t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
        out = part(li, name("order", "l_orderkey"), name("part", "l_partkey"), "calls")
        for more in (part(li, name("order", "l_orderkey"), name("supplier", "l_suppkey"), "reads"), part(o, name("order", "o_orderkey"), name("customer", "o_custkey"), "references"), part(c, name("customer", "c_custkey"), name("nation", "c_nationkey"), "imports"), part(s, name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "imports"), part(n, name("nation", "n_nationkey"), name("region", "n_regionkey"), "imports")):
            out = out.unionByName(more)
        return out

    def use_events(self) -> DataFrame:
        """Use events with session, type, entity and bytes."""
        kinds = {"view": "context_supplied", "click": "entity_queried", "purchase": "exact_source_requested", "signup": "reasoning_use_reported"}
        kind = F.lit("artifact_changed")
        for a, b in kinds.items():
            kind = F.when(F.col("event_type") == a, F.lit(b)).otherwise(kind)
        e = self.table("events")
        day = F.date_format("ts", "yyyy-MM-dd")
        return e.select("event_id", "ts", "user_id", F.concat_ws("|", F.col("user_id").cast("string"), day).alias("session_id"), kind.alias("use_type"), F.get_json_object("props", "$.k").alias("entity"), F.round("value").cast("long").alias("bytes"))

    def coverage(self) -> DataFrame:
        label = self.table("labels")
        d = self.table("documents").select("doc_id", "lang", "source").join(label, "doc_id", "left")
        return d.select("doc_id", "lang", "source", coverage_status(F.col("quality"), F.col("toxic")).alias("status"))


def coverage_status(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "failed").when(quality == 1, "complete").when(quality == 0, "partial").otherwise("unsupported")
