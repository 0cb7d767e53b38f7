"""The stored serving projection: cards, edges and rollups as Parquet, kept up by the keys that a change touches.

A generation's projection is a manifest over immutable buckets of files: a card lies in the bucket of its symbol, an edge in
that of its source. `advance` makes the next generation's projection from a delta that names symbols: it reads and
replaces the buckets of those symbols only, and its manifest points to the older files for all others. Rollups are counts,
so a delta is added and subtracted.

The content hash does not depend on order: each row has a digest, two lanes of which are summed as decimals by bucket, so
sums of buckets add up to the sums of the whole, and a row that goes is subtracted. `status` sums again over the files, from
digests computed anew from the columns, so a changed, lost or doubled row shows.

A manifest is written last; a build that ends before has `begun` (or `failed`) only. A second build of the same fingerprint
returns the manifest that is there and reads nothing else. All files lie under one root in the shared folder, on any store
that Spark writes to.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import serving

BUCKETS = 64
#: Folders that one manifest may point to; a delta beyond it writes every bucket again.
MAX_FOLDERS = 8
_COUNTS = ", ".join(f"`{c}` long" for c in serving.COUNTS)
SCHEMAS = {
    "cards": f"symbol_key string, fact_id string, {_COUNTS}, coverage_state string, tokens long, card_hash string",
    "edges": "fact_id string, source string, target string, type string, status string",
    "rollups": "scope_kind string, scope_key string, eligible long, complete long, partial long, unsupported long, excluded long, failed long",
}
_KEY = {"cards": "symbol_key", "edges": "source", "rollups": "scope_kind"}
_MANIFEST = "kind string, bucket int, folder string, n long, a decimal(38,0), b decimal(38,0), generation_id string, fingerprint string"


@dataclass(frozen=True)
class Source:
    """What a build reads. facts: symbol_key, fact_id, file_id, method, confidence, start_byte, end_byte. edges: fact_id,
    source, target, type, status. effects: subject. conflicts: subject_key, status. coverage: file_id, status and the
    columns of the scopes."""

    facts: DataFrame
    edges: DataFrame
    effects: DataFrame
    conflicts: DataFrame
    coverage: DataFrame
    scopes: tuple[str, ...] = ("lang", "presence")


def _bucket(kind: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(_KEY[kind]), F.lit(buckets)).cast("int")


def row_digest(kind: str) -> Column:
    """sha256 of a row's columns in their order (of a card: all but its own hash)."""
    names = [f.split("`")[1] if "`" in f else f.split()[0] for f in SCHEMAS[kind].split(", ") if not f.startswith("card_hash")]
    return F.sha2(F.concat_ws("\u001f", *names), 256)


def sums(rows: DataFrame, kind: str, *by: str) -> DataFrame:
    """n, a, b (by `by`): the count and the sums of two 60-bit lanes of the rows' digests.

    The halves of a lane are summed as longs, which hold 2^33 rows."""
    lane = lambda i: F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("long").alias("ab"[i])
    half = lambda x: F.sum(x).cast("decimal(20,0)")
    whole = lambda c: (half(F.shiftright(c, 30)) * F.lit(1 << 30).cast("decimal(11,0)") + half(F.col(c).bitwiseAND((1 << 30) - 1))).cast("decimal(38,0)")
    lanes = rows.withColumn("_d", row_digest(kind)).select(*by, lane(0), lane(1))
    return lanes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), whole("a").alias("a"), whole("b").alias("b"))


def make_cards(source: Source) -> DataFrame:
    counts = serving.symbol_counts(source.facts, source.edges, source.effects, source.conflicts)
    return serving.cards(source.facts, counts, source.coverage)


def make_rollups(coverage: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    return serving.coverage_rollup(coverage, {c: F.col(c) for c in scopes})


def only_of(source: Source, keys: DataFrame) -> Source:
    """The part of a source that the cards of `keys` (symbol_key) need. Edges are all of them: one counts for both of its ends,
    and their counts by symbol are smaller than any choice of edges."""
    near = lambda df, column: df.join(keys.select(F.col("symbol_key").alias(column)), column, "left_semi")
    return Source(near(source.facts, "symbol_key"), source.edges, near(source.effects, "subject"), near(source.conflicts, "subject_key"), source.coverage, source.scopes)


def affected(before: Source, after: Source) -> DataFrame:
    """symbol_key of every card that differs between two sources, and of the sources of edges that do.

    Rows of both sides are counted by all their columns; what is not there equally often names its symbols. Rows that are equal
    on both sides may be left out, and a part that both sources share is not compared.
    """
    columns = {"facts": ["symbol_key", "fact_id", "file_id", "method", "confidence", "start_byte", "end_byte"], "edges": ["fact_id", "source", "target", "type", "status"], "effects": ["subject"], "conflicts": ["subject_key", "status"], "coverage": ["file_id", "status"]}

    def differing(name: str) -> DataFrame:
        c = columns[name]
        if getattr(before, name) is getattr(after, name):
            return getattr(after, name).select(*c).limit(0)
        side = lambda s, sign: getattr(s, name).select(*c, F.lit(sign).alias("_side"))
        return side(before, -1).unionByName(side(after, 1)).groupBy(*c).agg(F.sum("_side").alias("_n")).where("_n != 0").select(*c)

    edges = differing("edges")
    out = differing("facts").select("symbol_key").unionByName(edges.select(F.explode(F.array("source", "target")).alias("symbol_key")))
    out = out.unionByName(differing("effects").select(F.col("subject").alias("symbol_key"))).unionByName(differing("conflicts").select(F.col("subject_key").alias("symbol_key")))
    files = differing("coverage").select("file_id").distinct()
    for s in (before, after):
        out = out.unionByName(s.facts.join(files, "file_id", "left_semi").select("symbol_key"))
    return out.where("symbol_key IS NOT NULL").distinct()


class Projection:
    """Projections of generations under one root folder; of some kinds of rows only, if that is asked for."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, kinds: tuple[str, ...] = tuple(SCHEMAS)):
        self.spark, self.root, self.buckets, self.kinds = spark, root.rstrip("/"), buckets, kinds

    # --- what is there

    def _at(self, generation: str, part: str) -> str:
        return f"{self.root}/{generation}/{part}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifest(self, generation: str) -> DataFrame | None:
        """One row a bucket and kind, or None where no build has ended."""
        path = self._at(generation, "manifest")
        return self.spark.read.schema(_MANIFEST).parquet(path) if self._there(path) else None

    def read(self, generation: str, kind: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a kind, or of some buckets: files of other buckets are not read."""
        rows = self.manifest(generation).where(F.col("kind") == kind)
        if only is not None:
            rows = rows.where(F.col("bucket").isin(only))
        of: dict[str, list[int]] = {}
        for r in rows.select("folder", "bucket").collect():  # one row a bucket
            of.setdefault(r.folder, []).append(r.bucket)
        schema = SCHEMAS[kind]
        out = self.spark.createDataFrame([], schema)
        for folder, some in sorted(of.items()):
            files = self.spark.read.schema(schema + ", bucket int").parquet(f"{folder}/{kind}")
            out = out.unionByName(files.where(F.col("bucket").isin(some)).drop("bucket"))
        return out

    def cards_of(self, generation: str, keys: list[str]) -> DataFrame:
        """The cards of a request's symbols: only their buckets are read."""
        asked = self.spark.createDataFrame([(k,) for k in keys], "symbol_key string")
        only = [r[0] for r in asked.select(_bucket("cards", self.buckets)).distinct().collect()]  # a request's symbols
        return self.read(generation, "cards", only).where(F.col("symbol_key").isin(keys))

    # --- building

    def _write(self, folder: str, kind: str, rows: DataFrame) -> None:
        dealt = rows.withColumn("bucket", _bucket(kind, self.buckets)).hint("rebalance", "bucket")  # a hot bucket is written by several tasks
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/{kind}")

    def _files(self, folder: str, kind: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[kind] + ", bucket int").parquet(f"{folder}/{kind}").drop("bucket")

    def _sums(self, folder: str, kind: str) -> DataFrame:
        files = self.spark.read.schema(SCHEMAS[kind] + ", bucket int").parquet(f"{folder}/{kind}")
        return sums(files, kind, "bucket").select(F.lit(kind).alias("kind"), "bucket", F.lit(folder).alias("folder"), "n", "a", "b")

    def _all_sums(self, folder: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self._sums(folder, kind) for kind in self.kinds])

    def begin(self, generation: str) -> str:
        path = self._at(generation, "begun")
        if not self._there(path):
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)
        return self._at(generation, f"files-{uuid.uuid4().hex}")

    def fail(self, generation: str) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._at(generation, "failed"))

    def _finish(self, generation: str, fingerprint: str, rows: DataFrame) -> DataFrame:
        named = rows.withColumns({"generation_id": F.lit(generation), "fingerprint": F.lit(fingerprint)})
        named.coalesce(1).write.parquet(self._at(generation, "manifest"))
        return self.manifest(generation)

    def same(self, generation: str, fingerprint: str) -> DataFrame | None:
        """The manifest of an equal build; one of another fingerprint is an error, since generations are immutable."""
        found = self.manifest(generation)
        if found is not None and found.select("fingerprint").first().fingerprint != fingerprint:
            raise ValueError(f"{generation} has a projection of another fingerprint")
        return found

    def build(self, generation: str, fingerprint: str, source: Source) -> DataFrame:
        """All of it from the source, unless it is there."""
        found = self.same(generation, fingerprint)
        if found is not None:
            return found
        folder = self.begin(generation)
        if "edges" in self.kinds:
            self._write(folder, "edges", source.edges.select("fact_id", "source", "target", "type", "status"))
            source = replace(source, edges=self._files(folder, "edges"))
        if "cards" in self.kinds:
            self._write(folder, "cards", make_cards(source))
        if "rollups" in self.kinds:
            self._write(folder, "rollups", make_rollups(source.coverage, source.scopes))
        return self._finish(generation, fingerprint, self._all_sums(folder))

    def advance(self, old: str, generation: str, fingerprint: str, changed: DataFrame, source: Source, coverage_before: DataFrame, coverage_after: DataFrame, edges: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """The next generation's projection: `changed` (symbol_key) names every symbol whose card or outbound edges differ,
        coverage_* hold the files whose coverage does. Only the buckets of those symbols are read and written.

        edges: the symbols (symbol_key) whose outbound edges differ and all edges that they have now, where the caller knows
        them; else those of `changed` are taken from the source."""
        found = self.same(generation, fingerprint)
        if found is not None:
            return found
        before, folder = self.manifest(old), self.begin(generation)
        changed.select("symbol_key").distinct().write.parquet(f"{folder}/changed")
        keys = self.spark.read.schema("symbol_key string").parquet(f"{folder}/changed")
        touched = sorted(r[0] for r in keys.select(_bucket("cards", self.buckets)).distinct().collect())  # buckets at most
        if before.select("folder").distinct().count() >= MAX_FOLDERS:
            touched = list(range(self.buckets))
        if "edges" in self.kinds:
            by_source = keys.select(F.col("symbol_key").alias("source"))
            of, now = edges or (keys, source.edges.join(by_source, "source", "left_semi"))
            self._replace_edges(folder, self.read(old, "edges", touched), of, now)
            rest = [b for b in range(self.buckets) if b not in touched]
            source = replace(source, edges=self._files(folder, "edges").unionByName(self.read(old, "edges", rest)))
        if "cards" in self.kinds:
            self._write(folder, "cards", self.read(old, "cards", touched).join(keys, "symbol_key", "left_anti").unionByName(make_cards(only_of(source, keys))))

        if "rollups" in self.kinds:
            scope, counts = ["scope_kind", "scope_key"], ["eligible", "complete", "partial", "unsupported", "excluded", "failed"]
            signed = lambda rows, sign: rows.select(*scope, *[(F.col(c) * sign).alias(c) for c in counts])
            rollups = self.read(old, "rollups").unionByName(signed(make_rollups(coverage_after, source.scopes), 1)).unionByName(signed(make_rollups(coverage_before, source.scopes), -1))
            rollups = rollups.groupBy(*scope).agg(*[F.sum(c).alias(c) for c in counts]).where("eligible > 0 OR scope_kind = 'workspace'")
            self._write(folder, "rollups", rollups)

        new = self._all_sums(folder)
        kept = before.where((F.col("kind") != "rollups") & ~F.col("bucket").isin(touched)).select(*new.columns)
        return self._finish(generation, fingerprint, kept.unionByName(new))

    def _replace_edges(self, folder: str, rows: DataFrame, keys: DataFrame, now: DataFrame) -> None:
        """Write `rows` without the edges of `keys`, and with the edges that those have now.

        Each row is shuffled once, by bucket and part of a bucket, for both: keys go with the edges, and a key that meets the
        earlier edges of its source takes them out.
        """
        names = [f.split()[0] for f in SCHEMAS["edges"].split(", ")]
        key = [(F.col("symbol_key") if c == "source" else F.lit(None).cast("string")).alias(c) for c in names]
        part = lambda df, kind: df.select(*names, F.lit(kind).alias("_kind"))
        every = part(rows, "was").unionByName(part(now, "is")).unionByName(part(keys.select(*key), "key"))
        place = {"bucket": _bucket("edges", self.buckets), "_part": F.pmod(F.hash("source"), F.lit(4))}
        dealt = every.withColumns(place).repartition("bucket", "_part")
        gone = F.max(F.col("_kind") == "key").over(Window.partitionBy("bucket", "_part", "source"))
        kept = dealt.withColumn("_gone", gone).where("_kind = 'is' OR _kind = 'was' AND NOT _gone")
        kept.select(*names, "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/edges")

    # --- whether it can be served

    def status(self, generation: str, active: str, counted: DataFrame | None = None) -> str:
        """absent, building, failed, superseded, stale or ready: the last only where files, counts and sums agree.

        counted: a recount of the same files, where the caller has one."""
        claimed = self.manifest(generation)
        if claimed is None:
            for part, state in (("failed", "failed"), ("begun", "building")):
                if self._there(self._at(generation, part)):
                    return state
            return "absent"
        if generation != active:
            return "superseded"
        found = self.recount(generation) if counted is None else counted
        return "ready" if content(claimed) == content(found) else "stale"

    def recount(self, generation: str, *kinds: str) -> DataFrame:
        """kind, n, a, b of the files as they are now, of all kinds or of some."""
        each = [sums(self.read(generation, kind), kind).select(F.lit(kind).alias("kind"), "n", "a", "b") for kind in kinds or self.kinds]
        return functools.reduce(DataFrame.unionByName, each)


def content(rows: DataFrame) -> dict[str, tuple[int, int, int]]:
    """kind -> (n, a, b) of a manifest's or a recount's rows."""
    total = rows.groupBy("kind").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "a", "b")]).collect()  # three rows
    found = {r.kind: (int(r.n), int(r.a), int(r.b)) for r in total}
    return {kind: found.get(kind, (0, 0, 0)) for kind in SCHEMAS}


def content_hash(rows: DataFrame) -> DataFrame:
    """One row: cards, edges, rollups (counts) and content_hash over counts and sums."""
    total = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
    one = [F.max(F.when(F.col("kind") == k, F.col("n"))) for k in SCHEMAS]
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n", "a", "b"))), "|")  # three rows
    return total.agg(*[F.coalesce(n, F.lit(0)).alias(k) for n, k in zip(one, SCHEMAS, strict=True)], F.sha2(text, 256).alias("content_hash"))
