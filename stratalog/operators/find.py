"""Lookups of a snapshot: paged find, envelope, negative answers, inspection, history, provider status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Statuses that the envelope counts as open conflicts and as unresolved relations.
OPEN_CONFLICT = ("open", "preferred_with_conflict")
UNRESOLVED = ("unresolved", "ambiguous", "invalid", "stale")


def matches(query: str | None = None, kind: str | None = None, path_prefix: str | None = None, min_confidence: float | None = None) -> Column:
    """The optional predicates; an absent one holds. `%` and `_` in the texts are wildcards, and ASCII case does not count."""
    out = F.lit(True)
    if query is not None:
        out = out & F.lower("display_name").like(f"%{query.lower()}%")
    if kind is not None:
        out = out & (F.col("kind") == kind)
    if path_prefix is not None:
        out = out & F.lower("path").like(f"{path_prefix.lower()}%")
    if min_confidence is not None:
        out = out & (F.col("confidence") >= min_confidence)
    return out


def cursor_of(*identity: Column) -> Column:
    return F.lower(F.hex(F.concat_ws("\u001f", *identity).cast("binary")))


def read_cursor(text: str | None, generation_id: str, digest: str) -> str | None:
    """The path after which a page goes on; a cursor of another snapshot or request starts again, as an absent one does."""
    if not text:
        return None
    try:
        found = bytes.fromhex(text).decode().split("\u001f")
    except ValueError:
        return None
    return found[2] if len(found) == 3 and found[:2] == [generation_id, digest] else None


def find_page(symbols: DataFrame, where: Column, limit: int, generation_id: str, digest: str, cursor: str | None = None) -> DataFrame:
    """One page by (path, start_byte, symbol_key), with `truncated`, `total_matched` and `next_cursor` on every row.

    The cursor is the last path only, so a page cut inside a file drops the file's remaining symbols, and
    `total_matched` is the size of the page. Spark takes the first limit + 1 rows of each partition only.
    """
    after = read_cursor(cursor, generation_id, digest)
    if after is not None:
        where = where & (F.col("path") > after)
    page = symbols.where(where).orderBy("path", "start_byte", "symbol_key").limit(limit + 1)
    whole = Window.partitionBy()  # limit + 1 rows at most
    place = F.row_number().over(Window.orderBy("path", "start_byte", "symbol_key"))
    page = page.withColumns({"place": place, "n": F.count(F.lit(1)).over(whole)}).withColumn("truncated", F.col("n") > limit).where(F.col("place") <= limit)
    last = F.max_by("path", "place").over(whole)
    follow = F.when(F.col("truncated"), cursor_of(F.lit(generation_id), F.lit(digest), last))
    return page.withColumns({"total_matched": F.least("n", F.lit(limit)), "next_cursor": follow}).drop("n", "place")


def keyset_page(rows: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The page after a full key (nothing is dropped): an extension of find_page's cursor."""
    if after is not None:
        past, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, after, strict=True):
            past = past | (equal & (F.col(key) > F.lit(value)))
            equal = equal & (F.col(key) == F.lit(value))
        rows = rows.where(past)
    return rows.orderBy(*keys).limit(limit)


def watermarked_page(rows: DataFrame, keys: list[str], limit: int, after: tuple, seen: str, now: str) -> DataFrame:
    """outcome, the keys, digest: keyset_page under the digest `seen` that its cursor carries; where the snapshot's digest is
    another by `now`, one row `snapshot_changed` without keys, and no row is read."""
    if seen != now:
        none = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
        return rows.sparkSession.range(1).select(F.lit("snapshot_changed").alias("outcome"), *none, F.lit(now).alias("digest"))
    return keyset_page(rows, keys, limit, after).select(F.lit("page").alias("outcome"), *keys, F.lit(now).alias("digest"))


def negative_answer(matched: Column, truncated: Column, provider_available: Column, coverage_complete: Column) -> Column:
    """Why a result is empty, in the order in which the reasons hold; null where it is not."""
    why = F.when(truncated, "truncated").when(~provider_available, "provider_unavailable").when(~coverage_complete, "coverage_partial").otherwise("not_found")
    return F.when(matched == 0, why)


def envelope(providers: DataFrame, coverage: DataFrame, conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row: distinct providers, coverage rows and statuses, open conflicts, unresolved relations."""
    one = lambda df, *aggs: df.agg(*aggs)
    p = one(providers.select("provider").distinct(), F.array_join(F.array_sort(F.collect_list("provider")), ",").alias("providers"))
    c = one(coverage, F.count(F.lit(1)).alias("coverage_rows"), F.count_if(F.col("status") == "complete").alias("complete"))
    o = one(conflicts, F.count_if(F.col("status").isin(*OPEN_CONFLICT)).alias("open_conflicts"))
    u = one(resolutions, F.count_if(F.col("status").isin(*UNRESOLVED)).alias("unresolved"))
    return p.crossJoin(c).crossJoin(o).crossJoin(u)  # single rows


def inspect(symbols: DataFrame, edges: DataFrame, every_edge: DataFrame, path: str, keys: DataFrame) -> DataFrame:
    """A file's symbols by span, the edges that leave this revision, and those that reach it from any revision."""
    own = symbols.where(F.col("path") == path).select(F.lit("symbol").alias("record"), F.col("symbol_key").alias("a"), F.col("kind").alias("b"), F.lit("").alias("c"))
    out = edges.where(F.col("path") == path).select(F.lit("outbound").alias("record"), F.col("source").alias("a"), F.col("type").alias("b"), F.col("target").alias("c"))
    reach = every_edge.join(F.broadcast(keys), F.col("target") == F.col("symbol_key"), "left_semi")  # the symbols of one file
    return own.unionByName(out).unionByName(reach.select(F.lit("inbound").alias("record"), F.col("source").alias("a"), F.col("type").alias("b"), F.col("target").alias("c")))


def history(events: DataFrame, limit: int, tombstones: DataFrame | None = None) -> DataFrame:
    """The newest events with the exact total on each row, and whether their file is deleted."""
    total = events.agg(F.count(F.lit(1)).alias("total"))
    page = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(limit, 1))
    if tombstones is not None:
        page = page.join(tombstones.select("file_id", F.lit(True).alias("tombstone")), "file_id", "left").withColumn("tombstone", F.coalesce("tombstone", F.lit(False)))
    return page.crossJoin(F.broadcast(total))


def latest(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """The row of each key that is last by `order`."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*")


def provider_status(descriptors: DataFrame, policy: DataFrame, executions: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Each provider with its policy, its latest execution and its latest invalidation; stale where that came later."""
    done = latest(executions, "provider", ["done_at", "execution_id"], "execution_id", "outcome", "done_at")
    gone = latest(invalidations, "provider", ["at", "reason"], "reason", "at")
    rows = descriptors.join(policy, "provider", "left").join(done, "provider", "left").join(gone, "provider", "left")
    state = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when(F.col("execution_id").isNull(), "never_run").when(F.col("at") > F.col("done_at"), "stale").otherwise(F.col("outcome"))
    return rows.withColumn("state", state)


def verify_source(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """path, status of exact sources: verified, hash_mismatch, not_found (gone) or read_failed (no bytes)."""
    now = live.select("path", F.sha2("content", 256).alias("live_hash"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "not_found").when(F.col("live_hash").isNull(), "read_failed").when(F.col("live_hash") == F.col("content_hash"), "verified").otherwise("hash_mismatch")
    return indexed.join(now, "path", "left").withColumn("status", status).drop("there", "live_hash")
