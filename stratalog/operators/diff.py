"""Snapshot differences: files, renames, deletions and relationship multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, change: added, removed, renamed (a new path wins over new content) or modified."""
    b = before.select("file_id", F.col("path").alias("old_path"), F.col("content_hash").alias("old_hash"))
    a = after.select("file_id", F.col("path").alias("new_path"), F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "removed").when(F.col("old_path") != F.col("new_path"), "renamed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return b.join(a, "file_id", "full_outer").withColumn("change", change).where("change is not null")


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path of contents that one vanished and one new path have."""
    one = lambda df, name: df.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
    return one(gone, "old_path").join(one(new, "new_path"), "content_hash")


def relationship_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, change, old_target, new_target of (identity, target, state) multisets.

    Equal rows cancel; leftovers with one target pair up in order as `evidence_changed`; of what is left, one removed
    and one added make `retargeted`.
    """
    keys = ["identity", "target", "state"]
    signed = before.select(*keys, F.lit(1).alias("s")).unionByName(after.select(*keys, F.lit(-1).alias("s")))
    # one shuffle by identity serves the signed count, the pairing and the retarget rule
    left = signed.repartition("identity").groupBy(*keys).agg(F.sum("s").alias("s")).where("s != 0")
    copies = left.withColumn("_", F.explode(F.sequence(F.lit(1), F.abs("s").cast("int")))).withColumn("old", F.col("s") > 0)
    copies = copies.withColumn("k", F.row_number().over(Window.partitionBy("identity", "target", "old").orderBy("state")))
    side = lambda old: F.max(F.when(F.col("old") == old, F.col("state")))
    both = copies.groupBy("identity", "target", "k").agg(side(True).alias("old_state"), side(False).alias("new_state"))
    # one pass gives all changes: a branch for each kind would pair everything again
    was, now = F.col("old_state").isNotNull() & F.col("new_state").isNull(), F.col("old_state").isNull() & F.col("new_state").isNotNull()
    w = Window.partitionBy("identity")
    rows = both.withColumns({"n_old": F.count_if(was).over(w), "n_new": F.count_if(now).over(w), "moved_to": F.max(F.when(now, F.col("target"))).over(w)})
    pair = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    target, none = F.col("target"), F.lit(None).cast("string")
    row = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_target"), new.alias("new_target"))
    what = F.when(pair & was, row("retargeted", target, F.col("moved_to"))).when(was, row("removed", target, none)).when(now, row("added", none, target)).otherwise(row("evidence_changed", target, target))
    return rows.where(~(pair & now)).select("identity", what.alias("w")).select("identity", "w.*")


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, outcome, extract: what a reconcile does with each path of the new listing, and with the vanished ones.

    A vanished and a new path with one content each way are a rename, and keep their identity; only contents that no
    earlier revision has are extracted.
    """
    gone = before.join(after.select("path"), "path", "left_anti")
    new = after.join(before.select("path"), "path", "left_anti")
    moved = renames(gone, new)
    known = before.select("content_hash").distinct().withColumn("known", F.lit(True))
    old = before.select("path", F.col("content_hash").alias("old_hash"))
    rows = after.select("path", "content_hash").join(moved.select(F.col("new_path").alias("path"), "old_path"), "path", "left").join(old, "path", "left").join(known, "content_hash", "left")
    outcome = F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") != F.col("content_hash"), "modified").otherwise("kept")
    deleted = gone.select("path").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rows.select("path", outcome.alias("outcome"), F.col("known").isNull().alias("extract")).unionByName(deleted.select("path", F.lit("deleted").alias("outcome"), F.lit(False).alias("extract")))


def retention_manifest(events: DataFrame, keep: int, per_run: int, session_days: int, derived_days: int, now_after_days: int) -> DataFrame:
    """session_id, action of the oldest sessions that are to go, at most `per_run`.

    The first `keep` sessions by last event are found with a top-k, so sessions are not numbered in one task.
    """
    s = events.groupBy("session_id").agg(F.max("ts").alias("last"), F.max(F.col("use_type") == "artifact_changed").alias("derived"))
    newest = s.orderBy(F.desc("last"), "session_id").limit(keep).select("session_id", F.lit(True).alias("kept"))
    now = events.agg((F.max("ts") + F.expr(f"INTERVAL {now_after_days} DAY")).alias("now"))
    rows = s.join(F.broadcast(newest), "session_id", "left").crossJoin(F.broadcast(now))  # `keep` rows; one row
    older = lambda days: F.col("last") < F.col("now") - F.expr(f"INTERVAL {days} DAY")
    action = F.when(F.col("kept").isNull() | older(session_days), "delete_session").when(older(derived_days) & F.col("derived"), "delete_derived").when(older(derived_days), "delete_metric")
    return rows.withColumn("action", action).where("action is not null").orderBy("last", "session_id").limit(per_run).select("session_id", "action")
