"""The best candidates of many requests, where requests share most of what they mention.

A name that many symbols bear adds the same rows to every request that mentions it. These rows, and their neighbours over
edges, are worked out once for each distinct set of such common names; a request then only has its own rows, the entries
that these touch, and as many of its set's first entries as the touched ones could displace. So the work follows the
symbols, the edges and the requests, not requests times symbols. It falls back to that product only where the sets of
common names differ from request to request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

#: A name with more entities than this is common.
COMMON = 30


def _ranked(rows: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), "distance", "path", "key")
    return rows.withColumn("rank", F.row_number().over(w).cast("long"))


def _entries(first: DataFrame, owner: str, best: DataFrame, located: DataFrame) -> DataFrame:
    """owner, key, path, points, near: what `first` adds to an entry, and the best edge that leads there from a key of `first`."""
    keys = first.select(owner, F.col("key").alias("source")).distinct()
    near = keys.join(best, "source").groupBy(owner, F.col("target").alias("key")).agg(F.max("points").alias("near"))
    rows = first.select(owner, "key", "path", F.col("points").cast("long").alias("points"), F.lit(None).cast("long").alias("near"))
    rows = rows.unionByName(near.join(located, "key").select(owner, "key", "path", F.lit(None).cast("long").alias("points"), F.col("near").cast("long").alias("near")))
    return rows.groupBy(owner, "key", "path").agg(F.sum("points").alias("points"), F.max("near").alias("near"))


def best_of(own: DataFrame, hits: DataFrame, entities: DataFrame, best: DataFrame, located: DataFrame, most: int, common: int = COMMON) -> DataFrame:
    """request, key, path, score, rank of the first `most` entries of each request.

    own: request, key, path, points of a request alone. hits: request, name. entities: name, key, path, points, which a hit
    adds. best: source, target, points of the best edge of each pair, added once to an entry one hop away from any of these.
    located: key, path of what edges lead to. Points are not negative. By score, then distance, path and key.
    """
    n = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = cut(n.where(F.col("n") > common).select("name"), "common")
    rare = hits.join(names, "name", "left_anti").join(entities, "name").select("request", "key", "path", "points")
    sets = hits.join(names, "name").groupBy("request").agg(F.array_sort(F.collect_set("name")).alias("names"))
    sets = cut(sets.withColumn("set", F.sha2(F.to_json("names"), 256)), "sets")
    shared = sets.select("set", "names").dropDuplicates(["set"]).select("set", F.explode("names").alias("name")).join(entities, "name")
    score = F.coalesce("points", F.lit(0)) + F.coalesce("near", F.lit(0))
    distance = F.when(F.col("points").isNull(), 1).otherwise(0)

    whole = _entries(cut(shared.select("set", "key", "path", "points"), "shared"), "set", best, located)
    whole = cut(_ranked(whole.withColumns({"score": score, "distance": distance}), "set"), "entries")
    touched = _entries(cut(own.select("request", "key", "path", "points").unionByName(rare), "own"), "request", best, located)
    touched = cut(touched.join(sets.select("request", "set"), "request", "left"), "touched")

    # a touched entry has both parts; the better edge counts once
    of = whole.select("set", "key", "path", F.col("points").alias("points2"), F.col("near").alias("near2"))
    both = touched.join(of, ["set", "key", "path"], "left")
    points = F.when(F.col("points").isNotNull() | F.col("points2").isNotNull(), F.coalesce("points", F.lit(0)) + F.coalesce("points2", F.lit(0)))
    both = both.select("request", "key", "path", points.alias("points"), F.greatest("near", "near2").alias("near"))
    both = both.select("request", "key", "path", score.alias("score"), distance.alias("distance"))

    # at most the touched entries stand before others among the set's first ones
    taken = touched.groupBy("request").agg(F.count(F.lit(1)).alias("taken"))
    depth = sets.select("request", "set").join(taken, "request", "left").select("request", "set", (F.coalesce("taken", F.lit(0)) + most).alias("depth"))
    deepest = depth.groupBy("set").agg(F.max("depth").alias("deepest"))
    top = whole.join(deepest, "set").where("rank <= deepest").drop("deepest")
    others = depth.join(top, "set").where("rank <= depth").select("request", "key", "path", "score", "distance")
    # own rows only add, so of an entry that is in both, the touched form has the greater score and the lesser distance
    rows = both.unionByName(others).repartition("request").groupBy("request", "key", "path").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))
    return _ranked(rows, "request").where(F.col("rank") <= most).select("request", "key", "path", "score", "rank")
