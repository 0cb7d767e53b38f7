"""Document fingerprints from closed syncmers, with DataFrame functions only.

The alphabet is pieces: each character of a script that is written without spaces (UNSPACED), and the runs of other characters
between those and white space. Inner substrings are S = 2 pieces and k-mers K = 6: a k-mer is an anchor where the least
hash of its inner substrings lies at its first or last place. That depends on the k-mer alone, so equal passages have equal
anchors wherever they stand. A fingerprint is all of a text's anchors in their order, each a hash (40 bits) and a position,
as hex; likeness is the Jaccard similarity of two fingerprints' distinct hashes. A text in which no k-mer is closed, or of
fewer than K pieces, is its own single anchor; an empty or null text has no anchors, and two of those are alike (1.0).

Very long texts are fingerprinted whole. Rows of a repeated or null doc_id each get a row; among themselves they follow
each other by text (equal ones either way), nulls before all others. Empty tables give empty results. Other columns are
not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

S, K = 2, 6
#: Thai to Khmer blocks, kana, and Han characters.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"
#: Ranges of doc_ids at most (their bounds are a literal of the plan); with more rows than fill these, ranges grow and their
#: sorts spill.
MAX_RANGES = 100_000
#: Bounds that one step of a lookup compares.
FAN = 64
_DIGITS = 10


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: array<struct<position int, anchor long>>; positions count pieces from 0.

    Each step is a projection that the next one reads more than once, which keeps Catalyst from merging them (merged,
    an array would be built again for each of its elements).
    """
    words, inner = f"_{out}_words", f"_{out}_inner"
    df = df.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[{UNSPACED}]|[^ \t-\r{UNSPACED}]+"), F.lit(0)))
    n = F.size(words)
    none = F.array().cast("array<int>")
    df = df.withColumn(inner, F.transform(F.when(n >= S, F.sequence(F.lit(0), n - S)).otherwise(none), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))
    at = lambda i, d: F.get(F.col(inner), i + d)
    last = K - S
    closed = F.filter(F.when(n >= K, F.sequence(F.lit(0), n - K)).otherwise(none), lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, d) for d in range(1, last)]))
    whole = F.when(n > 0, F.array(F.struct(F.lit(0).alias("position"), _short(F.xxhash64(F.array_join(words, " "))).alias("anchor")))).otherwise(F.array().cast("array<struct<position:int,anchor:bigint>>"))
    anchors = F.transform(closed, lambda i: F.struct(i.alias("position"), _short(F.xxhash64(at(i, 0), at(i, S), at(i, 2 * S))).alias("anchor")))
    df = df.withColumn(out, anchors)
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(words, inner)


def _short(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - 4 * _DIGITS)


def as_text(anchors: str | Column) -> Column:
    """Each anchor as hash:position, in the text's order."""
    return F.array_join(F.transform(anchors, lambda a: F.concat(F.lpad(F.lower(F.hex(a["anchor"])), _DIGITS, "0"), F.lit(":"), F.lower(F.hex(a["position"])))), ",")


def hashes(anchors: str | Column) -> Column:
    """The distinct anchor hashes."""
    return F.array_distinct(F.transform(anchors, lambda a: a["anchor"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct anchor hashes, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / every)


def matched_positions(a: str, b: str) -> Column:
    """array<struct<position_a, position_b>>: where anchors of `b` first stand in `a` (both from with_anchors)."""
    hashes = F.transform(a, lambda x: x["anchor"])
    pairs = F.transform(b, lambda y: F.struct(F.get(F.transform(a, lambda x: x["position"]), (F.array_position(hashes, y["anchor"]) - 1).cast("int")).alias("position_a"), y["position"].alias("position_b")))
    return F.filter(pairs, lambda p: p["position_a"].isNotNull())


def with_range(docs: DataFrame, key: str, bounds: list[int], out: str) -> DataFrame:
    """Add `out`: how many of the ascending bounds are at most the key (null: 0), by FAN comparisons a level."""
    levels = [bounds]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1][::FAN])
    # folded to one literal at planning
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    below = lambda part: F.coalesce(F.size(F.filter(part, lambda b: b <= F.col(key))), F.lit(0))
    docs = docs.withColumn(out, below(literal(levels[-1])))
    for level in reversed(levels[:-1]):  # entry j of the level above is entry j * FAN here
        first = (F.col(out) - 1) * FAN
        docs = docs.withColumn(out, F.when(F.col(out) == 0, 0).otherwise(first + below(F.slice(literal(level), first + 1, FAN))))
    return docs.withColumn(out, F.when(F.col(key).isNull(), 0).otherwise(F.col(out)))


def with_next(docs: DataFrame, columns: list[str], rows: int, per_part: int = 1000) -> DataFrame:
    """Add next_<column> of the next document by doc_id (after the last: the first), without a global sort.

    Documents are dealt by ranges whose bounds are doc_ids that occur, so the one row that a range needs from its
    neighbour (its bound) is known where it is read and sent to both. Null doc_ids come first; equal doc_ids are
    ordered by the columns.
    """
    parts = max(1, min(MAX_RANGES, -(-rows // per_part)))
    probe = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q") if parts > 1 else F.lit(None).alias("q"), F.min("doc_id").alias("lo"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({b for b in probe["q"] or [] if probe["lo"] is None or b > probe["lo"]})
    docs, kept = with_range(docs, "doc_id", bounds, "_range"), docs.columns
    bucket = F.col("_range")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("ghost"))
    is_first = F.col("doc_id").isNull() if probe["nulls"] else F.col("doc_id") == F.lit(probe["lo"])
    ghost = F.when(is_first, F.lit(len(bounds))).when(F.col("doc_id").isin(bounds) if bounds else F.lit(False), bucket - 1)
    dealt = docs.withColumn("_at", F.explode(F.when(ghost.isNotNull(), F.array(own, F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(own))))
    dealt = dealt.select(*kept, F.col("_at.bucket").alias("_bucket"), F.col("_at.ghost").alias("_ghost"))
    # one specification for all, else each column gets an exchange of its own
    w = Window.partitionBy("_bucket").orderBy("_ghost", "doc_id", *columns)
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_ghost")).drop("_bucket", "_ghost")


def fingerprint_edits(docs: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id, n_chars, each text's fingerprint, the edited text with its own, and the likenesses of fingerprints.

    The edited text replaces the last floor(n_chars / 4) code points by as many (or all) first ones of the next text.
    """
    rows = docs.count() if rows is None else rows
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(base, ["text"], rows)
    n = F.length("text")
    quarter = F.expr("length(text) div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    out = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    # the next text's anchors are made again here, so that no more than the texts is shuffled
    for column, name in (("text", "own"), ("next_text", "next"), ("edited", "changed")):
        out = with_anchors(out, column, f"{name}_anchors").withColumn(f"{name}_hashes", hashes(f"{name}_anchors"))
    return out.select(
        "doc_id", "n_chars", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("own_anchors").alias("fingerprint"), as_text("changed_anchors").alias("edited_fingerprint"),
        likeness("own_hashes", "changed_hashes").alias("near_edited"), likeness("own_hashes", "next_hashes").alias("near_next"),
    )
