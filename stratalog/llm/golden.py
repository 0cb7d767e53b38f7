"""Golden records: one surviving value a field for each cluster of records.

Records are unpivoted to long rows (cluster, field, value, priority struct); one generic minimum by (cluster, field) picks
every field's value, and the winners are pivoted back. A field that depends on another's winner (`within`) is settled
afterwards: its minima are kept by the value that the record has in the other field, and those under the winner come first.

Only `latest` (each cluster's last update) has to reach the records before the priorities are known. Clusters with a
thousandth of all rows or more are at most a thousand, so they alone are broadcast; the others are joined by cluster, and
the minima of those need no further shuffle. Hot clusters are reduced in every task before anything moves.

Defined cases. Strings that are empty or white space ([\\x20\\x09-\\x0D]) count as null in fields. A null source ranks behind
the named ones, like an unknown one. A null id gives way to any other and leaves *_from null. Records without a cluster
(all keys null) form one cluster, null. Rows that agree in all that ranks them are ordered by value, so repeated rows and
ties change nothing. A cluster without any value of a field has null there. An empty table gives no rows. Values may be of
any type that a cast to string and back leaves as it is; very long ones are kept whole. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A cluster with a 1/HOT_SHARE of all rows or more is joined by broadcast: there are HOT_SHARE of them at most.
HOT_SHARE = 1000
_BLANK = r"\A[\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Field:
    """A field of the golden record; several columns come from one record together.

    rule: `recent` (last updated, then trust, then id) or `trusted` (fresh, then trust, then recent). prefer: None,
    `longest` (most code points first) or `fullest` (most non-null columns first). within: records that have the winner of
    that field (of one column) come before all others.
    """

    name: str
    columns: tuple[str, ...]
    rule: str = "recent"
    prefer: str | None = None
    within: str | None = None


def _value(df: DataFrame, column: str) -> Column:
    """The column as text; null for blank strings."""
    c = F.col(f"`{column}`")
    return F.when(~c.rlike(_BLANK), c) if df.schema[column].dataType.typeName() in ("string", "varchar", "char") else c.cast("string")


def _long(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """One row for each record and field with a value, and one for the record itself (field '')."""
    no = F.lit(False)

    def priority(f: Field, values: Column) -> Column:
        lead = {"longest": -F.char_length(values[0]), "fullest": -F.size(F.filter(values, lambda v: v.isNotNull()))}.get(f.prefer, F.lit(0))
        trusted = f.rule == "trusted"
        first = [F.col("stale") if trusted else no, F.col("trust") if trusted else F.lit(0)]
        recent = [F.col("updated").isNull(), -(F.col("updated") - F.lit("1970-01-01").cast("timestamp_ntz")), F.col("trust"), F.col("id").isNull(), F.col("id")]
        return F.struct(*[c.alias(f"p{i}") for i, c in enumerate([lead.cast("int"), *first, *recent])])

    def row(name: str, values: Column, rank: Column, f: Field | None) -> Column:
        of, part = (F.lit(f.within), F.col(f"v_{f.within}")[0]) if f and f.within else (F.lit(None).cast("string"), F.lit(None).cast("string"))
        return F.struct(F.lit(name).alias("field"), values.alias("value"), rank.alias("priority"), of.alias("of"), part.alias("part"))

    some = [row(f.name, F.col(f"v_{f.name}"), priority(f, F.col(f"v_{f.name}")), f) for f in fields]
    record = row("", F.array(F.lit(None).cast("string")), priority(Field("", ()), F.array()), None)
    one = F.explode(F.array(record, *some)).alias("r")
    long = rows.select("cluster", "stale", "id", one).select("cluster", "stale", "id", "r.*")
    return long.where((F.col("field") == "") | F.exists("value", lambda v: v.isNotNull()))


def _best(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """The first row of each cluster and field (and value of the field that it depends on), with counts of records."""
    best = F.min(F.struct("priority", "value", "id")).alias("best")
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.col("stale").cast("long")).alias("n_stale")]
    return _long(rows, fields).groupBy("cluster", "field", "of", "part").agg(best, *counts)


def golden_records(records: DataFrame, keys: list[str], fields: list[Field], sources: list[str], record_id: str, source: str, updated_at: str, stale_after: str = "INTERVAL '720' HOUR") -> DataFrame:
    """cluster_id, n_records, n_stale, the fields' columns, and <field>_from: the id of the record that gave the value.

    A record's cluster is the first non-null of `keys`; `sources` are by falling trust. A record is stale if it has no time
    or one more than `stale_after` before its cluster's latest.
    """
    trust = F.coalesce(*[F.when(F.col(f"`{source}`") == s, F.lit(i)) for i, s in enumerate(sources)], F.lit(len(sources)))
    values = [F.array(*[_value(records, c) for c in f.columns]).alias(f"v_{f.name}") for f in fields]
    cluster = F.coalesce(*[F.col(f"`{k}`") for k in keys]).alias("cluster")
    rows = records.select(cluster, F.col(f"`{record_id}`").alias("id"), F.col(f"`{updated_at}`").cast("timestamp_ntz").alias("updated"), trust.alias("trust"), *values)

    stats = stored(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.max("updated").alias("latest")), "golden-clusters")
    total = stats.agg(F.sum("rows")).first()[0] or 0
    is_hot = (F.col("rows") * HOT_SHARE >= total) | F.col("cluster").isNull()
    hot = stats.where(is_hot).select(F.col("cluster").alias("h_cluster"), F.col("latest").alias("h_latest"), F.lit(True).alias("is_hot"))
    split = rows.join(F.broadcast(hot), F.col("cluster").eqNullSafe(F.col("h_cluster")), "left")  # HOT_SHARE rows and one at most
    stale = F.col("updated").isNull() | (F.col("updated") < F.col("latest") - F.expr(stale_after))
    warm = split.where("is_hot").withColumn("latest", F.col("h_latest")).withColumn("stale", stale)
    cold = split.where("is_hot IS NULL").select(*rows.columns).join(stats.where(~is_hot).select("cluster", "latest"), "cluster").withColumn("stale", stale)
    best = stored(_best(warm, fields).unionByName(_best(cold, fields)), "golden-best")

    # after its field: the minima under the winner come first
    names = ["cluster", "field", "best", "n", "n_stale"]
    free, bound = best.where("of IS NULL").withColumn("behind", F.lit(0)), best.where("of IS NOT NULL")
    won = best.where(F.col("field").isin([f.within for f in fields if f.within])).select(F.col("cluster").alias("w_cluster"), F.col("field").alias("w_field"), F.col("best.value")[0].alias("w_value"))
    same = F.col("cluster").eqNullSafe(F.col("w_cluster")) & (F.col("of") == F.col("w_field")) & (F.col("part") == F.col("w_value"))
    bound = bound.join(won, same, "left").withColumn("behind", F.col("w_field").isNull().cast("int"))
    every = free.select(*names, "behind").unionByName(bound.select(*names, "behind"))
    pick = [F.min(F.when(F.col("field") == f.name, F.struct("behind", "best"))).getField("best").alias(f"f_{f.name}") for f in fields]
    counts = [F.sum(F.when(F.col("field") == "", F.col(c))).alias(c) for c in ("n", "n_stale")]
    wide = every.groupBy("cluster").agg(*counts, *pick)
    cells = [F.col(f"f_{f.name}")["value"][i].cast(records.schema[c].dataType).alias(c) for f in fields for i, c in enumerate(f.columns)]
    origin = [F.col(f"f_{f.name}")["id"].alias(f"{f.name}_from") for f in fields]
    return wide.select(F.col("cluster").alias("cluster_id"), F.col("n").alias("n_records"), "n_stale", *cells, *origin)


#: The shop's clients: a name, an e-mail, a segment, a balance under that segment, and city with nation from one record.
CLIENT_FIELDS = [
    Field("name", ("name",), "trusted", prefer="longest"),
    Field("email", ("email",), "trusted"),
    Field("segment", ("segment",), "recent"),
    Field("balance", ("balance",), "recent", within="segment"),
    Field("address", ("city", "nation_id"), "trusted", prefer="fullest"),
]


def client_records(clients: DataFrame) -> DataFrame:
    """The golden record of each client: by master_id, else client_id."""
    return golden_records(clients, ["master_id", "client_id"], CLIENT_FIELDS, ["partner", "store", "web", "crm"], "client_id", "source", "updated_at")
