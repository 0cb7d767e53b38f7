"""Helpers shared by the corpus operators: shared folder, tables that cut lineage, gapless numbering, safe names."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that the vectorised stages hold as numpy arrays at once (a longer document is one chunk).
CHUNK_BYTES = 600_000
#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts are long, and a worker and its JVM hold
#: batches several times over.
BATCH_ROWS = 2000
#: Neighbouring rows of a file that make a block.
BLOCK_ROWS = 16_384


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a `local` session (one machine, as in tests) gets a folder of its own; any other is an error,
    since executors elsewhere would not see that folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.stratalog.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.stratalog.scratch", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """Set BATCH_ROWS unless the session was given another number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratalog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table and file that this application's operators wrote to the shared folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stratalog/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named u0, u1, ..., and what each was called: no name of the user's can clash or break."""
    named = {c: f"u{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*named.values()), named


def given_names(df: DataFrame, named: dict[str, str], *more: Column) -> DataFrame:
    """The reverse of own_names, with further columns behind; a given column whose name one of those has gives way."""
    taken = {df.select(m).columns[0] for m in more}
    return df.select(*[F.col(u).alias(c) for c, u in named.items() if c not in taken], *more)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """A stored copy with `row`, a number of the row that no other has, whatever its doc_id is."""
    return stored(docs.withColumn("row", F.monotonically_increasing_id()), name)


def with_blocks(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under own names with `block`, a number that BLOCK_ROWS neighbouring rows of a file share, and `at`, the
    row's place among them; and what each column was called.

    Every later pass over the same table gives the same numbers, however its files are cut into tasks. Rows that do not
    come from files as they are (no file metadata, or that of several) are stored first.
    """
    hidden = docs._jdf.queryExecution().analyzed().metadataOutput().mkString(" ")
    from_file = "_metadata" not in docs.columns and hidden.count("_metadata#") == 1
    docs, named = own_names(docs)
    if not from_file:
        docs = stored(docs, "blocks")
    place = F.col("_metadata.row_index")
    block = F.xxhash64("_metadata.file_path", F.floor(place / F.lit(BLOCK_ROWS)))
    return docs.withColumns({"block": block, "at": F.pmod(place, F.lit(BLOCK_ROWS))}), named


def write_blocks(df: DataFrame, columns: list[str], name: str) -> str:
    """Write the rows of each block (column `block`) into one file of the shared folder; all columns are longs."""
    spark = df.sparkSession
    folder, width = scratch_path(spark, name), shuffle_width(spark)

    def run(batches):
        done = []

        def save(block, parts):
            def put(out):
                rows = [np.concatenate([p[i] for p in parts]) for i in range(len(columns))]
                out.write(b"".join(np.ascontiguousarray(r, "<i8").tobytes() for r in rows))

            write_whole(folder, f"{block}.rows", put)
            done.append(block)

        now, parts = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cols = [batch.column(c).to_numpy() for c in columns]
            cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts and blocks[a] != now:
                    save(now, parts)
                    parts = []
                now = int(blocks[a])
                parts.append([c[a:b].copy() for c in cols])
        if parts:
            save(now, parts)
        yield pa.RecordBatch.from_pydict({"block": pa.array(done, pa.int64())})

    dealt = df.select("block", *columns).repartition(width, "block").sortWithinPartitions("block", *columns)
    stored(dealt.mapInArrow(run, "block long"), f"{name}-written")
    return folder


def read_block(folder: str, block: int, columns: int) -> list[np.ndarray]:
    """The columns of a block's rows, ascending; a block without rows has no file."""
    from pyarrow import fs

    store, path = open_folder(folder)
    file = f"{path}/{block}.rows"
    if store.get_file_info(file).type == fs.FileType.NotFound:
        return [np.zeros(0, np.int64)] * columns
    with store.open_input_stream(file) as f:
        rows = np.frombuffer(f.read(), "<i8")
    return list(rows.reshape(columns, -1))


def open_folder(uri: str):
    """(file system, path) of a shared folder, of any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_whole(folder: str, name: str, write) -> str:
    """Let write(stream) make a file under a name of this attempt, then rename it: a retried task leaves one whole file."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as out:
        write(out)
    store.move(tmp, f"{path}/{name}")
    return f"{path}/{name}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless(df: DataFrame, keys: list[str], order: list[Column], salt: Column, weight: str | None, out: str) -> DataFrame:
    """Add `out`: the 0-based running position (or sum of `weight` before the row) in each group of `keys`.

    `salt` splits a group over tasks; only one total per (group, salt) is gathered to number the parts, so a
    group of any size is spread. Positions are gapless; rows follow `salt` and then `order`.
    """
    amount = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    salted = df.withColumn("_salt", salt)
    parts = salted.groupBy(*keys, "_salt").agg(F.sum(amount).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        parts = parts.withColumn("_all", F.lit(0))
        before = Window.partitionBy("_all").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base")
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), base)
    on = F.col("_salt") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    if weight is None:
        inside = F.row_number().over(within).cast("long") - 1
    else:
        inside = F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = salted.join(parts, on).withColumn(out, F.col("_base") + inside)
    return numbers.drop("_salt", "_s", "_base", *[f"_k_{k}" for k in keys])


def salts_for(rows: int, per_part: int = 50_000) -> int:
    return max(1, -(-rows // per_part))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an Arrow binary or string column, without copying the bytes; a null is an empty slice."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges [a, b) of whole documents whose bytes sum to `most` at most, or single longer ones."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def some_rows(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of some of the rows, in their order."""
    if len(rows) == len(offsets) - 1:
        return data, offsets
    lens = offsets[rows + 1] - offsets[rows]
    cut = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    flat = np.concatenate([data[offsets[j] : offsets[j + 1]] for j in rows]) if len(rows) else data[:0]
    return flat, cut


def free_memory() -> None:
    """Give back what earlier tasks of this worker process left: Spark uses workers again, and allocators keep freed pages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
