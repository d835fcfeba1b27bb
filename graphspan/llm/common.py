"""What the training-data operators share: scratch tables in the shared folder, batches of bounded size, joins chosen by size."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker, and of text that a worker handles at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20

_own: dict[str, str] = {}
_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[[^,]*\]|\[.*,.*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphspan-")
    return _own[app]


def drop(path: str) -> None:
    """Delete a scratch table, on whatever file system it is."""
    spark = _live.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_live):
        try:
            drop(path)
        except Exception:  # the JVM may be gone by now
            return


def stored(df: DataFrame, name: str, compression: str = "zstd", path: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table and read it again: cuts the lineage, survives lost executors.  A scratch table in the shared folder,
    or a table to keep if a path is given."""
    spark = df.sparkSession
    to = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(to)
    if path is None:
        _live[to] = spark
    path = to
    return spark.read.schema(df.schema).parquet(path), path


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep_tables: bool = False) -> DataFrame:
    """mapInArrow with batches bounded by bytes: the session's bound is lowered where it is greater, as a bound on rows alone
    lets a batch of long texts outgrow its worker.  One longer row is a batch by itself.  A worker, which Spark keeps for later
    stages, gives back what it doesn't need before and after."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    jvm_bytes = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < jvm_bytes(conf.get(key)) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _return_memory(keep_tables)
        yield from run(batches)
        _return_memory(True)

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores after it while a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, columns: list[str] | None = None, name: str = "_row") -> DataFrame:
    """Some or all columns of docs with a number that tells all rows apart (nulls and repeated ids among them) and is the same
    in every scan.  Of a plain scan of Parquet files it is a row's file and its place in it; anything else is stored with a
    number first."""
    columns = list(docs.columns) if columns is None else columns
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation" or plan.relation().fileFormat().toString() != "Parquet":
        return stored(docs.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered")[0]
    file, first = free_name(columns, "_file"), free_name(columns, "_first")
    at = docs.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    files = sorted(r[0] for r in at.select(file).distinct().collect())
    starts = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"`{file}` string, `{first}` bigint")
    return at.join(F.broadcast(starts), file).select(*columns, (F.col(first) + F.col(name)).alias(name))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes (as JSON text); reads no more rows than that."""
    n, total = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("k")).agg(F.count("k"), F.coalesce(F.sum("k"), F.lit(0))).first()
    return n <= rows and total <= size


def lookup_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join facts to a dim with one row per key.

    A dim of at most ``rows`` rows and BROADCAST_BYTES is broadcast.  A larger one is shuffled; a hot key on the facts' side is then split
    by the adaptive skew join, as the dim has a single row of it to copy.
    """
    return facts.join(F.broadcast(dim) if small_enough(dim, rows) else dim.hint("merge"), keys, how)


#: Tables that a worker keeps from task to task (vocabulary lookups); dropped when it turns to other work.
worker_tables: dict = {}


def _return_memory(keep_tables: bool) -> None:
    """Give memory that a reused Python worker doesn't need back to the system."""
    if not keep_tables:
        worker_tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; one longer text is a batch by itself."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = batch.num_rows
        if col.nbytes <= limit or n <= 1:
            if n:
                yield batch
            continue
        size = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        begin = total = 0
        for i, k in enumerate(size):
            if total + k > limit and i > begin:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += k
        yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is no longer referenced, rather than when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
