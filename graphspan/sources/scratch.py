"""Tables that several steps read again: written once to the folder all executors share, instead of being computed for each use."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files up to which Spark may broadcast a table by their size alone.
FILE_BROADCAST = 256 << 10

_own: dict[str, str] = {}
_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in one process."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[[^,]*\]|\[.*,.*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphspan-")
    return _own[app]


def broadcast_by_measure(spark: SparkSession) -> None:
    """A side is broadcast without being told to only if what was shuffled of it was measured to be small: the sizes of files say
    little, as a table of 10 MB may be millions of rows, which the driver then has to hold."""
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    told = spark.conf.get(static)
    if not told.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told) > FILE_BROADCAST:
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, told)
        spark.conf.set(static, str(FILE_BROADCAST))


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches have at most so many bytes, or one row; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= size:
        spark.conf.set(key, str(size))


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    broadcast_by_measure(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """Join facts to a dim, which is broadcast only if it was counted to have at most so many rows and bytes (as JSON text); a
    larger one is shuffled."""
    n, total = dim.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("k")).agg(F.count("k"), F.coalesce(F.sum("k"), F.lit(0))).first()
    few = n <= rows and total <= size
    return facts.join(F.broadcast(dim) if few else dim.hint("merge"), keys, how)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_live.items()):
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone by now
            return
