"""A table with versions: changes are written aside and become the state by one atomic step, or not at all.

A table is a folder with ``data`` (rows that commits wrote), ``audit`` (what they did) and ``log``: a small file for each
generation, which names the folders that belong to it.  A writer prepares everything under names of its own and then creates the
next generation's file, which the file system lets exactly one writer do (as HDFS and local file systems do; an object store
needs conditional writes).  Whoever comes second finds the generation taken and is refused: nothing of it is ever seen.

A row carries its key and a version.  A change states the version that it expects to find, 0 for a new key; of a commit with any
change that doesn't find it, nothing is published.  The same request id again gives back what its first commit made.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import kept


class Conflict(Exception):
    """Another writer was first, or a change expects a version that isn't there; ``refused`` counts such changes."""

    def __init__(self, message: str, refused: int = 0):
        super().__init__(message)
        self.refused = refused


@dataclass
class Versioned:
    """A table at ``path`` whose rows are told apart by ``key``; ``schema`` has the key and the columns, no version."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    _fs: object = field(init=False, repr=False, default=None)

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _create(self, name: str, content: dict) -> bool:
        """Write a file that must not be there yet; whether this writer made it."""
        fs, at = self._at(name)
        try:
            out = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                return False
            raise e
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return True

    def log(self) -> list[dict]:
        """What each generation added, in order."""
        fs, at = self._at("log")
        if not fs.exists(at):
            return []
        files = sorted(s.getPath().toString() for s in fs.listStatus(at))
        rows = self.spark.read.text(files, wholetext=True).select(F.from_json("value", "generation long, data string, audit string, request string, digest string, base boolean").alias("x")).select("x.*").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["generation"])

    def generation(self) -> int:
        entries = self.log()
        return entries[-1]["generation"] if entries else 0

    def state(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation (the last one if none is named), with their versions."""
        entries = [e for e in self.log() if generation is None or e["generation"] <= generation]
        first = max((i for i, e in enumerate(entries) if e["base"]), default=0)
        folders = [f"{self.path}/{e['data']}" for e in entries[first:]]
        schema = f"{self.schema}, version bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        latest = Window.partitionBy(self.key).orderBy(F.desc("version"))
        return self.spark.read.schema(schema).parquet(*folders).withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")

    def audit(self) -> DataFrame:
        schema = f"{self.schema.split(',')[0]}, version bigint, action string, generation bigint"
        folders = [f"{self.path}/{e['audit']}" for e in self.log() if e["audit"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def checked(self, changes: DataFrame, generation: int | None = None) -> DataFrame:
        """changes (the schema's columns and ``expected``) with the version found and whether it is the one expected; of several
        changes of a key in one commit none is right."""
        now = self.state(generation).select(self.key, F.col("version").alias("found"))
        twice = F.count("*").over(Window.partitionBy(self.key))
        rows = changes.withColumn("_twice", twice).join(now, self.key, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
        return rows.withColumn("right", (F.col("expected") == F.col("found")) & (F.col("_twice") == 1)).drop("_twice")

    def commit(self, changes: DataFrame, request: str | None = None, seen: int | None = None, base: bool = False) -> int:
        """Publish changes as the next generation, and return it.  seen: the generation that the caller has worked with (else
        the last one); base: the changes are the whole state, what came before need not be read again."""
        entries = self.log()
        digest = self._digest(changes)
        for e in entries:
            if request is not None and e["request"] == request:
                if e["digest"] != digest:
                    raise Conflict(f"request {request} was used for other changes")
                return e["generation"]
        last = entries[-1]["generation"] if entries else 0
        seen = last if seen is None else seen
        if seen != last:
            raise Conflict(f"generation {seen} is no longer the last one")
        rows = kept(self.checked(changes, seen) if not base else changes.withColumns({"found": F.lit(0).cast("long"), "right": F.lit(True)}))
        refused = rows.filter("not right").count()
        if refused:
            raise Conflict(f"{refused} changes expect another version", refused)
        own = uuid.uuid4().hex
        columns = [c for c in rows.columns if c not in ("expected", "found", "right")]
        rows.select(*columns, (F.col("found") + 1).alias("version")).write.parquet(f"{self.path}/data/{own}")
        action = F.when(F.col("found") == 0, "insert").otherwise("update").alias("action")
        rows.select(self.key, (F.col("found") + 1).alias("version"), action, F.lit(seen + 1).cast("long").alias("generation")).write.parquet(f"{self.path}/audit/{own}")
        entry = {"generation": seen + 1, "data": f"data/{own}", "audit": f"audit/{own}", "request": request, "digest": digest, "base": base}
        if not self._create(f"log/{seen + 1:012d}.json", entry):
            raise Conflict(f"another writer made generation {seen + 1}")
        return seen + 1

    def _digest(self, changes: DataFrame) -> str:
        """Of the changes, whatever their order."""
        row = F.xxhash64(*sorted(changes.columns))
        n, a, b = changes.select(row.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("h")), F.lit(0))).first()
        return f"{n}-{a}-{b}"


@dataclass
class Served:
    """What is built from a versioned table and served: it counts only for the generation that it was built from."""

    table: Versioned

    def publish(self, built: DataFrame, generation: int) -> bool:
        """Write what was built from a generation aside; it is published only if that is still the last one."""
        own = uuid.uuid4().hex
        built.write.parquet(f"{self.table.path}/served/{own}")
        if self.table.generation() != generation:
            return False
        return self.table._create(f"serving/{generation:012d}.json", {"generation": generation, "data": f"served/{own}"})

    def read(self) -> DataFrame | None:
        """What is served, or None if the table has gone on since: a reader asks for a new build then, and never sees an old one."""
        last = self.table.generation()
        fs, at = self.table._at(f"serving/{last:012d}.json")
        if not last or not fs.exists(at):
            return None
        entry = self.table.spark.read.text(at.toString(), wholetext=True).first()[0]
        return self.table.spark.read.parquet(f"{self.table.path}/{json.loads(entry)['data']}")
