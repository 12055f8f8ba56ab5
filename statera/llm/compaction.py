"""A store of immutable shards with size-tiered compaction and a versioned manifest, with DataFrame functions only."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statera.llm.common import fresh_path

#: Merges that one Spark job does: each is a task, and the plan has a branch for each.
MERGES_AT_ONCE = 64
#: Rows of a manifest version.
SHARDS = "file string, rows long, bytes long, schema string"


class ShardStore:
    """Rows in immutable Parquet shards below ``path``. A version of the manifest lists the shards that make up the table.

    data/<run>/ holds what one write left, manifest/<version>/ a version: file, rows, bytes and schema of each shard. A version is written
    aside and renamed into place, which fails if the version exists: readers see the old version or the new one, and of two
    writers one wins and the other starts again from the winner's version. That takes a file system with an atomic rename that does not
    overwrite, as HDFS and local disks have and plain object stores do not. Shards that a version dropped stay for its readers
    until :meth:`expire`, which also deletes what lost rounds and writers that died left. Columns go by name; a column that some shards lack is null in their rows, and a column whose type differs
    between shards is an error. Nulls, empty and long texts and repeated rows are rows like others; empty tables add no shard.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions committed so far, in order."""
        home = self._path(f"{self.path}/manifest")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(home) if x.getPath().getName().isdigit()) if self._fs.exists(home) else []

    def last(self) -> int:
        """The last version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, rows, bytes, schema) of a version, the last by default; version 0 has no rows."""
        version = self.last() if version is None else version
        return self.spark.read.schema(SHARDS).parquet(f"{self.path}/manifest/{version}") if version else self.spark.sql("SELECT '' AS file, 0L AS rows, 0L AS bytes, '' AS schema").limit(0)

    def _commit(self, shards: DataFrame, version: int) -> None:
        aside, home = f"{self.path}/aside/{uuid.uuid4().hex}", self._path(f"{self.path}/manifest")
        shards.select("file", "rows", "bytes", "schema").coalesce(1).write.parquet(aside)
        self._fs.mkdirs(home)
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._context.rename(self._path(aside), self._path(f"{self.path}/manifest/{version}"), self.spark.sparkContext._gateway.new_array(kind, 0))

    def _won(self, shards: DataFrame, version: int) -> bool:
        """Commit ``version``, unless another writer did."""
        try:
            self._commit(shards, version)
        except Py4JJavaError:
            if version not in self.versions():
                raise
            return False
        return True

    def _written(self, rows: DataFrame, rows_per_shard: int = 0) -> DataFrame:
        """Write rows as shards and list them. A shard has at most ``rows_per_shard`` rows (0: what its task has)."""
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(run)
        files = self.spark.read.schema(rows.schema).parquet(run).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("file", "bytes").agg(F.count("*").alias("rows")).withColumn("schema", F.lit(rows.schema.json()))

    def append(self, rows: DataFrame, rows_per_shard: int = 0) -> int:
        """Add rows as new shards; the version that has them. The shards are written once, however often other writers win."""
        written = self._written(rows, rows_per_shard)
        while True:
            version = self.last()
            if self._won(self.manifest(version).unionByName(written), version + 1):
                return version + 1

    def schema(self, version: int | None = None) -> T.StructType:
        """The table's columns at a version, those of earlier shards first."""
        fields: dict[str, T.StructField] = {}
        for r in self.manifest(version).groupBy("schema").agg(F.min("file").alias("file")).orderBy("file", "schema").collect():
            for f in T.StructType.fromJson(json.loads(r.schema)).fields:
                if fields.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"column {f.name} has two types: {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])

    def merges(self, target: int, fan_in: int, version: int | None = None) -> DataFrame:
        """(tier, part, file): the merges due at a version. A tier holds shards under half of ``target`` whose sizes differ by less than ``fan_in`` times.

        In order of files a tier's shards are put together up to about ``target`` bytes. A merge is due if it has ``fan_in`` shards or
        reaches half of the target.
        """
        small = self.manifest(version).where(F.col("bytes") < target / 2)
        tier = F.floor(F.log(float(fan_in), F.greatest(F.col("bytes"), F.lit(1)).cast("double")))
        run = F.sum("bytes").over(W.partitionBy("tier").orderBy("file"))
        parts = small.withColumn("tier", tier).withColumn("part", F.floor((run - F.col("bytes")) / target))
        own = W.partitionBy("tier", "part")
        sized = parts.withColumn("n", F.count("*").over(own)).withColumn("sum", F.sum("bytes").over(own))
        return sized.where((F.col("n") > 1) & ((F.col("n") >= fan_in) | (F.col("sum") >= target / 2))).select("tier", "part", "file", "rows", "bytes")

    def compact(self, target: int = 128 << 20, fan_in: int = 4) -> int:
        """Merge until no merge is due; the last version. Each merge is one task that reads its shards and writes one file: no shuffle.

        The merges are planned, read and committed against one version, so what other writers commit between is neither lost nor merged
        twice: then this round's files are left unlisted and the round starts again.
        """
        while True:
            version = self.last()
            due = self.merges(target, fan_in, version)
            plan = due.groupBy("tier", "part").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("tier", "part").limit(MERGES_AT_ONCE).collect()
            if not plan:
                return version
            schema = self.schema(version)
            merged = reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(*r.files).coalesce(1) for r in plan))
            chosen = self.spark.sql(f"SELECT * FROM VALUES {', '.join(f'({r.tier}L, {r.part}L)' for r in plan)} AS t(tier, part)")
            old = due.join(F.broadcast(chosen), ["tier", "part"]).select("file")  # at most MERGES_AT_ONCE rows
            self._won(self.manifest(version).join(old, "file", "left_anti").unionByName(self._written(merged)), version + 1)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version, the last by default; None if no shard is listed. The driver lists a version's files, as for any scan."""
        version = self.last() if version is None else version
        files = [r.file for r in self.manifest(version).select("file").collect()]
        return self.spark.read.schema(self.schema(version)).parquet(*files) if files else None

    def expire(self, seconds: float = 86_400) -> int:
        """Delete versions that another followed at least ``seconds`` ago, and shards at least that old that no version left lists; the number of shards deleted.

        ``seconds`` is longer than any reader, compaction or append takes: a reader keeps its version's shards that long, and a
        writer what it has written and not committed yet. Shards of rounds that another writer won, and of writers that died, go as well.
        """
        versions, home = self.versions(), f"{self.path}/data"
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        age = lambda path: (now - self._fs.getFileStatus(self._path(path)).getModificationTime()) / 1000
        old = [v for v, after in zip(versions, versions[1:]) if age(f"{self.path}/manifest/{after}") >= seconds]
        if not self._fs.exists(self._path(home)):
            return 0
        kept = [self.manifest(v).select("file") for v in versions if v not in old]
        shard = F.regexp_extract("file", "[^/]+/[^/]+$", 0)  # run and file, however the scheme is written
        listed = reduce(DataFrame.unionByName, kept, self.manifest(0).select("file")).select(shard.alias("shard")).distinct()
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(home)
        aged = found.where(F.col("modificationTime") <= F.timestamp_millis(F.lit(now - int(1000 * seconds))))
        gone = [r.file for r in aged.select(F.col("path").alias("file")).withColumn("shard", shard).join(listed, "shard", "left_anti").collect()]
        for v in old:  # versions before their shards, so no version lists what isn't there
            self._fs.delete(self._path(f"{self.path}/manifest/{v}"), True)
        for f in gone:
            self._fs.delete(self._path(f), False)
        return len(gone)


def compacted_documents(docs: DataFrame, rows_per_shard: int = 2000, target: int = 128 << 20, arrivals: int = 3) -> DataFrame:
    """doc_id, n_chars, text_md5, lang, source of each row, read from a store to which ``docs`` came in ``arrivals`` as small shards and was compacted.

    Nulls stay null, repeated rows stay, columns beyond these are stored too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"))
    for k in range(arrivals):  # each row comes in one of them
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k), rows_per_shard)
    store.compact(target)
    stored = store.read()
    rows = docs.limit(0) if stored is None else stored
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), "lang", "source")
