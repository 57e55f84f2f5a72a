"""Stored tables with one row per key that batches upsert: buckets of files behind a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofact.sources.sinks import exists


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class KeyedState:
    """A table with one row per ``key``, changed by batches at the cost of the batch and the buckets that it touches.

    Rows are in buckets by the hash of their key. A bucket has a base and deltas, folders of Parquet that never change;
    the manifest, a table of one file, names each bucket's folders and is written last, so readers and failed or repeated
    batches see whole versions. Writers take turns: of two that write the same version one fails.

    With ``order`` the state is guarded: a row takes the place of the stored one only if its tuple of these columns is
    greater, whatever the order of batches; columns in ``first`` keep the values of the key's first row, by ``first_by``
    within a batch. Without ``order`` rows are only added (insert or ignore). Rows with a null in their key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str] | None = None, first: list[str] | None = None, first_by: list[str] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets
        self.order, self.first = list(order or []), list(first or [])
        self.first_by = list(first_by or self.order)
        self.version, self.applied = 0, -1
        #: bucket -> its folders, the oldest first
        self.parts: dict[int, list[str]] = {}
        self.schema: T.StructType | None = None
        self._load()

    def _load(self) -> None:
        if not exists(self.spark, f"{self.path}/manifest"):
            return
        table = self.spark.read.parquet(f"{self.path}/manifest")
        last = table.groupBy("version").agg(F.max("applied").alias("applied"), F.max("schema").alias("schema"), F.max("buckets").alias("buckets"), F.sort_array(F.collect_list(F.struct("place", "bucket", "folder"))).alias("parts")).orderBy(F.desc("version")).first()
        self.version, self.applied, self.buckets, self.schema = last["version"], last["applied"], last["buckets"], T.StructType.fromDDL(last["schema"])
        self.parts = {}
        for p in last["parts"]:
            if p["folder"] is not None:
                self.parts.setdefault(p["bucket"], []).append(p["folder"])

    def _commit(self, parts: dict[int, list[str]], applied: int, schema: T.StructType) -> None:
        """Writes the next version; nothing of the state changes before."""
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        rows = [(i, b, f, applied, self.buckets, ddl) for i, (b, f) in enumerate((b, f) for b, fs in sorted(parts.items()) for f in fs)] or [(0, None, None, applied, self.buckets, ddl)]
        table = self.spark.createDataFrame(rows, "place int, bucket int, folder string, applied long, buckets int, schema string")
        table.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={self.version + 1}")
        self.version, self.applied, self.parts, self.schema = self.version + 1, applied, parts, schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _fold(self, rows: DataFrame) -> DataFrame:
        """One row per key: the greatest tuple's (or the least row where nothing guards), with the first values of ``first``."""
        rest = [c for c in rows.columns if c not in self.key]
        kept = rows.dropna(subset=self.key)
        if not self.order:
            return kept.groupBy(*self.key).agg(F.min_by(F.struct(*rest), F.struct(*self.first_by, *rest)).alias("_r")).select(*self.key, "_r.*") if rest else kept.distinct()
        first, later = [c for c in rest if c in self.first], [c for c in rest if c not in self.first]
        aggs = [F.max_by(F.struct(*later), F.struct(*self.order, *later)).alias("_l")]
        if first:
            aggs.append(F.min_by(F.struct(*first), F.struct(*self.first_by, *first)).alias("_f"))
        return kept.groupBy(*self.key).agg(*aggs).select(*self.key, *[F.col(f"_f.{c}" if c in first else f"_l.{c}").alias(c) for c in rest])

    def _read(self, parts: dict[int, list[str]]) -> DataFrame:
        """The rows of some buckets; only those of buckets with several folders are merged."""
        paths = [[f"{self.path}/data/{f}/bucket={b}" for b, fs in sorted(parts.items()) for f in fs if (len(fs) > 1) == several] for several in (False, True)]
        plain, layered = (self.spark.read.schema(self.schema).parquet(*p) if p else self.spark.createDataFrame([], self.schema) for p in paths)
        if not self.order or not paths[1]:
            return plain.unionByName(layered)
        rest = [c for c in self.schema.names if c not in self.key]
        merged = layered.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_r")).select(*[F.col(c) if c in self.key else F.col(f"_r.{c}").alias(c) for c in self.schema.names])
        return plain.unionByName(merged) if paths[0] else merged

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The state, or that of some buckets."""
        if self.schema is None:
            raise ValueError(f"nothing is stored at {self.path}")
        return self._read(self.parts if buckets is None else {b: self.parts[b] for b in buckets if b in self.parts})

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """Writes rows with their bucket and tells the buckets that got any."""
        path = f"{self.path}/data/{folder}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [int(n.removeprefix("bucket=")) for n in folders(self.spark, path) if n.startswith("bucket=")]

    def upsert(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Takes a batch in and returns the rows that it inserted or moved, as stored.

        ``batch`` numbers batches upwards; one that was taken in before changes nothing, and the last one gives its rows
        again. Without a number a repeated batch changes nothing either, as no tuple of it is greater than the stored one.
        The batch is evaluated once; of the stored rows only those of its buckets are read.
        """
        if batch is not None and batch <= self.applied:
            done = {b: fs[-1:] for b, fs in self.parts.items() if batch == self.applied and fs[-1].startswith(f"delta-{batch:012d}-")}
            return self._read(done)
        names = rows.columns
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if self.schema is not None and sorted(schema.names) != sorted(self.schema.names):
            raise ValueError(f"columns {sorted(schema.names)} differ from those stored, {sorted(self.schema.names)}")
        number = self.applied if batch is None else batch
        folder = f"delta-{max(number, 0):012d}-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        staged = f"staged-{folder}"
        touched = self._write(self._fold(rows).withColumn("bucket", self._bucket()), staged)
        stored = {b: self.parts[b] for b in touched if b in self.parts}
        if not stored:
            got = touched
            self._rename(staged, folder)
        else:
            new = self.spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/data/{staged}")
            got = self._write(self._winners(new, self._read(stored), names), folder)
            remove(self.spark, f"{self.path}/data/{staged}")
        self._commit({b: self.parts.get(b, []) + ([folder] if b in got else []) for b in {*self.parts, *got}}, number, self.schema or schema)
        return self._read({b: [folder] for b in got})

    def _rename(self, old: str, new: str) -> None:
        paths = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{n}") for n in (old, new)]
        if not paths[0].getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(*paths):
            raise OSError(f"{old} can't be renamed")

    def _winners(self, new: DataFrame, stored: DataFrame, names: list[str]) -> DataFrame:
        """Rows of a folded batch that the state lacks or whose tuple is greater than the stored one."""
        if not self.order:
            return new.join(stored.select(*self.key), self.key, "left_anti")
        first = [c for c in names if c in self.first]
        held = stored.select(*self.key, F.struct(*self.order).alias("_order"), F.struct(*first, *self.key).alias("_first"))
        both = new.join(held, self.key, "left").where(F.col("_order").isNull() | (F.struct(*self.order) > F.col("_order")))
        kept = [F.when(F.col("_order").isNotNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c) if c in first else F.col(c) for c in names]
        return both.select(*kept, "bucket")

    def compact(self, most: int = 8) -> list[int]:
        """Rewrites the buckets with more than ``most`` folders as a new base, and names them."""
        full = [b for b, fs in self.parts.items() if len(fs) > most]
        if full:
            folder = f"base-{self.version + 1}-{uuid.uuid4().hex[:8]}"
            self._write(self.read(full).withColumn("bucket", self._bucket()), folder)
            self._commit({b: [folder] if b in full else fs for b, fs in self.parts.items()}, self.applied, self.schema)
        return full

    def vacuum(self, versions: int = 2) -> list[str]:
        """Deletes folders that the last ``versions`` versions don't name, and older manifests; call it while nothing reads them."""
        old = range(1, self.version - versions + 1)
        table = self.spark.read.parquet(f"{self.path}/manifest").where(F.col("version") > self.version - versions)
        named = {r["folder"] for r in table.select("folder").distinct().collect()}
        gone = [f for f in folders(self.spark, f"{self.path}/data") if f not in named]
        for f in gone:
            remove(self.spark, f"{self.path}/data/{f}")
        for v in old:
            remove(self.spark, f"{self.path}/manifest/version={v}")
        return gone
