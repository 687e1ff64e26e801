"""The chunk collection: a table of chunks by domain that is changed by whole versions.

A change writes the partitions that it touches to a new folder, reads them back and counts them, and only then writes
the next manifest, which names for each domain its folder, the model of its vectors and its count. Readers follow the
latest manifest, so a writer or executor that is lost on the way leaves the old version readable, and of two writers that
began with the same version one fails.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, text string, source string, domain string, clause string, heading string, ordinal int, embedding array<float>"
MANIFEST = "domain string, folder string, model string, n bigint"


class WrongModel(ValueError):
    """The collection's vectors come from another model than is asked for."""


class Collection:
    """Chunks below ``path``, with vectors of one ``model``. Chunks have the columns of ``CHUNK``; the id is unique in a domain."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def version(self) -> int:
        """The number of the latest manifest that is whole; 0 before the first."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        whole = [f.getPath().getName() for f in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in whole), default=0)

    def manifest(self, version: int | None = None) -> list[tuple[str, str, str, int]]:
        """A row a domain."""
        version = self.version() if version is None else version
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/v{version}").orderBy("domain").collect()] if version else []

    def verify(self, rows: list[tuple[str, str, str, int]]) -> None:
        other = sorted({(d, m) for d, _, m, _ in rows if m != self.model})
        if other:
            raise WrongModel(f"vectors of {other} were made by another model than {self.model}")

    def _publish(self, version: int, rows: list[tuple[str, str, str, int]]) -> None:
        """The next manifest; if another writer was first, its folder exists and this fails."""
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/v{version + 1}")

    def _folder(self, rows: list[tuple[str, str, str, int]]) -> DataFrame:
        parts = [self.spark.read.schema(CHUNK).parquet(f"{f}/domain={d}").withColumn("domain", F.lit(d)) for d, f, _, _ in rows]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], CHUNK)

    def read(self) -> DataFrame:
        rows = self.manifest()
        self.verify(rows)
        return self._folder(rows).select(*[c.split()[0] for c in CHUNK.split(", ")])

    def counts(self) -> dict[str, int]:
        return {d: n for d, _, _, n in self.manifest()}

    def upsert(self, chunks: DataFrame) -> dict[str, int]:
        """Chunks put in by id, replacing those that are there; the domains' counts, read back from what was written.

        Putting in the same chunks twice changes nothing. Of chunks with one id in one call the least by all columns stays.
        A domain that the call does not touch keeps its folder.
        """
        version = self.version()
        held = self.manifest(version)
        self.verify(held)
        names = [c.split()[0] for c in CHUNK.split(", ")]
        new = chunks.select(*[F.col(n).cast(k).alias(n) for n, k in (c.split(" ", 1) for c in CHUNK.split(", "))])
        own = [n for n in names if n not in ("domain", "chunk_id")]
        new = new.groupBy("domain", "chunk_id").agg(F.min(F.struct(*own)).alias("_c")).select("domain", "chunk_id", "_c.*")
        touched = {r[0] for r in new.select("domain").distinct().collect()}  # a row a domain
        if not touched:
            return {d: n for d, _, _, n in held}
        old = self._folder([r for r in held if r[0] in touched]).join(new.select("domain", "chunk_id"), ["domain", "chunk_id"], "left_anti")
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        new.select(*names).unionByName(old.select(*names)).write.partitionBy("domain").parquet(folder)
        asked = new.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
        written = self._folder([(d, folder, self.model, 0) for d in sorted(touched)])
        found = {r["domain"]: (r["n"], r["ids"]) for r in written.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids")).collect()}
        short = [r["domain"] for r in asked if r["domain"] not in found or found[r["domain"]][0] < r["n"] or found[r["domain"]][0] != found[r["domain"]][1]]
        if short:
            raise OSError(f"fewer chunks were read back than written: {short}")
        rows = [r for r in held if r[0] not in touched] + [(d, folder, self.model, found[d][0]) for d in sorted(touched)]
        self._publish(version, rows)
        return {d: n for d, _, _, n in rows}

    def drop(self, domain: str) -> None:
        """The next version lacks the domain; its folder stays for readers of versions before."""
        version = self.version()
        held = self.manifest(version)
        if any(r[0] == domain for r in held):
            self._publish(version, [r for r in held if r[0] != domain])
