"""Several append-only tables behind one atomic pointer.

A commit stages the new rows of all its tables first, where no reader looks, and then publishes one manifest that names
the staged folders beside those of the snapshot before. The manifest's name is the next version; it appears by a rename
that fails if the name is taken, so of two writers one wins, and the other compares its rows with the new snapshot and
tries again. Readers resolve a table through the newest manifest, or through an older one: they see all tables of a
commit or none, whatever dies in between. Rows are told apart by their keys; a key that is stored with other immutable
values, or that occurs twice in a batch with different ones, refuses the whole commit.

Files are named through Spark's own file systems, so a folder may be in any store that Spark reads; the rename must be
atomic there, as it is in HDFS and in local folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOMES = ("created", "reused", "drifted")


class Drift(ValueError):
    """Rows of a batch contradict what is stored, or one another; nothing was published."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__("other immutable values than stored: " + ", ".join(f"{n} rows of {name}" for name, n in counts.items() if n))
        self.counts = counts


class Contended(RuntimeError):
    """Other writers published first each time."""


@dataclass
class Batch:
    """Rows for one table, the columns that name a row, and those that may never change."""

    rows: DataFrame
    key: list[str]
    immutable: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.immutable = self.immutable or [c for c in self.rows.columns if c not in self.key]


@dataclass
class Commit:
    version: int
    counts: dict[str, dict[str, int]]
    published: bool


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    # Manifests -----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version; 0 if nothing was published."""
        at = self._path("_manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {"schema", "parts": [{"path", "rows"}]}}} of a version, the newest if none is named."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path(f"_manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """False if another writer has published this version."""
        target, staged = self._path(f"_manifests/{manifest['version']:012d}.json"), self._path(f"_manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(staged, target, options)
        except Py4JJavaError as why:
            self._fs.delete(staged, False)
            if "FileAlreadyExistsException" not in str(why.java_exception.getClass().getName()):
                raise
            return False
        return True

    # Reading -------------------------------------------------------------------------------------------------------

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is named; KeyError if it has none."""
        return self._read(name, self.manifest(version))

    def _read(self, name: str, manifest: dict) -> DataFrame:
        held = manifest["tables"][name]
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        paths = [f"{self._folder}/{p['path']}" for p in held["parts"] if p["rows"]]
        return self._spark.read.schema(schema).parquet(*paths) if paths else self._spark.createDataFrame([], schema)

    # Writing -------------------------------------------------------------------------------------------------------

    def classified(self, name: str, batch: Batch, manifest: dict | None = None) -> DataFrame:
        """The batch's rows, one for each key, with outcome: created, reused or drifted. One aggregation and one join by key."""
        manifest = self.manifest() if manifest is None else manifest
        same = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if _has_map(batch.rows.schema[c].dataType) else F.col(c) for c in batch.immutable]) if batch.immutable else F.lit(0).cast("long")
        rest = [c for c in batch.rows.columns if c not in batch.key]
        told = batch.rows.withColumn("_same", same).groupBy(*batch.key).agg(F.first(F.struct(*rest) if rest else F.lit(0)).alias("_row"), F.min("_same").alias("_same"), (F.min("_same") != F.max("_same")).alias("_torn"))
        stored = F.lit(None).cast("long")
        if name in manifest["tables"]:
            old = self._read(name, manifest).withColumn("_stored", same).select(*batch.key, "_stored")
            told, stored = told.join(old, batch.key, "left"), F.col("_stored")
        outcome = F.when(F.col("_torn") | (stored != F.col("_same")), "drifted").when(stored.isNull(), "created").otherwise("reused")
        return told.select(*[F.col(c) if c in batch.key else F.col(f"_row.{c}").alias(c) for c in batch.rows.columns], outcome.alias("outcome"))

    def _staged(self, name: str, batch: Batch, manifest: dict) -> tuple[str, dict[str, int]]:
        """(the folder of a table's new rows, rows by outcome). Outcomes are folders, so what is new is read alone."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        self.classified(name, batch, manifest).write.partitionBy("outcome").parquet(f"{self._folder}/{path}")
        written = self._spark.read.parquet(f"{self._folder}/{path}") if self._any(path) else None
        counts = {r["outcome"]: r["count"] for r in written.groupBy("outcome").count().collect()} if written is not None else {}
        return path, {o: counts.get(o, 0) for o in OUTCOMES}

    def _any(self, path: str) -> bool:
        return any(s.isDirectory() for s in self._fs.listStatus(self._path(path)))

    def plan(self, batches: dict[str, Batch]) -> DataFrame:
        """(table, outcome, n): what a commit would do, without writing."""
        manifest = self.manifest()
        found = [self.classified(name, b, manifest).groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "outcome", "n") for name, b in batches.items()]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def commit(self, batches: dict[str, Batch], attempts: int = 5) -> Commit:
        """Publishes the new rows of all tables at once. Nothing new publishes nothing; Drift refuses everything."""
        for _ in range(attempts):
            base = self.manifest()
            staged = {name: self._staged(name, b, base) for name, b in batches.items()}
            counts = {name: told for name, (_, told) in staged.items()}
            if any(told["drifted"] for told in counts.values()):
                raise Drift({name: told["drifted"] for name, told in counts.items()})
            if not any(told["created"] for told in counts.values()) and set(batches) <= set(base["tables"]):
                return Commit(base["version"], counts, False)
            tables = {name: dict(held) for name, held in base["tables"].items()}
            for name, (path, told) in staged.items():
                before = tables.get(name, {"schema": batches[name].rows.schema.json(), "parts": []})
                tables[name] = before | {"parts": [*before["parts"], *([{"path": f"{path}/outcome=created", "rows": told["created"]}] if told["created"] else [])]}
            if self._publish({"version": base["version"] + 1, "tables": tables}):
                return Commit(base["version"] + 1, counts, True)
        raise Contended(f"{attempts} attempts")

    def compact(self, name: str) -> Commit:
        """One part in place of a table's many, as a new version; older versions keep theirs."""
        base = self.manifest()
        path = f"data/{name}/{uuid.uuid4().hex}/outcome=created"
        self._read(name, base).write.parquet(f"{self._folder}/{path}")
        n = sum(p["rows"] for p in base["tables"][name]["parts"])
        tables = base["tables"] | {name: base["tables"][name] | {"parts": [{"path": path, "rows": n}]}}
        if not self._publish({"version": base["version"] + 1, "tables": tables}):
            raise Contended("published by another writer")
        return Commit(base["version"] + 1, {name: {"created": 0, "reused": n, "drifted": 0}}, True)

    def orphans(self) -> list[str]:
        """Staged folders that no version names: of commits that were refused, or that died."""
        named = {p["path"].split("/outcome=")[0] for v in range(1, self.version() + 1) for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        if not self._fs.exists(self._path("data")):
            return []
        found = [f"data/{t.getPath().getName()}/{s.getPath().getName()}" for t in self._fs.listStatus(self._path("data")) for s in self._fs.listStatus(t.getPath())]
        return sorted(set(found) - named)


def _has_map(kind: T.DataType) -> bool:
    """Maps have no hash of their own."""
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)
