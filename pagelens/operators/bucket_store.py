"""Keyed tables that are changed by rewriting the buckets that a batch touches, and no other.

A table is Parquet files in buckets by the hash of its keys.  A commit writes the
touched buckets of one or several tables to new folders and then puts one manifest in
place by a rename that fails if the version is taken; readers follow the newest
manifest.  So a write that fails, or loses against another writer, changes nothing, and
the tables of one commit change together.  The driver holds the manifest: for each
table and bucket the folder that has it, no matter how many rows.

A site's rows lie in ``spread`` neighbouring buckets, by site and then by key: what
concerns one site touches those only, and a site with a third of all rows is still dealt
over them and, within a bucket, over several files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.operators.shared import cut

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer has committed meanwhile; nothing was changed."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: table -> its schema as JSON
    schemas: dict[str, str] = field(default_factory=dict)
    #: table -> bucket -> folder; a bucket without rows has none
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    #: whatever a caller keeps from commit to commit, such as the last number given
    counters: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "schemas": self.schemas, "folders": self.folders, "counters": self.counters})

    @staticmethod
    def from_json(text: str) -> Manifest:
        given = json.loads(text)
        return Manifest(given["version"], given["schemas"], {t: {int(b): f for b, f in own.items()} for t, own in given["folders"].items()}, given["counters"])


@dataclass(frozen=True)
class Commit:
    version: int
    #: table -> buckets that were written anew
    touched: dict[str, list[int]]


class BucketStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, spread: int = 8, rows_a_file: int = 5_000_000):
        self.spark, self.folder, self.buckets, self.spread, self.rows_a_file = spark, folder.rstrip("/"), buckets, min(spread, buckets), rows_a_file

    # -- files, through Spark's file systems -------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in (self._fs().globStatus(self._path(pattern)) or []))

    def _read_text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """A file that appears whole, and only if there is none of its name."""
        jvm, draft = self.spark._jvm, self._path(f"drafts/{uuid4().hex}")
        stream = self._fs().create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        self._fs().mkdirs(self._path(name).getParent())
        try:
            context.rename(draft, self._path(name), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(name) from e
            raise

    # -- reading ---------------------------------------------------------------------

    def manifest(self, version: int | None = None) -> Manifest:
        names = self._names("manifests/*.json")
        wanted = names[-1:] if version is None else [n for n in names if int(n[:-5]) == version]
        return Manifest.from_json(self._read_text(f"manifests/{wanted[0]}")) if wanted else Manifest()

    def bucket(self, site: Column, key: Column) -> Column:
        part = F.pmod(F.xxhash64(site), F.lit(self.buckets)) + F.pmod(F.xxhash64(key), F.lit(self.spread))
        return F.pmod(part, F.lit(self.buckets)).cast("int")

    def buckets_of_sites(self, sites: DataFrame) -> list[int]:
        """Buckets that hold the sites' rows: at most all buckets, however many sites."""
        first = F.pmod(F.xxhash64("site_id"), F.lit(self.buckets))
        each = sites.select(F.explode(F.sequence(first, first + self.spread - 1)).alias("b")).select(F.pmod("b", F.lit(self.buckets)).cast("int").alias("b"))
        return sorted(r.b for r in each.distinct().collect())

    def read(self, table: str, buckets: Iterable[int] | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """The table, or those buckets of it; None if nothing was ever written to it."""
        now = manifest or self.manifest()
        if table not in now.schemas:
            return None
        schema, held = StructType.fromJson(json.loads(now.schemas[table])), now.folders.get(table, {})
        paths = [f"{self.folder}/{held[b]}" for b in (held if buckets is None else buckets) if b in held]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- writing ---------------------------------------------------------------------

    def commit(self, base: Manifest, changes: dict[str, tuple[DataFrame, Column, list[int]]], counters: dict[str, int] | None = None) -> Commit:
        """Put new contents in place of the touched buckets of each table: {table: (rows, bucket column, buckets)}.

        The rows must be all that those buckets hold from now on.  base is the manifest that they were made from.
        """
        schemas, folders, attempt = dict(base.schemas), {t: dict(f) for t, f in base.folders.items()}, uuid4().hex[:12]
        for table, (rows, bucket, touched) in changes.items():
            data = f"data/{table}/{base.version + 1:012d}-{attempt}"
            dealt = rows.withColumn("_bucket", bucket).hint("rebalance", F.col("_bucket"))
            dealt.write.partitionBy("_bucket").option("maxRecordsPerFile", self.rows_a_file).parquet(f"{self.folder}/{data}")
            written = {int(n.partition("=")[2]) for n in self._names(f"{data}/_bucket=*")}
            if written - set(touched):
                raise ValueError(f"{table}: rows of buckets that the commit does not touch: {sorted(written - set(touched))[:5]}")
            own = {b: f for b, f in folders.get(table, {}).items() if b not in set(touched)}
            folders[table] = own | {b: f"{data}/_bucket={b}" for b in written}
            schemas[table] = rows.schema.json()
        new = Manifest(base.version + 1, schemas, folders, base.counters | (counters or {}))
        self._put(f"manifests/{new.version:012d}.json", new.to_json())
        return Commit(new.version, {t: sorted(c[2]) for t, c in changes.items()})

    def merge(self, table: str, batch: DataFrame, site: str, keys: list[str], rule: Rule, counters: dict[str, int] | None = None) -> Commit:
        """Merge a batch into the buckets that its keys fall in; rule gets those buckets' rows and the batch."""
        base, bucket = self.manifest(), self.bucket(F.col(site), F.struct(*keys))
        batch = cut(batch)
        touched = sorted(r.b for r in batch.select(bucket.alias("b")).distinct().collect())
        old = self.read(table, touched, base)
        rows = rule(self.spark.createDataFrame([], batch.schema) if old is None else old, batch)
        return self.commit(base, {table: (rows, bucket, touched)}, counters)

    def lookup(self, table: str, wanted: DataFrame, site: str, keys: list[str]) -> DataFrame | None:
        """The rows of the wanted keys, from their buckets only."""
        bucket = self.bucket(F.col(site), F.struct(*keys))
        found = self.read(table, sorted(r.b for r in wanted.select(bucket.alias("b")).distinct().collect()))
        on = list(dict.fromkeys([site, *keys]))
        return None if found is None else found.join(wanted.select(*on).distinct(), on, "left_semi")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the last manifests names, and the older manifests; readers of those must be done."""
        names = self._names("manifests/*.json")
        live = {f.rpartition("/")[0] for n in names[-keep:] for own in self.manifest(int(n[:-5])).folders.values() for f in own.values()}
        gone = []
        for table in self._names("data/*"):
            for folder in self._names(f"data/{table}/*"):
                if f"data/{table}/{folder}" not in live:
                    self._fs().delete(self._path(f"data/{table}/{folder}"), True)
                    gone.append(f"data/{table}/{folder}")
        for n in names[:-keep]:
            self._fs().delete(self._path(f"manifests/{n}"), False)
        return gone
