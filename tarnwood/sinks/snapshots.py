"""Snapshots of an index: what belongs to a file is replaced in all tables at once, or not at all.

A change is written as a part: the paths it replaces and its rows in each table, by Spark's own writers. It becomes visible when a manifest, the list of parts of a version, is put in
place by one rename that never overwrites. A writer that ends before leaves only files that nobody reads. Readers keep the version they began with.

Rows of a part count while no later part replaces their path in that table (a join on paths), so a change costs what it writes, not what the index holds; `compact` rewrites all into one part.

Two writers that start from one version both succeed if their paths differ or they replace different tables: the later one is put behind the earlier. Else the later one gets `Conflict` and
its part is left to `vacuum`.

The folder must be one that driver and executors share, with a rename that fails where the target exists (HDFS; a POSIX folder, by a link). Null paths are not replaced and their rows are
not kept. Empty changes make a version of their own. Tables that a part doesn't name keep their rows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer replaced some of the same paths first."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for sub in ("manifests", "parts"):
            self._fs.mkdirs(self._path(f"{self.root}/{sub}"))

    # versions

    def version(self) -> int:
        """The newest version; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _put(self, version: int, parts: list[dict]) -> bool:
        """The manifest of a version, unless there is one already."""
        draft = f"{self.root}/manifests/.draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps({"version": version, "parts": parts}).encode()))
        out.close()
        target = self._manifest(version)
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(urlparse(draft).path, urlparse(target).path)
            else:
                sc = self.spark.sparkContext
                fs = sc._jvm.org.apache.hadoop.fs
                fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(self._path(draft), self._path(target), sc._gateway.new_array(fs.Options.Rename, 0))
            return True
        except Exception:
            if self._fs.exists(self._path(target)):
                return False
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    # writing

    def stage(self, paths: DataFrame, tables: dict[str, DataFrame], whole: bool = False) -> dict:
        """A part on disk that no version holds yet. Rows of paths that aren't replaced are left out; with `whole` the tables are replaced altogether."""
        part = {"id": uuid.uuid4().hex, "tables": {}, "whole": whole}
        at = f"{self.root}/parts/{part['id']}"
        paths.select("path").where("path IS NOT NULL").distinct().write.parquet(f"{at}/_paths")
        replaced = self.spark.read.schema("path string").parquet(f"{at}/_paths")
        for name, rows in tables.items():
            (rows if whole else rows.join(replaced, "path", "left_semi")).write.parquet(f"{at}/{name}")
            part["tables"][name] = rows.schema.jsonValue()
        return part

    def commit(self, part: dict, base: int) -> int:
        """The version that holds the part, after `base` and whatever doesn't touch the same paths of the same tables."""
        while True:
            now = self.version()
            known = {p["id"] for p in self.parts(base)}
            for other in self.parts(now) if now != base else []:
                if other["id"] not in known and set(other["tables"]) & set(part["tables"]) and (other["whole"] or part["whole"] or not self._paths(other).join(self._paths(part), "path", "left_semi").isEmpty()):
                    raise Conflict(f"version {now} replaced some of the same paths")
            before = self.parts(now)
            if part["whole"]:
                before = [p | {"tables": left} for p in before if (left := {t: s for t, s in p["tables"].items() if t not in part["tables"]})]
            if self._put(now + 1, [*before, part]):
                return now + 1
            base = now

    def replace(self, paths: DataFrame, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """All rows of the paths in these tables replaced, in one version."""
        base = self.version() if base is None else base
        return self.commit(self.stage(paths, tables), base)

    def replace_whole(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Tables replaced altogether, such as a map of the project; without rows, cleared."""
        base = self.version() if base is None else base
        none = self.spark.createDataFrame([], "path string")
        return self.commit(self.stage(none, tables, whole=True), base)

    def remove(self, paths: DataFrame, base: int | None = None) -> int:
        """The paths and what belongs to them, in every table that isn't a whole."""
        version = self.version() if base is None else base
        kept = {t: StructType.fromJson(s) for p in self.parts(version) for t, s in p["tables"].items() if "path" in {f["name"] for f in s["fields"]}}
        return self.replace(paths, {t: self.spark.createDataFrame([], s) for t, s in kept.items()}, version)

    def clear(self, tables: list[str]) -> int:
        """Caches dropped; other tables, such as the history of scans, stay."""
        version = self.version()
        schemas = {t: StructType.fromJson(s) for p in self.parts(version) for t, s in p["tables"].items() if t in tables}
        return self.replace_whole({t: self.spark.createDataFrame([], s) for t, s in schemas.items()}, version)

    # reading

    def _paths(self, part: dict) -> DataFrame:
        return self.spark.read.schema("path string").parquet(f"{self.root}/parts/{part['id']}/_paths")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table in a version."""
        parts = [p for p in self.parts(version) if table in p["tables"]]
        if not parts:
            raise KeyError(table)
        frames = [self.spark.read.schema(StructType.fromJson(p["tables"][table])).parquet(f"{self.root}/parts/{p['id']}/{table}") for p in parts]
        if len(parts) == 1:
            return frames[0]
        numbered = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("_part", F.lit(i)) for i, f in enumerate(frames)))
        replaced = reduce(DataFrame.unionByName, (self._paths(p).withColumn("_later", F.lit(i)) for i, p in enumerate(parts) if i))
        last = replaced.groupBy("path").agg(F.max("_later").alias("_later"))
        if "path" not in numbered.columns:
            return numbered.where(F.col("_part") == len(parts) - 1).drop("_part")
        return numbered.join(last, "path", "left").where(F.col("_part") >= F.coalesce("_later", F.lit(0))).select(*[c for c in numbered.columns if c != "_part"])

    # upkeep

    def compact(self) -> int:
        """All tables rewritten into one part: later reads join nothing."""
        version = self.version()
        names = sorted({t for p in self.parts(version) for t in p["tables"]})
        return self.replace_whole({t: self.read(t, version) for t in names}, version)

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400) -> list[str]:
        """Drop all but the newest `keep` versions and the parts that none of them holds; parts younger than older_than_s may belong to a running writer and stay."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = {p["id"] for v in kept for p in self.parts(v)}
        for s in self._fs.listStatus(self._path(f"{self.root}/manifests")):
            name = s.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) not in kept:
                self._fs.delete(s.getPath(), False)
        gone = []
        for s in self._fs.listStatus(self._path(f"{self.root}/parts")):
            name = s.getPath().getName()
            if name not in used and s.getModificationTime() <= (time.time() - older_than_s) * 1000:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
