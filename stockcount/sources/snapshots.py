"""A table as a sequence of whole snapshots.

Data folders are written once and never changed. A snapshot is a small manifest that lists the folders it consists of, each
with a tag (the value of a column, such as the category) or without. A commit writes its new folders first, then the
manifest under the next number: it appears by a rename that fails if another writer has taken the number, who then is
told so. A reader takes the manifest with the highest number, so it sees a whole snapshot, also while another one is
written or after a writer died half-way; folders of such a writer are in no manifest and go with ``vacuum``.

Paths may be of any file system Spark knows; only manifests and names of tags pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values a tag column may have; each has a folder of its own.
MOST_TAGS = 10_000
_NO_TAG = "__null__"


class SnapshotConflict(RuntimeError):
    """Another writer has committed since the snapshot was read."""


@dataclass(frozen=True)
class Part:
    folder: str
    tag: str | None


class SnapshotTable:
    """A table under ``root``; ``tag`` names the column by which parts are kept apart."""

    def __init__(self, spark: SparkSession, root: str, tag: str | None = None):
        self.spark, self.root, self.tag = spark, root.rstrip("/"), tag
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/snapshots")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def version(self) -> int:
        """Number of the newest snapshot; 0 before the first."""
        return max(self._manifests(), default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        lines = self.spark.read.text(f"{self.root}/snapshots/{version:08d}.json", wholetext=True).collect()
        return [Part(p["folder"], p["tag"]) for p in json.loads(lines[0][0])["parts"]]

    def read(self, version: int | None = None, tags: list[str] | None = None) -> DataFrame | None:
        """The rows of a snapshot, the newest if none is named; only the folders of ``tags`` if given. None without any."""
        folders = [p.folder for p in self.parts(version) if tags is None or p.tag in tags]
        return self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders]) if folders else None

    def _written(self, df: DataFrame) -> list[Part]:
        name = uuid.uuid4().hex
        if self.tag is None:
            df.write.parquet(f"{self.root}/data/{name}")
            return [Part(name, None)]
        tagged = df.withColumn("_tag", F.coalesce(F.col(self.tag).cast("string"), F.lit(_NO_TAG)))
        tagged.write.partitionBy("_tag").parquet(f"{self.root}/data/{name}")
        base = self._path(f"{self.root}/data/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(base) if s.isDirectory()]
        if len(found) > MOST_TAGS:
            raise ValueError(f"{len(found)} values of {self.tag}; a tag column has at most {MOST_TAGS}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return [Part(f"{name}/{f}", unescape(f.removeprefix("_tag="))) for f in sorted(found)]

    def _commit(self, seen: int, parts: list[Part]) -> int:
        """Makes ``parts`` the snapshot after ``seen``."""
        folder, number = f"{self.root}/snapshots", seen + 1
        draft = self._path(f"{folder}/_{uuid.uuid4().hex}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"parts": [vars(p) for p in parts]}).encode()))
        out.close()
        final = self._path(f"{folder}/{number:08d}.json")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise SnapshotConflict(f"snapshot {number} of {self.root} was taken by another writer")
        return number

    def append(self, df: DataFrame) -> int:
        """A snapshot with the rows of ``df`` added."""
        seen = self.version()
        return self._commit(seen, self.parts(seen) + self._written(df))

    def overwrite(self, df: DataFrame) -> int:
        seen = self.version()
        return self._commit(seen, self._written(df))

    def replace(self, df: DataFrame, key: str) -> int:
        """A snapshot in which all rows of the keys in ``df`` are those of ``df``; folders without such a row stay as they are."""
        seen = self.version()
        held, old = self.parts(seen), self.read(seen)
        if old is None:
            return self._commit(seen, self._written(df))
        keys = df.select(key).distinct()
        if self.tag is None:
            return self._commit(seen, self._written(old.join(keys, key, "left_anti").select(df.columns).unionByName(df)))
        touched = old.join(keys, key, "left_semi").select(F.coalesce(F.col(self.tag).cast("string"), F.lit(_NO_TAG)).alias("t")).distinct()
        gone = {r["t"] for r in touched.limit(MOST_TAGS + 1).collect()}
        stays = [p for p in held if p.tag not in gone]
        rest = self.read(seen, list(gone))
        fresh = df if rest is None else rest.join(keys, key, "left_anti").select(df.columns).unionByName(df)
        return self._commit(seen, stays + self._written(fresh))

    def compact(self) -> int:
        """A snapshot of the same rows in one folder a tag."""
        seen = self.version()
        rows = self.read(seen)
        return seen if rows is None else self._commit(seen, self._written(rows))

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests before the newest ``keep`` and data folders that no kept one lists; returns how many folders.

        Not while another writer works: its folders are not listed yet.
        """
        versions = self._manifests()
        used = {p.folder.split("/")[0] for v in versions[-keep:] for p in self.parts(v)}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/snapshots/{v:08d}.json"), False)
        data = self._path(f"{self.root}/data")
        unused = [s.getPath() for s in self._fs.listStatus(data) if s.getPath().getName() not in used] if self._fs.exists(data) else []
        for p in unused:
            self._fs.delete(p, True)
        return len(unused)
