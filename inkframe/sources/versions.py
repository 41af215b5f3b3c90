"""A current version of a table that is replaced as a whole, by any number of writers.

The data of a version are Parquet files in a folder of their own, written
before anybody knows of them. A version exists from the moment its manifest
does: the writer prepares a folder with ``manifest.json`` under a name of its
own and renames it to the next version number. A rename to a taken number fails
or ends inside the other's folder, so the manifest under the number says who
won; the loser looks at the version that is there now and tries the next
number. Readers take the highest number and see one version, old or new.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class Conflict(RuntimeError):
    """Another writer published first, as often as a writer was willing to try."""


class Versions:
    """Versions of one table under ``folder``, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, version: int) -> dict | None:
        path = self._path(f"{self.folder}/v{version:09d}/{MANIFEST}")
        if not self.files.exists(path):
            return None
        stream = self.files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, ascending."""
        root = self._path(self.folder)
        if not self.files.exists(root):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(root)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{9}", n))

    def current(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def publish_if(self, frame: DataFrame, expected: int, note: str = "") -> bool:
        """Make ``frame`` the version after ``expected``; False, and nothing left, if that number is taken."""
        name = uuid.uuid4().hex
        data, mine = f"{self.folder}/data-{name}", f"{self.folder}/pending-{name}"
        frame.write.parquet(data)
        stream = self.files.create(self._path(f"{mine}/{MANIFEST}"))
        stream.write(json.dumps({"id": name, "data": f"data-{name}", "version": expected + 1, "note": note}).encode())
        stream.close()
        target = self._path(f"{self.folder}/v{expected + 1:09d}")
        if not self.files.exists(target):
            try:
                self.files.rename(self._path(mine), target)
            except Exception as error:  # a taken number is an error on some file systems
                if not self.files.exists(target):
                    raise RuntimeError(f"version {expected + 1} could not be published") from error
        found = self._manifest(expected + 1)
        won = found is not None and found["id"] == name
        for left in (f"{target.toString()}/pending-{name}", mine, *(() if won else (data,))):
            self.files.delete(self._path(left), True)
        return won

    def publish(self, change: Callable[[DataFrame | None], DataFrame], note: str = "", tries: int = 20) -> int:
        """Publish what ``change`` makes of the current version (None before the first); it is made again from the newer one each time another writer was first."""
        for _ in range(tries):
            now = self.current()
            if self.publish_if(change(self.read(now) if now else None), now, note):
                return now + 1
        raise Conflict(f"{tries} tries lost against other writers of {self.folder}")

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or that of a number."""
        number = self.current() if version is None else version
        found = self._manifest(number)
        if found is None:
            raise FileNotFoundError(f"no version {number} in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{found['data']}")

    def history(self) -> DataFrame:
        """version and note of all versions that are kept, and the rows of each."""
        kept = [(v, self._manifest(v)) for v in self.versions()]
        notes = self.spark.createDataFrame([(v, m["note"], m["data"]) for v, m in kept if m], "version long, note string, data string")
        if notes.isEmpty():
            return notes.select("version", "note", F.lit(0).cast("long").alias("rows"))
        counts = self.spark.read.parquet(*(f"{self.folder}/{m['data']}" for _, m in kept if m)).groupBy(F.regexp_extract(F.input_file_name(), "(data-[0-9a-f]+)", 1).alias("data")).agg(F.count(F.lit(1)).alias("rows"))
        return notes.join(counts, "data", "left").select("version", "note", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))

    def expire(self, keep: int) -> None:
        """Delete all but the newest ``keep`` versions; a reader of an older one must be done."""
        for version in self.versions()[: -max(keep, 1)]:
            found = self._manifest(version)
            self.files.delete(self._path(f"{self.folder}/v{version:09d}"), True)
            if found:
                self.files.delete(self._path(f"{self.folder}/{found['data']}"), True)
