"""Stored tables as committed versions.

A table is a folder.  Every write goes to a data folder of its own; it becomes the next version when
a small commit file ``commits/<number>`` is created, which a file system does once and at once.
The commit names the data folder, so nothing is moved or written twice, and whoever dies before
it leaves the table as it was.  A reader is pinned to the version that is current when it asks;
later writes don't touch its files until ``retain`` removes them.

Two writers that start from one version can't both commit: the second finds the number taken and
gets ``VersionConflict``.  A commit file without whole content (its writer died inside) counts as
none; its number is skipped.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

GRACE_SECONDS = 24 * 3600  # how long a folder without commit may belong to a writer at work


class VersionConflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    schema: str
    at: float
    notes: Mapping[str, int | str] = field(default_factory=dict)


class VersionedTable:
    """Versions of one table below ``path``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}".rstrip("/"))

    def _names(self, below: str) -> list[str]:
        place = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _commit(self, name: str) -> Version | None:
        with_stream = self._fs.open(self._at(f"commits/{name}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()
        try:
            return Version(int(name), **json.loads(text))
        except (ValueError, TypeError):
            return None

    def history(self) -> list[Version]:
        """All committed versions, oldest first."""
        found = (self._commit(n) for n in self._names("commits") if n.isdigit())
        return [v for v in found if v is not None]

    def current(self) -> Version | None:
        for name in reversed([n for n in self._names("commits") if n.isdigit()]):
            if (v := self._commit(name)) is not None:
                return v
        return None

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of ``version`` (by default of the one that is current now), whatever is written later."""
        v = version or self.current()
        if v is None:
            raise LookupError(f"no version of {self.path} is committed")
        return self.spark.read.schema(StructType.fromJson(json.loads(v.schema))).parquet(f"{self.path}/{v.folder}")

    def stage(self, df: DataFrame, write: Callable[[DataFrame, str], None] | None = None) -> str:
        """Write the rows of the next version; they belong to no version yet."""
        folder = f"data/{uuid.uuid4().hex}"
        (write or (lambda rows, to: rows.write.parquet(to)))(df, f"{self.path}/{folder}")
        return folder

    def publish(self, folder: str, schema: StructType, base: Version | None, notes: Mapping[str, int | str] | None = None) -> Version:
        """Make a staged folder the version after ``base``, which must still be the current one."""
        now = self.current()
        if (now and now.number) != (base and base.number):
            raise VersionConflict(f"{self.path} is at version {now and now.number}, not {base and base.number}")
        number = max([0, *(int(n) for n in self._names("commits") if n.isdigit())]) + 1
        content = {"folder": folder, "schema": schema.json(), "at": time.time(), "notes": dict(notes or {})}
        place = self._at(f"commits/{number:012d}")
        try:
            out = self._fs.create(place, False)
        except Exception as e:
            if self._fs.exists(place):
                raise VersionConflict(f"version {number} of {self.path} was committed by another writer") from e
            raise
        try:
            out.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            out.close()
        return Version(number, **content)

    def write(self, df: DataFrame, base: Version | None, notes: Mapping[str, int | str] | None = None) -> Version:
        """Stage and publish ``df`` as the version after ``base`` (None: the first)."""
        return self.publish(self.stage(df), df.schema, base, notes)

    def load_or_init(self, build: Callable[[], DataFrame]) -> Version:
        """The current version, or a first one from ``build()``."""
        if (v := self.current()) is not None:
            return v
        try:
            return self.write(build(), None)
        except VersionConflict:
            return self.current()  # another writer made the first version

    def delete_on_exit(self) -> None:
        """Remove the table when the application ends (tables of one run only)."""
        self._fs.deleteOnExit(self._at(""))

    def retain(self, last: int = 2, grace_seconds: float = GRACE_SECONDS) -> list[str]:
        """Delete the data of all but the ``last`` versions, and old folders that were never committed."""
        keep = {v.folder for v in self.history()[-max(1, last):]}
        committed = {v.folder for v in self.history()}
        place, gone = self._at("data"), []
        for status in self._fs.listStatus(place) if self._fs.exists(place) else []:
            folder = f"data/{status.getPath().getName()}"
            idle = time.time() - status.getModificationTime() / 1000
            if folder not in keep and (folder in committed or idle > grace_seconds):
                self._fs.delete(status.getPath(), True)
                gone.append(folder)
        return gone
