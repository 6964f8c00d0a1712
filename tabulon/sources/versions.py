"""Tables in versions: files first, then a marker; readers see marked versions only, and half-built ones are found and redone."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARKER = "_COMMITTED"


class Versions:
    """A folder with one folder a version, `v-<number>-<writer>`, in any store that Spark reads.

    A version holds tables as Parquet folders and, once all of them are written, a marker with their names and the writer's notes. The
    marker is created whole under another name and renamed, and a rename never replaces one that is there. The current version is the marked one of the
    highest number; of two writers of one number the first to be marked is current and the other is told so. What has no
    marker doesn't exist for readers, whoever wrote how much of it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[tuple[int, str]]:
        """(number, name) of every version's folder, marked or not."""
        if not self._fs.exists(self._path()):
            return []
        found = (re.fullmatch(r"v-(\d+)-\w+", s.getPath().getName()) for s in self._fs.listStatus(self._path()))
        return sorted((int(m[1]), m[0]) for m in found if m)

    def _marked(self, name: str) -> bool:
        return self._fs.exists(self._path(name, MARKER))

    def current(self) -> str | None:
        """Name of the version that readers see."""
        return next((name for _, name in reversed(self._names()) if self._marked(name)), None)

    def notes(self, version: str | None = None) -> dict:
        """What the writer of a version left in its marker."""
        stream = self._fs.open(self._path(version or self.current(), MARKER))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str, version: str | None = None, schema: str | StructType | None = None) -> DataFrame:
        """A table of a version, the current one by default; a schema is needed where the table may have no rows."""
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no committed version")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{version}/{name}")

    def begin(self) -> str:
        """A new version's name; its number is above all others, half-built ones included."""
        numbers = [n for n, _ in self._names()]
        return f"v-{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"

    def commit(self, version: str, notes: dict | None = None) -> str:
        """Marks a version whose tables are written. Raises if another one of its number is marked."""
        number = int(version.split("-")[1])
        rival = next((name for n, name in self._names() if n == number and name != version and self._marked(name)), None)
        if rival:
            raise RuntimeError(f"{rival} was committed before {version}")
        draft, end = self._path(version, f".{MARKER}-{uuid.uuid4().hex}"), self._path(version, MARKER)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(notes or {}, sort_keys=True).encode()))
        out.close()
        if self._marked(version) or not self._fs.rename(draft, end):
            raise RuntimeError(f"{version} is committed already")
        return version

    def write(self, tables: dict[str, DataFrame | Callable[[str], None]], notes: dict | None = None) -> str:
        """A version of whole tables, each a DataFrame or a function that writes to the path it is given."""
        version = self.begin()
        for name, table in tables.items():
            path = f"{self.path}/{version}/{name}"
            table(path) if callable(table) else table.write.parquet(path)
        return self.commit(version, {"tables": sorted(tables)} | (notes or {}))

    def half_built(self) -> list[str]:
        return [name for _, name in self._names() if not self._marked(name)]

    def recover(self, redo: Callable[[], dict[str, DataFrame]] | None = None) -> list[str]:
        """Deletes what half-built versions left, keeps every marked one, and writes a version by `redo` if there was any.

        To be called when no writer is at work, as at a start. Returns the names of the versions that were half-built.
        """
        lost = self.half_built()
        for name in lost:
            self._fs.delete(self._path(name), True)
        if lost and redo:
            self.write(redo(), {"redone": lost})
        return lost

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest `keep` marked versions; the current one always stays."""
        marked = [name for _, name in self._names() if self._marked(name)]
        old = marked[:-max(1, keep)]
        for name in old:
            # the marker goes first, so that a version that is half deleted is no version
            self._fs.delete(self._path(name, MARKER), False)
            self._fs.delete(self._path(name), True)
        return old
