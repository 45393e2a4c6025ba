"""Named, persistent datasets under one folder. A change is a new version beside the old one, and takes
effect when the pointer file is replaced, so readers never see half of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .dataset import QUADS, Dataset, QuadTable
from .load import namespaces, write


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self._conf), path

    def _read(self, *parts: str) -> str:
        fs, path = self._at(*parts)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, text: str, *parts: str) -> None:
        fs, path = self._at(*parts[:-1], "." + parts[-1])
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._at(*parts)
        fs.delete(final, False)
        if not fs.rename(path, final):
            raise OSError(f"cannot replace {final}")

    def names(self) -> list[str]:
        fs, path = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def exists(self, name: str) -> bool:
        fs, path = self._at(name, "CURRENT")
        return fs.exists(path)

    def create(self, name: str, quads: DataFrame | None = None) -> Dataset:
        if self.exists(name):
            raise ValueError(f"there is a dataset {name} already")
        return self.save(name, quads if quads is not None else self.spark.createDataFrame([], QUADS))

    def save(self, name: str, quads: DataFrame) -> Dataset:
        """Make quads the dataset's new version."""
        if self.exists(name) and not self.is_writable(name):
            raise PermissionError(f"dataset {name} is read-only")
        version = int(self._read(name, "CURRENT")[1:]) + 1 if self.exists(name) else 0
        write(quads, f"{self.root}/{name}/v{version}", "overwrite")
        self._put(f"v{version}", name, "CURRENT")
        return self.open(name)

    def open(self, name: str) -> Dataset:
        if not self.exists(name):
            raise KeyError(name)
        df = self.spark.read.schema(QUADS).parquet(f"{self.root}/{name}/{self._read(name, 'CURRENT')}")
        return Dataset(self.spark, quads=QuadTable(df, not df.filter("g IS NOT NULL").isEmpty()), namespaces=namespaces(df), writable=self.is_writable(name))

    def change(self, name: str, step: Callable[[Dataset], Dataset]) -> Dataset:
        """Apply step, an update for example, and keep its result."""
        return self.save(name, step(self.open(name)).quads.df)

    def is_writable(self, name: str) -> bool:
        fs, path = self._at(name, "READONLY")
        return not fs.exists(path)

    def set_writable(self, name: str, writable: bool) -> None:
        fs, path = self._at(name, "READONLY")
        if writable:
            fs.delete(path, False)
        else:
            self._put("", name, "READONLY")

    def prune(self, name: str) -> None:
        """Delete versions before the current one."""
        current = self._read(name, "CURRENT")
        fs, path = self._at(name)
        for s in fs.listStatus(path):
            if s.isDirectory() and s.getPath().getName() != current:
                fs.delete(s.getPath(), True)

    def drop(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def all(self) -> dict[str, Dataset]:
        """Every dataset by name, for federated queries."""
        return {n: self.open(n) for n in self.names() if self.exists(n)}
