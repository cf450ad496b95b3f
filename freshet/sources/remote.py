"""Small versioned documents in any file system that Spark reaches, the driver's and the executors' alike."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Versions:
    """A JSON document under a folder, a new file for each version. A version is created, never overwritten, so two writers
    of one version clash instead of losing a change; a reader takes the last that is whole. No renaming is needed."""

    def __init__(self, folder: str, name: str, kept: int = 3):
        self.folder, self.name, self.kept = folder.rstrip("/"), name, kept

    def _path(self, text: str):
        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, folder = self._path(self.folder)
        if not system.exists(folder):
            return []
        names = [x.getPath().getName() for x in system.listStatus(folder)]
        return sorted(int(n[len(self.name) + 1 : -5]) for n in names if n.startswith(f"{self.name}-") and n.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.folder}/{self.name}-{number:012d}.json"

    def read(self) -> tuple[int, dict | None]:
        """(version, document); (0, None) where there is none."""
        numbers = self._numbers()
        for number in reversed(numbers):
            system, path = self._path(self._file(number))
            stream = system.open(path)
            try:
                text = SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return numbers[-1], json.loads(text)
            except ValueError:  # its writer was lost
                continue
        return (numbers[-1] if numbers else 0), None

    def write(self, document: dict, after: int) -> int:
        """The document as the version after ``after``; an error if that version is there already."""
        system, path = self._path(self._file(after + 1))
        stream = system.create(path, False)
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()
        for number in self._numbers()[: -self.kept]:
            old_system, old = self._path(self._file(number))
            old_system.delete(old, False)
        return after + 1
