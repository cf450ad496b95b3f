"""What tasks read and write, as relations: declared paths, and a listing of their folders that is joined to them.

An output is a row (path, marker): it is complete if the path, or the marker inside it, is listed in its folder. Folders
are listed once each, on the executors, whatever the number of outputs; a store that cannot be listed has nothing.
An output with a check of its own is asked, on the executors too.
"""

from __future__ import annotations

import inspect
import json
import os
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Output:
    """A path or another name, what inside it tells that it is whole (nothing: its being there), or a check of one's own."""

    path: str
    marker: str = ""
    check: Callable[[str], bool] | None = None

    def __str__(self) -> str:
        return self.path

    def place(self) -> tuple[str, str]:
        """The folder and the name to look for in it."""
        path = self.path if "://" in self.path else os.path.abspath(self.path)
        return (path.rstrip("/"), self.marker) if self.marker else posixpath.split(path.rstrip("/"))


def array_store(path: str) -> Output:
    """A chunked array store, whole when its consolidated metadata are there."""
    return Output(path, ".zmetadata")


def spark_table(path: str) -> Output:
    """A table written by Spark, whole when its writer left the mark of success."""
    return Output(path, "_SUCCESS")


def resolve(spec, kwargs: dict) -> dict[str, object]:
    """A spec for a task's kwargs: a function gets the kwargs that it names, templates are rendered."""
    if callable(spec):
        named = inspect.signature(spec).parameters
        return dict(spec(**{n: kwargs[n] for n in named.keys() & kwargs.keys()}))
    return {name: replace(v, path=v.path.format_map(kwargs)) if isinstance(v, Output) else str(v).format_map(kwargs) for name, v in (spec or {}).items()}


def outputs_for(spec, kwargs: dict) -> dict[str, Output]:
    found = resolve(spec, kwargs)
    if odd := [v for v in found.values() if not isinstance(v, (Output, str, PurePath))]:
        raise TypeError(f"an output is a path or an Output, not {type(odd[0]).__name__}")
    return {name: v if isinstance(v, Output) else Output(str(v)) for name, v in found.items()}


def listing(folder: str) -> list[str]:
    """The names in a folder of any store that Arrow reaches; none if it is not there or cannot be listed."""
    from pyarrow import fs

    try:
        system, path = fs.FileSystem.from_uri(folder)
        return [x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    except Exception:  # noqa: BLE001  whatever the store says
        return []


def holds(output: Output) -> bool:
    """Whether one output is complete."""
    if output.check is not None:
        return bool(output.check(output.path))
    folder, name = output.place()
    return name in listing(folder)


def declared(tasks: DataFrame, spec) -> DataFrame:
    """The outputs of ``tasks`` (``key``, ``kw``): ``key``, ``path``, ``folder``, ``name``, ``checked`` (what its own check says)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in outputs_for(spec, json.loads(kw)).values():
                    rows.append((key, x.path, *x.place(), None if x.check is None else holds(x)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.bool_()])], ["key", "path", "folder", "name", "checked"])

    return tasks.select("key", "kw").mapInArrow(emit, "key string, path string, folder string, name string, checked boolean")


def listed(folders: DataFrame) -> DataFrame:
    """``folder``, ``name`` of all that is in the folders."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = listing(folder)
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string())], ["folder", "name"])

    return folders.select("folder").mapInArrow(emit, "folder string, name string")


def completeness(found: DataFrame, there: DataFrame) -> DataFrame:
    """``found`` (``key``, ``folder``, ``name``, ``checked``) against a listing (``folder``, ``name``, each once), by task: ``key``, ``outputs``
    (their number), ``complete`` (all are there)."""
    seen = found.join(there.withColumn("here", F.lit(True)), ["folder", "name"], "left")
    return seen.groupBy("key").agg(F.count("*").alias("outputs"), F.bool_and(F.coalesce("checked", "here", F.lit(False))).alias("complete"))


def with_completeness(tasks: DataFrame, spec) -> DataFrame:
    """``tasks`` with ``complete`` (some outputs, and all of them complete) and ``outputs``."""
    if spec is None:
        return tasks.withColumns({"complete": F.lit(False), "outputs": F.lit(0).cast("long")})
    paths = declared(tasks, spec)
    found = completeness(paths, listed(paths.where("checked is null").select("folder").distinct()))
    return tasks.drop("complete", "outputs").join(found, "key", "left").withColumns({"complete": F.coalesce("complete", F.lit(False)), "outputs": F.coalesce("outputs", F.lit(0).cast("long"))})
