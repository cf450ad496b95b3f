"""The state store: an append-only log of task events in Parquet, folded into records; interned texts; a run clock.

Only the driver writes. A write is a new folder, listed by a versioned manifest, so a reader sees a whole state, a lost
executor is retried by Spark, and nothing that is being read is overwritten. Log and manifest lie in one file system, any
that Spark reaches. ``compact`` folds the log into one event for each task.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import code
from freshet.operators.store import fold
from freshet.sources.remote import Versions

PENDING, SUCCESS, FAILED = 0, 1, 2
#: Names of taken batches that are remembered.
TAKEN = 1000
RESOURCES = ["wall_s", "cpu_s", "max_rss_bytes", "rss_method"]
STATE = ["rule", "status", "ts", "run_code_id", "uses_code_id", "io_code_id", "run_seq", "exception"]
EVENTS = (
    "key string, event_seq long, kind string, rule string, status int, ts string, run_code_id long, uses_code_id long, io_code_id long,"
    " run_seq long, exception string, wall_s double, cpu_s double, max_rss_bytes long, rss_method string"
)


class StateStore(ABC):
    """What a store of task state offers. Stores without code, manifests or a clock may keep the defaults."""

    @abstractmethod
    def records(self, spark: SparkSession, rule: str | None = None) -> DataFrame:
        """The present records, of one rule if it is named."""

    @abstractmethod
    def append(self, events: DataFrame) -> DataFrame:
        """Events as in EVENTS, but for ``event_seq``, which the store gives; the result reads them again."""

    def taken(self, name: str) -> bool:
        """Whether events of this name were appended."""
        return False

    def take(self, name: str, events: DataFrame) -> None:
        """Append events once: with a name that was taken, nothing is done."""
        if not self.taken(name):
            self.append(events)

    def intern(self, texts: list[str]) -> list[int | None]:
        return [None] * len(texts)

    def text(self, ids) -> dict[int, str]:
        return {}

    def put_manifest(self, uses_code_id: int, manifest: Mapping[str, tuple[str, str]]) -> None:
        """Raw texts of declared helpers; written once for each version."""

    def manifest(self, uses_code_id: int) -> dict[str, tuple[str, str]]:
        return {}

    def begin(self) -> int | None:
        return None


class ParquetStore(StateStore):
    """State under a folder that the driver and the executors share."""

    def __init__(self, path: str | Path):
        self.path = str(path).rstrip("/")
        self.manifests = Versions(self.path, "state")

    # --- small tables of the driver ---

    def _read(self) -> dict:
        number, state = self.manifests.read()
        return (state or {"parts": [], "seq": 0, "run_seq": 0, "codes": [], "manifests": {}, "taken": []}) | {"version": number}

    def _write(self, state: dict) -> None:
        self.manifests.write({k: v for k, v in state.items() if k != "version"}, state["version"])

    def intern(self, texts: list[str]) -> list[int]:
        """Ids of texts, the same for the same text."""
        state = self._read()
        known = {t: i for i, t in enumerate(state["codes"])}
        fresh = [t for t in dict.fromkeys(texts) if t not in known]
        if fresh:
            known |= {t: len(state["codes"]) + i for i, t in enumerate(fresh)}
            state["codes"] += fresh
            self._write(state)
        return [known[t] for t in texts]

    def text(self, ids) -> dict[int, str]:
        codes = self._read()["codes"]
        return {i: codes[i] for i in ids if i is not None and i < len(codes)}

    def put_manifest(self, uses_code_id: int, manifest: Mapping[str, tuple[str, str]]) -> None:
        state = self._read()
        if str(uses_code_id) not in state["manifests"]:
            state["manifests"][str(uses_code_id)] = {k: list(v) for k, v in manifest.items()}
            self._write(state)

    def manifest(self, uses_code_id: int) -> dict[str, tuple[str, str]]:
        return {k: tuple(v) for k, v in self._read()["manifests"].get(str(uses_code_id), {}).items()}

    def begin(self) -> int:
        """A new value of the run clock: one for each run or set-state, shared by all its tasks."""
        state = self._read()
        state["run_seq"] += 1
        self._write(state)
        return state["run_seq"]

    # --- events ---

    def events(self, spark: SparkSession) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self._read()["parts"]]
        return spark.read.schema(EVENTS).option("mergeSchema", "true").parquet(*parts) if parts else spark.createDataFrame([], EVENTS)

    def records(self, spark: SparkSession, rule: str | None = None) -> DataFrame:
        events = self.events(spark)
        return fold(events if rule is None else events.where(F.col("rule") == rule), "key", "event_seq", "kind", STATE, RESOURCES)

    def taken(self, name: str) -> bool:
        return name in self._read().get("taken", [])

    def take(self, name: str, events: DataFrame) -> None:
        if not self.taken(name):
            self._append(events, name)

    def append(self, events: DataFrame) -> DataFrame:
        return self._append(events)

    def _append(self, events: DataFrame, name: str | None = None) -> DataFrame:
        """All events of a call get one sequence number: within a call a task has one event. The part and its name are listed
        together."""
        state = self._read()
        state["seq"] += 1
        names = [c.split()[0] for c in EVENTS.split(", ")]
        kinds = {c.split()[0]: c.split()[1] for c in EVENTS.split(", ")}
        have = events.columns
        shaped = events.select(*[F.lit(state["seq"]).cast("long").alias(c) if c == "event_seq" else (F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
        part = f"events-{state['seq']:09d}-{uuid.uuid4().hex[:8]}"
        shaped.write.mode("errorifexists").parquet(f"{self.path}/{part}")
        self._write(state | {"parts": [*state["parts"], part], "taken": [*state.get("taken", []), *([name] if name else [])][-TAKEN:]})
        return events.sparkSession.read.schema(EVENTS).parquet(f"{self.path}/{part}")

    def compact(self, spark: SparkSession) -> None:
        """The folded log as a new part; the old parts are no longer listed. The resources' event goes before the state's."""
        state, now = self._read(), self.records(spark)
        part = f"events-{state['seq']:09d}-{uuid.uuid4().hex[:8]}"
        now.withColumn("kind", F.lit("exec")).select(*[c.split()[0] for c in EVENTS.split(", ")]).write.parquet(f"{self.path}/{part}")
        self._write(state | {"parts": [part]})


def track(store: StateStore, rule) -> tuple[int | None, int | None, int | None]:
    """The ids of a rule's present code, declarations and specs."""
    run, uses, io = store.intern([rule.source, code.uses_text(rule.uses), code.io_text(rule.inputs, rule.outputs)])
    if uses is not None:
        store.put_manifest(uses, code.uses_manifest(rule.uses))
    return run, uses, io
