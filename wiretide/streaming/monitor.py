"""The state of a running monitor: heartbeat, windows, a bounded history, and whether to believe it.

``Monitor`` listens to Spark's streaming queries and keeps one small JSON file for each in a shared folder, so that any
process can ask how a query fares, tell it to stop, or notice that it has gone silent.  Spark itself calls the listener
after every batch; a query that dies without ending leaves ``running`` set, and ``is_stale`` says so after three windows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import storage

# Windows kept, newest findings kept, silent windows after which a state is stale, bounds of a window.
HISTORY, NEWEST, STALE_AFTER = 20, 8, 3
SHORTEST, LONGEST, USUAL = 5, 300, 30


def window_seconds(asked: float | None) -> float:
    return min(LONGEST, max(SHORTEST, USUAL if asked is None else asked))


class Store:
    """A monitor's file and its stop mark."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = storage.store(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.stop_path = f"{base}/{name}.json", f"{base}/{name}.stop"

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def load(self) -> dict:
        if not self.exists(self.path):
            return {"running": False, "windows": 0, "rows": 0, "findings": 0, "heartbeat": None, "started": None, "ended": None, "error": "", "every": USUAL, "recent": [], "newest": []}
        with self.fs.open_input_file(self.path) as f:
            return json.loads(f.read())

    def save(self, state: dict) -> None:
        """The whole state or the one before it, never a part."""
        temporary = f"{self.path}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(json.dumps(state).encode())
        self.fs.move(temporary, self.path)

    def ask_to_stop(self) -> None:
        self.fs.open_output_stream(self.stop_path).close()

    def stop_asked(self) -> bool:
        return self.exists(self.stop_path)

    def clear_stop(self) -> None:
        if self.exists(self.stop_path):
            self.fs.delete_file(self.stop_path)


def is_stale(state: dict, now: float | None = None) -> bool:
    """Whether a state claims to run although nothing has reported for three windows."""
    if not state["running"] or state["heartbeat"] is None:
        return False
    return (time.time() if now is None else now) - state["heartbeat"] > STALE_AFTER * state["every"]


class Monitor(StreamingQueryListener):
    """Keeps the state of every named streaming query of a session; register it with ``spark.streams.addListener``.

    ``findings`` may tell the titles of new findings of a batch (by query name and batch number)."""

    def __init__(self, spark: SparkSession, folder: str, every: float | None = None, findings: Callable[[str, int], list[str]] | None = None, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.every, self.findings, self.clock = spark, folder, window_seconds(every), findings, clock
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = name = event.name or str(event.id)
        store = Store(self.folder, name)
        store.clear_stop()
        store.save(store.load() | {"running": True, "started": self.clock(), "heartbeat": self.clock(), "ended": None, "error": "", "every": self.every})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.record(p.name or str(p.id), p.batchId, p.numInputRows)
        self.obey(p.name or str(p.id), str(p.id))

    def onQueryIdle(self, event) -> None:
        name = self.names.get(str(event.runId), str(event.id))
        store = Store(self.folder, name)
        store.save(store.load() | {"heartbeat": self.clock()})
        self.obey(name, str(event.id))

    def onQueryTerminated(self, event) -> None:
        store = Store(self.folder, self.names.pop(str(event.runId), str(event.id)))
        store.save(store.load() | {"running": False, "ended": self.clock(), "error": (event.exception or "")[:2000]})

    def record(self, name: str, batch: int, rows: int) -> None:
        """Fold a window into the state: a batch that reports again replaces its own entry."""
        store = Store(self.folder, name)
        state, now = store.load(), self.clock()
        titles = self.findings(name, batch) if self.findings else []
        again = any(r["batch"] == batch for r in state["recent"])
        recent = [r for r in state["recent"] if r["batch"] != batch] + [{"batch": batch, "at": now, "rows": rows, "findings": len(titles)}]
        if not again:
            state |= {"windows": state["windows"] + 1, "rows": state["rows"] + rows, "findings": state["findings"] + len(titles)}
            state["newest"] = ([{"title": t, "at": now} for t in titles[:NEWEST]] + state["newest"])[:NEWEST]
        store.save(state | {"heartbeat": now, "recent": recent[-HISTORY:]})

    def obey(self, name: str, query: str) -> None:
        """Stop a query that was asked to, from another thread: a listener must not wait for its own query."""
        if Store(self.folder, name).stop_asked():
            import threading

            running = [q for q in self.spark.streams.active if q.id == query]
            for q in running:
                threading.Thread(target=q.stop, daemon=True).start()


def activity(packets: DataFrame, seconds: float = USUAL, keep: int = HISTORY) -> DataFrame:
    """session_id, window (its start), packets, bytes, silent (windows without a packet before it): the newest windows of
    each session that have packets, for stored packets.  Packets without a time are left out."""
    at = (F.floor(F.col("ts") / seconds) * seconds).cast("double")
    w = packets.where("ts IS NOT NULL").groupBy("session_id", at.alias("window")).agg(F.count("*").alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))
    order = Window.partitionBy("session_id").orderBy("window")
    gap = (F.col("window") - F.lag("window").over(order)) / seconds - 1
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("window")))
    return w.withColumns({"silent": F.coalesce(F.round(gap), F.lit(0)).cast("long"), "nth": newest}).where(F.col("nth") <= keep).drop("nth")
