"""Change events to batches, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, changes, first_us, last_us): bursts with no quiet time of more than ``gap``."""
    s = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("changes"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return s.select(key, "changes", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


def coalesce(events: DataFrame, outside, indexable) -> DataFrame:
    """Distinct paths of a batch with what to do: outside the root, ignored, or reindex."""
    return events.distinct().withColumn("plan", F.when(outside, "outside").when(indexable, "reindex").otherwise("ignored"))


BATCH = "root string, paths array<string>, events long, first timestamp, last timestamp"
_STATE = "paths array<string>, events long, first timestamp, last timestamp"


def _close(key, state):
    import pandas as pd

    paths, n, first, last = state
    return pd.DataFrame({"root": [key[0]], "paths": [sorted(paths)], "events": [n], "first": [first], "last": [last]})


def debounce_stream(changes: DataFrame, quiet_ms: int = 200, max_ms: int | None = None) -> DataFrame:
    """Streaming (root, path, ts) -> one row per closed batch. A batch stays open until no event
    has come for ``quiet_ms``, and at most ``max_ms`` (20 quiet times unless given) after its
    first; a gap of exactly the quiet time closes it. State is the set of paths of an open
    batch; a processing-time timer closes it when nothing more comes."""
    limit = 20 * quiet_ms if max_ms is None else max_ms

    def step(key, frames, state):
        import pandas as pd

        quiet, most = pd.Timedelta(milliseconds=quiet_ms), pd.Timedelta(milliseconds=limit)
        held = None
        if state.exists:
            paths, n, first, last = state.get
            held = (set(paths), n, pd.Timestamp(first), pd.Timestamp(last))
        if state.hasTimedOut:
            if held:
                yield _close(key, held)
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        for path, ts in zip(rows["path"], rows["ts"]):
            if held and (ts - held[3] >= quiet or ts - held[2] >= most):
                yield _close(key, held)
                held = None
            held = (held[0] | {path}, held[1] + 1, held[2], max(held[3], ts)) if held else ({path}, 1, ts, ts)
        if held:
            state.update((sorted(held[0]), held[1], held[2].to_pydatetime(), held[3].to_pydatetime()))
            state.setTimeoutDuration(max(1, min(quiet_ms, limit)))

    return changes.groupBy("root").applyInPandasWithState(step, BATCH, _STATE, "append", "ProcessingTimeTimeout")


class Watch:
    """Applies each micro-batch of changed paths by ``refresh(batch_df, paths)``; an empty plan
    applies nothing, a failure is kept (the last 32) and the stream goes on."""

    KEPT = 32

    def __init__(self, refresh: Callable[[list[str]], None], root_filter: Callable[[str], str] = lambda p: "reindex"):
        self.refresh, self.plan = refresh, root_filter
        self.applied = self.failed = self.superseded = self.events = 0
        self.failures: list[str] = []
        self.skipped: dict[str, int] = {}
        self.samples: dict[str, list[str]] = {}

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        rows = batch.groupBy("path").agg(F.count("*").alias("n")).orderBy("path").collect()
        self.events += sum(r["n"] for r in rows)
        self.superseded += sum(r["n"] - 1 for r in rows)
        todo = []
        for r in rows:
            what = self.plan(r["path"])
            if what == "reindex":
                todo.append(r["path"])
            else:
                self.skipped[what] = self.skipped.get(what, 0) + 1
                kept = self.samples.setdefault(what, [])
                if len(kept) < 5:
                    kept.append(r["path"])
        if not todo:
            return
        try:
            self.refresh(todo)
            self.applied += 1
        except Exception as e:  # noqa: BLE001  a failed refresh must not end the stream
            self.failed += 1
            self.failures = (self.failures + [f"{batch_id}: {e}"])[-self.KEPT :]

    def start(self, changes: DataFrame, checkpoint: str, once: bool = False):
        w = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()
