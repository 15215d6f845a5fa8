"""Watching running streams: alerts where a query makes no progress, heartbeats of keys that fall silent."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class StallWatch(StreamingQueryListener):
    """Calls ``alert(query id, name, seconds)`` when a running query has completed no batch for ``seconds``, once for each stall.

    A batch that ends, also one without rows, is progress, and so is Spark's word that a query idles (it triggers, but has nothing to do)
    unless ``idle_counts`` is false.  Progress after an alert calls ``recovered`` (same arguments).  Register with ``spark.streams.addListener``; the check runs in a thread of the driver every ``every`` seconds until ``stop``.
    """

    def __init__(self, seconds: float, alert: Callable[[str, str | None, float], None], recovered: Callable[[str, str | None, float], None] | None = None, every: float = 1.0, idle_counts: bool = True, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.alert, self.recovered, self.idle_counts, self.clock = seconds, alert, recovered, idle_counts, clock
        self._last: dict[str, tuple[float, str | None]] = {}
        self._stalled: set[str] = set()
        self._lock, self._end = threading.Lock(), threading.Event()
        self._thread = threading.Thread(target=self._run, args=(every,), daemon=True)
        self._thread.start()

    def _run(self, every: float) -> None:
        while not self._end.wait(every):
            self.check()

    def check(self) -> None:
        """Alert of every query that has just become late."""
        with self._lock:
            now = self.clock()
            late = [(q, name, now - at) for q, (at, name) in self._last.items() if now - at > self.seconds and q not in self._stalled]
            self._stalled |= {q for q, _, _ in late}
        for one in late:
            self.alert(*one)

    def _moved(self, query: str, name: str | None = None) -> None:
        with self._lock:
            at, known = self._last.get(query, (self.clock(), name))
            now = self.clock()
            self._last[query] = now, name or known
            back = query in self._stalled
            self._stalled.discard(query)
        if back and self.recovered:
            self.recovered(query, name or known, now - at)

    def onQueryStarted(self, event) -> None:
        self._moved(str(event.id), event.name)

    def onQueryProgress(self, event) -> None:
        self._moved(str(event.progress.id), event.progress.name)

    def onQueryIdle(self, event) -> None:
        if self.idle_counts:
            self._moved(str(event.id))

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._last.pop(str(event.id), None)
            self._stalled.discard(str(event.id))

    def stop(self) -> None:
        self._end.set()
        self._thread.join()


def heartbeats(stream: DataFrame, key: str, minutes: float) -> DataFrame:
    """(key, kind, reports): ``alive`` when a key reports first or again after silence, ``beat`` when it reports and its last heartbeat is
    ``minutes`` old or more, and ``silent`` when it hasn't reported for so long.

    A timer of processing time in the key's state fires with the first batch after it is due; Spark keeps running batches, also without
    rows, as long as there are timers, so silence is told though nothing arrives (and such a query never has all done).  ``reports`` counts the rows of the key so far.  State is one short row a key; a
    silent key's row stays until it reports again, for it to be told once.
    """
    wait = int(minutes * 60_000)
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reports, told, silent = state.get if state.exists else (0, 0, True)
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            state.update((reports, now, True))
            yield pd.DataFrame({key: [k[0]], "kind": ["silent"], "reports": [reports]})
            return
        reports += sum(len(b) for b in batches)
        word = "alive" if silent else "beat" if now - told >= wait else None
        state.update((reports, now if word else told, False))
        state.setTimeoutDuration(wait)
        if word:
            yield pd.DataFrame({key: [k[0]], "kind": [word], "reports": [reports]})

    return stream.select(F.col(key)).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, kind string, reports long", "reports long, told long, silent boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
