"""Running jobs: progress of streams, and admission of a bounded number of jobs at a time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import InheritableThread
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` progress reports of each query by name: batch, input rows, and rows so far; and how queries ended."""

    def __init__(self, most: int = 100):
        self.most = most
        self.reports: dict[str, deque] = {}
        self.ended: dict[str, str | None] = {}
        self._total: dict[str, int] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self._total[name] = self._total.get(name, 0) + p.numInputRows
        self.reports.setdefault(name, deque(maxlen=self.most)).append((p.batchId, p.numInputRows, self._total[name]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[self._names.get(str(event.id), str(event.id))] = event.exception


class Admission:
    """At most ``most`` jobs at a time, each in a scheduler pool of its own name; others wait in the order in which they came.

    With ``spark.scheduler.mode`` FAIR the pools share the executors evenly, so a large job doesn't hold up a small one.
    """

    def __init__(self, spark: SparkSession, most: int = 2):
        if most < 1:
            raise ValueError("at least one job must be admitted")
        self.spark, self.most = spark, most
        self._lock = threading.Lock()
        self._waiting: deque = deque()
        self._running: set[str] = set()

    def can_start(self) -> bool:
        with self._lock:
            return len(self._running) < self.most

    def running(self) -> set[str]:
        with self._lock:
            return set(self._running)

    def waiting(self) -> list[str]:
        with self._lock:
            return [name for name, *_ in self._waiting]

    def submit(self, name: str, job: Callable[[SparkSession], object]) -> Future:
        """``job(spark)`` in its own thread and pool, now or when its turn comes. Names of jobs under way must differ."""
        done: Future = Future()
        with self._lock:
            if name in self._running or any(name == n for n, *_ in self._waiting):
                raise ValueError(f"{name} is under way")
            self._waiting.append((name, job, done))
        self._admit()
        return done

    def _admit(self) -> None:
        while True:
            with self._lock:
                if not self._waiting or len(self._running) >= self.most:
                    return
                name, job, done = self._waiting.popleft()
                self._running.add(name)
            InheritableThread(target=self._run, args=(name, job, done), daemon=True).start()

    def _run(self, name: str, job: Callable, done: Future) -> None:
        result, error = None, None
        try:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            result = job(self.spark)
        except BaseException as e:  # noqa: BLE001 (handed to whoever waits)
            error = e
        with self._lock:
            self._running.discard(name)
        self._admit()
        if error is None:
            done.set_result(result)
        else:
            done.set_exception(error)
