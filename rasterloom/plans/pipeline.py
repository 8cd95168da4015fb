"""Exports in chunks: while one chunk is embedded and stored, the input of the next is fetched. And progress."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.common import materialize


def in_chunks(requests: DataFrame, size: int, fetch: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], go_on: bool = False) -> list[tuple[int, str | None]]:
    """``fetch`` and ``store`` for each ``size`` points (``point_index`` is dense from 0): one chunk's input is stored in the
    shared folder by a second thread while the chunk before it is worked on. Returns each chunk with its error; without
    ``go_on`` the first error stops the run."""
    last = requests.agg(F.max("point_index")).first()[0]
    if last is None:
        return []
    chunks = range(-(-(last + 1) // size))
    part = lambda k: requests.filter((F.col("point_index") >= k * size) & (F.col("point_index") < (k + 1) * size))
    out: list[tuple[int, str | None]] = []
    with ThreadPoolExecutor(1) as ahead:
        ready = lambda k: ahead.submit(lambda: materialize(fetch(part(k)), "chunk"))
        coming = ready(0)
        for k in chunks:
            now, coming = coming, ready(k + 1) if k + 1 < len(chunks) else None
            try:
                store(now.result())
                out.append((k, None))
            except Exception as e:
                out.append((k, f"{type(e).__name__}: {e}"[:500]))
                if not go_on:
                    if coming is not None:
                        coming.cancel()
                    raise
    return out


class Progress:
    """A line on stderr about the jobs that run inside a ``with``: tasks done of those known, every ``seconds``."""

    def __init__(self, spark: SparkSession, what: str = "export", seconds: float = 2.0, enabled: bool = True) -> None:
        self.tracker, self.what, self.seconds, self.enabled = spark.sparkContext.statusTracker(), what, seconds, enabled
        self.stop = threading.Event()

    def line(self) -> str:
        stages = [s for i in self.tracker.getActiveStageIds() if (s := self.tracker.getStageInfo(i))]
        done, total = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
        return f"{self.what}: {done} of {total} tasks in {len(stages)} stages, {time.monotonic() - self.began:.0f} s"

    def _run(self) -> None:
        while not self.stop.wait(self.seconds):
            print(self.line(), file=sys.stderr)

    def __enter__(self) -> Progress:
        self.began = time.monotonic()
        if self.enabled:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop.set()
        if self.enabled:
            self.thread.join()
