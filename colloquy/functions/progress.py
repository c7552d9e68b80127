"""Long queries that tell how far they are and can be stopped.

A ``Run`` does an action in a thread of its own, under a job tag. Rows that pass an observed place are counted where they
pass, in the executors; how far a run is follows from its jobs' tasks. Stopping it cancels the jobs with its tag alone.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Cancelled(RuntimeError):
    """The run was stopped before its end."""


class Run:
    """``action(rows)`` over ``rows``, begun at once. ``measures`` are aggregates over the rows that the action reads."""

    def __init__(self, rows: DataFrame, action: Callable[[DataFrame], Any], **measures: Column):
        self._spark: SparkSession = rows.sparkSession
        self._context = self._spark.sparkContext
        self.tag = f"colloquy-{uuid.uuid4().hex}"
        self._observed = Observation(self.tag)
        self._stop, self._result, self._error = threading.Event(), None, None
        wanted = [c.alias(name) for name, c in {"rows": F.count(F.lit(1)), **measures}.items()]
        seen = rows.observe(self._observed, *wanted)

        def work():
            self._context.addJobTag(self.tag)
            try:
                if not self._stop.is_set():
                    self._result = action(seen)
            except Exception as e:  # told by result()
                self._error = e
            finally:
                self._context.removeJobTag(self.tag)

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()

    @property
    def done(self) -> bool:
        return not self._thread.is_alive()

    def tasks(self) -> tuple[int, int]:
        """(ended, known) tasks of the run's stages so far. Stages that have not begun are not known yet; of a job that has
        ended, those that it skipped have no tasks."""
        tracker = self._context.statusTracker()
        stages: dict[int, tuple[int, int]] = {}
        for job in self._context._jsc.sc().statusTracker().getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(int(job))
            for stage in info.stageIds if info else ():
                if (s := tracker.getStageInfo(int(stage))) is not None:
                    stages[int(stage)] = (s.numCompletedTasks, s.numCompletedTasks if info.status == "SUCCEEDED" else s.numTasks)
        return sum(e for e, _ in stages.values()), sum(k for _, k in stages.values())

    def cancel(self) -> None:
        """Stops the run's jobs, and those that it has not begun. Returns at once; other runs go on."""
        self._stop.set()
        self._context.cancelJobsWithTag(self.tag)

    def result(self, timeout: float | None = None) -> Any:
        """What the action gave, after its end. ``Cancelled`` if it was stopped; its own error if it failed."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(f"still running after {timeout} s")
        if self._stop.is_set() and (self._error is not None or self._result is None):
            raise Cancelled(self.tag) from self._error
        if self._error is not None:
            raise self._error
        return self._result

    def measured(self) -> dict[str, Any]:
        """The measures of a run that has come to its end."""
        self.result()
        return self._observed.get
