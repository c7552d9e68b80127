"""A run that is watched and stopped on its way."""

import time

import pytest
from pyspark.sql import functions as F

from colloquy.functions.progress import Cancelled, Run


def slow(rows, seconds):
    def run(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return rows.mapInArrow(run, rows.schema)


def test_measures_and_result(spark):
    run = Run(spark.range(1000).repartition(4), lambda rows: rows.where("id % 2 = 0").count(), top=F.max("id"))
    assert run.result(60) == 500 and run.done and run.measured() == {"rows": 1000, "top": 999}
    ended, known = run.tasks()
    assert ended == known > 0


def test_cancel_a_running_query(spark):
    """Forty tasks of which four go at once: it is stopped when some have ended, and says how far it came."""
    run = Run(spark.range(40, numPartitions=40), lambda rows: slow(rows, 0.4).count())
    other = Run(spark.range(8, numPartitions=8), lambda rows: slow(rows, 0.1).count())
    until = time.time() + 60
    while run.tasks()[0] < 4 and time.time() < until:
        time.sleep(0.1)
    ended, known = run.tasks()
    assert 4 <= ended < known and not run.done
    with pytest.raises(TimeoutError):
        run.result(0.01)
    run.cancel()
    with pytest.raises(Cancelled):
        run.result(60)
    assert run.done and run.tasks()[0] < 40
    assert other.result(60) == 8  # what another run does goes on


def test_errors_are_told(spark):
    run = Run(spark.range(3), lambda rows: rows.select(F.raise_error("broken row")).collect())
    with pytest.raises(Exception, match="broken row"):
        run.result(60)


def test_nothing_starts_after_a_stop(spark):
    run = Run(spark.range(10, numPartitions=10), lambda rows: [slow(rows, 0.3).count() for _ in range(50)])
    time.sleep(0.5)
    run.cancel()
    with pytest.raises(Cancelled):
        run.result(60)
