"""Progress of the jobs that a piece of code runs, by the tasks that have ended."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ended_tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    """Tasks that have ended and all tasks known so far, of the stages of a group's jobs."""
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
    known = [info for s in stages if (info := tracker.getStageInfo(s))]
    return sum(i.numCompletedTasks for i in known), sum(i.numTasks for i in known)


@contextmanager
def watched(spark: SparkSession, report: Callable[[float, int], None], every: float = 0.2) -> Iterator[None]:
    """Reports, while its body runs jobs, the share of tasks that have ended (rising, below 1) and the milliseconds that the rest will take."""
    context, group, over, began = spark.sparkContext, f"webloom-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

    def watch() -> None:
        most = 0.0
        while not over.wait(every):
            done, total = ended_tasks(spark, group)
            if 0 < done < total and done / total > most:
                most = done / total
                report(most, round((time.monotonic() - began) * 1000 * (total - done) / done))

    thread = threading.Thread(target=watch, daemon=True)
    before = {name: context.getLocalProperty(name) for name in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, "webloom")
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        for name, value in before.items():
            context.setLocalProperty(name, value)
