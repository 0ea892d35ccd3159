"""Around a run: versions of edited fields, cancelling, progress."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class History:
    """Undo and redo over versions. DataFrames don't change, so a version is one; nothing is copied."""

    current: DataFrame
    depth: int = 50
    undone: list[DataFrame] = field(default_factory=list)
    done: deque[DataFrame] = field(init=False)

    def __post_init__(self) -> None:
        self.done = deque(maxlen=self.depth)

    def edit(self, new: DataFrame) -> DataFrame:
        """What was undone can't be redone after this."""
        self.done.append(self.current)
        self.undone.clear()
        self.current = new
        return new

    def undo(self) -> DataFrame:
        if self.done:
            self.undone.append(self.current)
            self.current = self.done.pop()
        return self.current

    def redo(self) -> DataFrame:
        if self.undone:
            self.done.append(self.current)
            self.current = self.undone.pop()
        return self.current


@contextmanager
def cancellable(spark: SparkSession, group: str, description: str = "") -> Iterator[None]:
    """Jobs started inside can be ended by cancel(spark, group) from another thread."""
    sc = spark.sparkContext
    sc.setJobGroup(group, description or group, interruptOnCancel=True)
    try:
        yield
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def progress(spark: SparkSession, group: str) -> tuple[int, int]:
    """Tasks that have ended, and all tasks, of a group's stages that have begun and that Spark still knows."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [j for i in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(i))]
    stages = [s for j in jobs for k in j.stageIds if (s := tracker.getStageInfo(k)) and s.numCompletedTasks + s.numActiveTasks + s.numFailedTasks]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
