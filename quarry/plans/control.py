"""Cancelling and following a running export: its Spark jobs carry a tag, cancelling the tag stops them on every executor, and what the
scheduler says of running stages is told as progress."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quarry.operators import engine, report
from quarry.plans.resources import PROGRESS_SECONDS, Progress


class Cancellation:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag, self.cancelled = spark, f"quarry-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        """From any thread. Writers abort, so a folder or archive that is not complete is removed."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def running(self) -> Iterator[None]:
        """The jobs started within by this thread carry the tag."""
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
            self.check()
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise InterruptedError("the export was cancelled")


class Flow:
    """A flow with phases. tell: gets a message for each phase, and at most one in PROGRESS_SECONDS on how far its stages are."""

    def __init__(self, spark: SparkSession, cancel: Cancellation | None = None, tell: Callable[[str], None] | None = None) -> None:
        self.spark, self.cancel, self.tell, self.text = spark, cancel or Cancellation(spark), tell, ""
        self.ended = threading.Event()

    def phase(self, text: str) -> None:
        self.cancel.check()
        self.text = text
        if self.tell:
            self.tell(text)

    def _follow(self) -> None:
        tracker, progress = self.spark.sparkContext.statusTracker(), Progress(self.tell)
        while not self.ended.wait(PROGRESS_SECONDS):
            known = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            if known:
                progress.update(lambda: f"{self.text}: {sum(x.numCompletedTasks for x in known)} of {sum(x.numTasks for x in known)} tasks")  # noqa: B023

    @contextmanager
    def running(self, target: str, kept: bool) -> Iterator[Flow]:
        """kept: what is written stays if the flow fails or is cancelled; then its report says that it is incomplete, and why."""
        follower = threading.Thread(target=self._follow, daemon=True) if self.tell else None
        try:
            with self.cancel.running():
                if follower:
                    follower.start()
                yield self
        except BaseException as e:
            if kept and os.path.isdir(target):
                path = os.path.join(target, report.REPORT)
                if not os.path.lexists(path):
                    n = sum(len(files) for _, _, files in os.walk(target))
                    with open(path, "x", encoding="utf-8") as f:
                        f.write(report.summary({"written_files": n}, False, engine.describe(e)))
            raise
        finally:
            self.ended.set()
            if follower and follower.is_alive():
                follower.join()
