"""Checks and other jobs in the background: started, asked for and cancelled by a number."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Optional

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass
class Job:
    """A job's state: running, complete, failed or cancelled."""

    id: str
    status: str = "running"
    result: Any = None
    error: Optional[str] = None
    thread: Optional[threading.Thread] = field(default=None, repr=False)
    stop: Callable[[], None] = field(default=lambda: None, repr=False)


class Background:
    """Runs functions in job groups of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def start(self, work: Callable[[], Any], pool: Optional[str] = None) -> str:
        """Start work and return the job's id at once; pool names a scheduler pool."""
        job = Job(uuid.uuid4().hex)
        self.jobs[job.id] = job
        self._run(job, work, pool)
        return job.id

    def _run(self, job: Job, work: Callable[[], Any], pool: Optional[str]) -> None:
        def run() -> None:
            context = self.spark.sparkContext
            context.setJobGroup(job.id, f"background {job.id}", interruptOnCancel=True)
            if pool:
                context.setLocalProperty("spark.scheduler.pool", pool)
            try:
                result = work()
            except Exception as e:
                if job.status != "cancelled":
                    job.status, job.error = "failed", str(e)
            else:
                if job.status != "cancelled":
                    job.status, job.result = "complete", result

        job.thread = InheritableThread(target=run, daemon=True)
        job.thread.start()

    def every(self, work: Callable[[], Any], seconds: float, pool: Optional[str] = None) -> str:
        """Do work now and again each time so many seconds after it ended, until the job is cancelled; its result is the last one's.

        An error ends the job. For cleaning, checks and comparisons of a whole tree that are to be made regularly.
        """
        ended = threading.Event()

        def repeated() -> Any:
            while True:
                self.jobs[id].result = work()
                if ended.wait(seconds):
                    return self.jobs[id].result

        job = Job(uuid.uuid4().hex)
        id, self.jobs[job.id] = job.id, job
        job.stop = ended.set
        self._run(job, repeated, pool)
        return id

    def get(self, id: str) -> Optional[Job]:
        """The job of that id, or None."""
        return self.jobs.get(id)

    def cancel(self, id: str) -> None:
        """Cancel a job that is still running."""
        job = self.jobs[id]
        if job.status == "running":
            job.status = "cancelled"
            job.stop()
            self.spark.sparkContext.cancelJobGroup(id)

    def wait(self, id: str, seconds: Optional[float] = None) -> Job:
        """The job, once it has ended or the time is over."""
        self.jobs[id].thread.join(seconds)
        return self.jobs[id]
