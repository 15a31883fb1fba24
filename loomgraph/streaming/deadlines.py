"""Work under deadlines: Spark jobs that are cancelled when their time is up, stages that stop when they add little, and progress told as it comes."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

T = TypeVar("T")
#: Between two looks at a cancelled action that may start further jobs before it ends, in seconds.
_AGAIN = 0.05


class DeadlineExceeded(RuntimeError):
    pass


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """What ``action`` gives, if it does so in time; else its jobs are cancelled, those it still starts too.

    The action's jobs share a job group of their own, so nothing else is touched. It has ended when this returns.
    """
    group, out = f"deadline-{uuid.uuid4().hex}", {}
    sc = spark.sparkContext

    def run() -> None:
        sc.setJobGroup(group, "under a deadline", True)
        try:
            out["value"] = action()
        except BaseException as e:  # told to the caller below
            out["error"] = e

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(max(0.0, seconds))
    late = thread.is_alive()
    while thread.is_alive():
        sc.cancelJobGroup(group)
        thread.join(_AGAIN)
    if late:
        raise DeadlineExceeded(f"not done within {seconds:.3f} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


@dataclass
class Stage:
    """A step that gives a bounded list of candidates (key, score), told those found so far."""

    name: str
    run: Callable[[list[Row]], DataFrame]
    seconds: float
    limit: int


@dataclass
class StageTrace:
    name: str
    status: str
    seconds: float = 0.0
    added: int = 0
    gain: float = 0.0


@dataclass
class Outcome:
    """The candidates by key, best score each; a trace a stage; why it ended before its last stage, if it did."""

    candidates: dict[object, float] = field(default_factory=dict)
    traces: list[StageTrace] = field(default_factory=list)
    reason: str | None = None


def run_stages(spark: SparkSession, stages: list[Stage], total: float, threshold: float = 0.0, streak: int = 2) -> Outcome:
    """Run stages in order under their own deadlines and one for all; ``streak`` stages in a row that add less than ``threshold`` end it.

    What a stage adds is told as the growth of the sum of scores against what it was. A stage that is cut adds
    nothing, and the next ones still run while there is time.
    """
    out, low, began = Outcome(), 0, time.monotonic()
    for i, stage in enumerate(stages):
        left = total - (time.monotonic() - began)
        if left <= 0:
            out.reason = out.reason or "deadline"
            out.traces += [StageTrace(s.name, "cancelled_before_start") for s in stages[i:]]
            return out
        known = [Row(key=k, score=s) for k, s in out.candidates.items()]
        started = time.monotonic()
        try:
            rows = within(spark, min(stage.seconds, left), lambda stage=stage, known=known: stage.run(known).limit(stage.limit).collect())
        except DeadlineExceeded:
            out.traces.append(StageTrace(stage.name, "pending_after_deadline", time.monotonic() - started))
            out.reason = out.reason or "deadline"
            continue
        before, n = sum(out.candidates.values()), len(out.candidates)
        for r in rows:
            out.candidates[r["key"]] = max(out.candidates.get(r["key"], r["score"]), r["score"])
        after = sum(out.candidates.values())
        gain = after if before <= 0 else max(0.0, (after - before) / before)
        out.traces.append(StageTrace(stage.name, "completed", time.monotonic() - started, len(out.candidates) - n, gain))
        low = low + 1 if gain < threshold and out.candidates else 0
        if low >= streak and i + 1 < len(stages):
            out.reason = out.reason or "marginal_gain"
            out.traces += [StageTrace(s.name, "skipped") for s in stages[i + 1 :]]
            return out
    return out


class Progress(StreamingQueryListener):
    """Tells each batch of each stream to those who listen, and keeps the last ``most``."""

    def __init__(self, tell: Callable[[dict], None] | None = None, most: int = 1000) -> None:
        self.tell, self.most = tell, most
        self.told: list[dict] = []
        self._lock = threading.Lock()

    def _note(self, **event: object) -> None:
        with self._lock:
            self.told = [*self.told, event][-self.most :]
        if self.tell:
            self.tell(event)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self._note(event="started", query=str(event.id), name=event.name)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        p = event.progress
        self._note(event="progress", query=str(p.id), name=p.name, batch=p.batchId, rows=p.numInputRows, seconds=p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        self._note(event="idle", query=str(event.id))

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self._note(event="ended", query=str(event.id), error=event.exception)
