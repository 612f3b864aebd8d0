"""A runner of steps on the driver: conditions, retries, and what is left when one fails. Steps pass lazy DataFrames on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

#: States of a job, and where each may go next; fixed values.
NEXT = {"queued": ("running", "cancelled"), "running": ("completed", "retrying", "failed", "cancelled"), "retrying": ("running", "cancelled"), "failed": ("dead_letter",)}
ACTIVE = ("queued", "running", "retrying")


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[dict[str, Any]], dict[str, Any] | None]
    only_if: Callable[[dict[str, Any]], bool] | None = None
    attempts: int = 1
    base_delay: float = 0.0
    factor: float = 2.0
    may_fail: bool = False


@dataclass
class Outcome:
    state: str = "completed"
    steps: list[tuple[str, str, int]] = field(default_factory=list)  #: name, state, attempts
    context: dict[str, Any] = field(default_factory=dict)
    error: Exception | None = None

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step string, state string, attempts int")


def run(steps: list[Step], context: dict[str, Any] | None = None, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[str, float], None] = lambda *_: None) -> Outcome:
    """Each step in turn, given what those before it returned. A step that fails is tried again after base_delay * factor ** (attempt - 1) seconds;
    one that may fail is passed over, another ends the run with what there is. Cancelling takes effect between attempts."""
    out = Outcome(context=dict(context or {}))
    for k, step in enumerate(steps):
        if cancelled():
            out.state = "cancelled"
            break
        if step.only_if and not step.only_if(out.context):
            out.steps.append((step.name, "skipped", 0))
            continue
        for attempt in range(1, step.attempts + 1):
            try:
                out.context |= step.run(out.context) or {}
                out.steps.append((step.name, "completed", attempt))
                break
            except Exception as e:  # noqa: BLE001
                if attempt < step.attempts and not cancelled():
                    time.sleep(step.base_delay * step.factor ** (attempt - 1))
                    continue
                out.steps.append((step.name, "failed", attempt))
                if not step.may_fail:
                    out.state, out.error = "failed", e
                break
        if out.state == "failed":
            break
        progress(step.name, (k + 1) / len(steps))
    return out


def moved(state: str, to: str) -> str:
    if to not in NEXT.get(state, ()):
        raise ValueError(f"a job cannot go from {state} to {to}")
    return to


def after_failure(retries: int, most: int, base: float = 10.0) -> tuple[str, float | None]:
    """Whether a failed job is tried again, and after how many seconds; else it is a dead letter."""
    return ("retrying", base * 2.0**retries) if retries < most else ("dead_letter", None)


def guard_single(jobs: DataFrame, key: str, value: object) -> None:
    """Raises if a job of the same key is active."""
    if not jobs.where((jobs[key] == value) & jobs["state"].isin(*ACTIVE)).isEmpty():
        raise RuntimeError(f"a run of {key} {value} is active")
