"""Limits that abort: a deadline for jobs, bounds for results. Nothing is ever cut short and passed on."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from factloom.operators.shared import written

T = TypeVar("T")


class LimitExceeded(RuntimeError):
    """A deadline or a bound was passed; there is no result."""


def within(spark: SparkSession, seconds: float, action: Callable[[], T], what: str = "the check") -> T:
    """The result of ``action``; its Spark jobs carry a tag of their own, and are cancelled at the deadline.

    Other jobs of the session go on. An action that ends by itself after the deadline is late as well.
    """
    sc, tag, over = spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)  # a session's own tags are known to the thread that sets them only

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer.start()
    try:
        result = action()
    except Exception as e:
        if over.is_set():
            raise LimitExceeded(f"{what} took more than {seconds:g} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
    if over.is_set():
        raise LimitExceeded(f"{what} took more than {seconds:g} seconds")
    return result


def bounded(df: DataFrame, most: int, what: str = "the result") -> DataFrame:
    """The table, written once, if it has ``most`` rows at most: the count is observed as it is written, with no second scan."""
    out, told = written(df)
    if told["n"] > most:
        raise LimitExceeded(f"{what} has {told['n']} rows, {most} are allowed")
    return out
