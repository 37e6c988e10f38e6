"""Steps that don't depend on each other, run side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

#: Steps at a time; more would hold more scratch tables at once and gain little, as their stages share the cores.
SIDE_BY_SIDE = 6


def together(spark: SparkSession, steps: list[Callable]) -> list:
    """Results of ``steps`` in their order; the first error is raised once all that run have ended.

    Each step submits its own Spark jobs, so short stages of one fill cores that
    those of another leave idle. Steps may call ``together`` themselves.
    """
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(steps))) as pool:
        return list(pool.map(lambda step: step(), [inheritable_thread_target(spark)(step) for step in steps]))
