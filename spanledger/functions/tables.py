"""Cutting lineage between steps, and rows out of arrays."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanledger-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder.

    A step that reads its input several times would otherwise double the plan, and the whole
    history of plans would be analysed again at every step that follows.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unnest(rows: DataFrame, keep: list[str | Column], array: Column, name: str, place: str | None = None) -> DataFrame:
    """One row for each element of an array that is costly to compute.

    explode() would let the optimiser add a filter on the array's size below it, which
    computes the array a second time; an outer explode does not.
    """
    told = F.explode_outer(array).alias(name) if place is None else F.posexplode_outer(array).alias(place, name)
    return rows.select(*keep, told).where(F.col(name if place is None else place).isNotNull())


_REMEMBERED: dict[tuple, Any] = {}


def remembered(build: Callable[..., Any]) -> Callable[..., Any]:
    """Builds column expressions once for each list of arguments.

    Expressions only name columns, so they hold for any table; every step of building one is a
    call into the JVM, and the rules take thousands of them.
    """

    @wraps(build)
    def told(*args):
        key = (id(SparkContext._gateway), build.__module__, build.__qualname__, args)
        if key not in _REMEMBERED:
            _REMEMBERED[key] = build(*args)
        return _REMEMBERED[key]

    return told
