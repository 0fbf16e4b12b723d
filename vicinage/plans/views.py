"""Materialised views that queries of one session share.

The universe, the pools and what is derived from them are written once per
session and state of a data folder, as the steps of a pipeline would hand them
on. Views of other names, lengths or times of a folder's files are made anew;
:func:`forget` drops them all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import SparkSession

_KEPT: dict[tuple[str, ...], Any] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Names, lengths and times of the tables of a folder; of a table that is a folder, its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return ";".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


def session_view(build: Callable[[SparkSession, str], Any]) -> Callable[[SparkSession, str], Any]:
    """``build(spark, folder)``, made once per session and state of the folder."""

    @wraps(build)
    def view(spark: SparkSession, folder: str) -> Any:
        key = (spark.sparkContext.applicationId, folder, _state(spark, folder), f"{build.__module__}.{build.__qualname__}")
        if key not in _KEPT:
            _KEPT[key] = build(spark, folder)
        return _KEPT[key]

    return view


def forget() -> None:
    """Drops all views; the next query makes its own again."""
    _KEPT.clear()
