"""Publication of written folders by a rename in the folder's own file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def aside(path: str) -> str:
    """A new hidden folder beside ``path``, which readers of the parent pass over."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def replace(spark: SparkSession, written: str, path: str) -> None:
    """Put a finished folder in the place of ``path``. What was there is moved away first and comes back if the move fails."""
    fs, new = _at(spark, written)
    _, target = _at(spark, path)
    _, old = _at(spark, aside(path))
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved")
    try:
        done = fs.rename(new, target)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(old, target)
        raise OSError(f"{written} can't be moved to {path}")
    if had:
        fs.delete(old, True)
