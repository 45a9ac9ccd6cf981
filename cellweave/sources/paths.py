"""Folders and files on any file system Spark can reach, by their names as text."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def clean(path: str | Path) -> str:
    """The path of a database address of the form sqlite:///path; other paths as they are."""
    return str(path).removeprefix("sqlite:///")


def join(base: str | Path, name: str | Path) -> str:
    """name below base; an absolute path or an address stays as it is."""
    name = str(name)
    return name if "://" in name or name.startswith("/") else f"{str(base).rstrip('/')}/{name}"


def parent(path: str | Path) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[0] or "/"


def _fs(spark: SparkSession, path: str | Path):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def move_part(spark: SparkSession, folder: str, target: str) -> None:
    """The only part file of a folder that Spark wrote becomes the file target; the folder goes."""
    fs, p = _fs(spark, folder)
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    _, t = _fs(spark, target)
    fs.delete(t, False)
    if not fs.rename(part, t):
        raise OSError(f"{target} can't be written")
    fs.delete(p, True)
