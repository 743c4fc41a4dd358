"""Numbered versions of a table: claimed by one writer each, seen by readers when they are whole.

A writer claims n by the exclusive creation of ``_claims/n``, writes into a hidden
folder and renames it to ``version=n`` when it is finished. Folders that begin
with an underscore are no part of the table, so a plain read of the path gives whole versions only.
A writer that dies leaves a claimed number that is never used.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path and the path itself."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _below(spark: SparkSession, root: JavaObject, name: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, name)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The n of all entries ``<prefix>n`` of a folder."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def finished_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that readers may use, in order."""
    return _numbers(spark, path, "version=")


def next_version(spark: SparkSession, path: str) -> int:
    """First n that is neither written nor claimed."""
    used = {*finished_versions(spark, path), *_numbers(spark, f"{path.rstrip('/')}/_claims", "")}
    return next(n for n in range(1, len(used) + 2) if n not in used)


def _create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists, as one step; whether this call made it."""
    fs, file = _folder(spark, path)
    fs.mkdirs(file.getParent())
    if fs.getScheme() == "file":  # the local file system of the driver has an exclusive create of its own
        try:
            os.close(os.open(urlparse(path).path, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(file, False).close()
    except Py4JJavaError:
        if not fs.exists(file):
            raise
        return False
    return True


def claim_version(spark: SparkSession, path: str) -> int:
    """Claim the first unused n; no two writers get the same."""
    while True:
        n = next_version(spark, path)
        if _create_new(spark, f"{path.rstrip('/')}/_claims/{n}"):
            return n


def write_version(df: DataFrame, path: str, notes: str | None = None) -> int:
    """Write a frame as a new version and give its number; readers see it whole or not at all, with its notes."""
    spark = df.sparkSession
    n = claim_version(spark, path)
    fs, root = _folder(spark, path)
    hidden = f"_writing-{n}"
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{hidden}")
    if notes is not None:
        file = fs.create(_below(spark, root, f"{hidden}/_notes"), False)
        file.write(bytearray(notes.encode()))
        file.close()
    if not fs.rename(_below(spark, root, hidden), _below(spark, root, f"version={n}")):
        raise OSError(f"version {n} of {path} could not be put in place")
    return n


def version_notes(spark: SparkSession, path: str, n: int) -> str | None:
    """The notes that a version was written with."""
    fs, root = _folder(spark, path)
    file = _below(spark, root, f"version={n}/_notes")
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_version(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """One version, by default the newest; FileNotFoundError where there is none."""
    have = finished_versions(spark, path)
    if not have or (n is not None and n not in have):
        raise FileNotFoundError(f"{path}, version {n or 'any'}")
    return spark.read.parquet(f"{path.rstrip('/')}/version={n or have[-1]}")
