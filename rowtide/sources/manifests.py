"""Numbered manifests: what a table consists of, decided by the creation of one file.

A manifest names everything that counts at its number. A writer reads the last one,
and creates the next; if another writer was faster, the file exists, and it tries again on
top of that one. A manifest that was never finished is passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    fs, path = _at(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def last_manifest(spark: SparkSession, folder: str) -> tuple[int, list[dict]]:
    """The number and the entries of the last finished manifest; -1 and none at first."""
    fs, path = _at(spark, folder)
    if not fs.exists(path):
        return -1, []
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True)
    numbered = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    highest = int(numbered[0].removesuffix(".json")) if numbered else -1
    for name in numbered:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(path, name))
        try:
            return highest, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["entries"]
        except (ValueError, KeyError):
            continue  # its writer died
        finally:
            stream.close()
    return highest, []


def add_manifest(spark: SparkSession, folder: str, change: Callable[[list[dict]], list[dict]]) -> int:
    """Write the next manifest, with the entries that ``change`` makes of the last one's; its number."""
    fs, path = _at(spark, folder)
    while True:
        number, entries = last_manifest(spark, folder)
        number += 1
        file = spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}.json")
        try:
            out = fs.create(file, False)
        except Py4JJavaError:
            if fs.exists(file):  # another writer has this number
                continue
            raise
        try:
            out.write(bytearray(json.dumps({"entries": change(entries)}).encode()))
        finally:
            out.close()
        return number
