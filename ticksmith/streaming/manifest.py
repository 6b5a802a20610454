"""A small versioned file beside a table: which of its folders are live.

Written under another name and renamed, so a reader sees a whole version or the
one before; works on any file system Spark can reach.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))


def load(spark: SparkSession, folder: str, before: int | None = None) -> dict | None:
    """The newest version (below ``before``), or None."""
    found = [v for v in versions(spark, folder) if before is None or v < before]
    if not found:
        return None
    fs, where = _fs(spark, f"{folder}/v-{found[-1]}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def save(spark: SparkSession, folder: str, version: int, content: dict, keep: int = 2) -> None:
    """Make ``content`` version ``version`` (again, if it is replayed); older ones but ``keep - 1`` go."""
    fs, where = _fs(spark, f"{folder}/v-{version}.json")
    _, part = _fs(spark, f"{folder}/.part-{version}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise RuntimeError(f"cannot write {where}")
    for old in [v for v in versions(spark, folder) if v < version][:-(keep - 1) or None]:
        fs.delete(_fs(spark, f"{folder}/v-{old}.json")[1], False)
