"""Session set-up and the shared scratch folder.

Everything in the library is a ``DataFrame -> DataFrame`` function; nothing
holds a session. These helpers only build one for scripts and tests, and
resolve where checkpoints and sink folders go.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every plan in the library relies on.
SESSION_DEFAULTS = {
    # ISO strings in transit are naive; windows and watermarks need one zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ticksmith",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001
        pass
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is local (unit tests on
    one machine) is a private temporary folder chosen and registered. On a
    cluster a machine's own folder would split the data over the executors'
    disks, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        pass
    if not root and sc is not None:
        root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ticksmith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the checkpoint root (sinks, stream state)."""
    path = f"{checkpoint_root(spark)}/ticksmith/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever Spark can reach it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch folders made so far; frames that read them are void afterwards."""
    while _SCRATCH:
        delete_path(spark, _SCRATCH.pop())


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders made inside are removed on leaving: write or collect the results before."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        while len(_SCRATCH) > before:
            delete_path(spark, _SCRATCH.pop())


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
