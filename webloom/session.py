"""Session defaults, the shared work folder and scoped planning settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One-off joins may feed an aggregate on the same key; split a hot key
    # there too, even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Vertex programs write a checkpoint per superstep; drop the ones that
    # nothing refers to any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Postings gather short lists under many keys; keep hashing them beyond the
    # default of 128 keys a task instead of sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "50000",
    # Iterative programs build many small plans; do not record a call site for
    # each column function.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Streams that keep every key ever seen hold them on disk, with their changes in the
#: checkpoint.  A query keeps the store it was begun with.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "webloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a temporary folder; on a cluster a
    machine-local path would lose data with its machine, so that is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="webloom-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def planning(spark: SparkSession, settings: Mapping[str, object]) -> Iterator[None]:
    """Plan the enclosed actions with ``settings``, then restore the session."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
