"""Session settings the engine relies on.

The library never builds its own cluster session: every operator takes the
caller's ``SparkSession``.  ``ensure_semantics`` only sets what the results
depend on (time zone and timestamp type).  ``local_session`` is for tests and
``bench.py``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings that change results, not speed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

# Settings for scale: runtime re-planning, skew splitting and partition
# coalescing.  A cluster session normally sets them already.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of a finished job are removed once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def ensure_semantics(spark: SparkSession) -> SparkSession:
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by whoever runs the job (a folder every
    executor can reach); it is read from the session.  Only when it is unset
    on a local master, as in tests, a scratch folder is created here.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="hortus-ckpt-", dir=os.environ.get("HORTUS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(current)
    return current


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "hortus",
                  checkpoint: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PASSING: ContextVar[list | None] = ContextVar("passing", default=None)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files; else these lie there until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def passing_tables(spark: SparkSession):
    """Tables ``written`` inside, but the ``lasting`` ones, are deleted at the end."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        for path in _PASSING.get():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _PASSING.reset(token)


def written(df, lasting: bool = False, by: str | None = None):
    """``df`` as a Parquet table in the checkpoint folder, read back: its lineage is cut.

    The plan runs once, and what reads the table gets a columnar scan with sizes that AQE can
    plan by; a lost executor costs no recomputation of the upstream plan.  An RDD checkpoint
    would hold whole rows, uncompressed, and a cache of them beside it while it is
    written.  The table lives as long as the folder, or as ``passing_tables`` around it;
    with ``by``, its last column, whoever asks for one value of that reads no others."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    if not lasting and _PASSING.get() is not None:
        _PASSING.get().append(path)
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
