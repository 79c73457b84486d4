"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session for the spark-submit jobs. `master` is left to spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    A machine-local folder is only made up in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stayflow-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root; every run gets its own."""
    return f"{shared_root(spark)}/stayflow/{label}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def _set_by_user(spark: SparkSession, name: str) -> bool:
    """Whether the session has a value of its own for a setting, rather than Spark's default."""
    return name in spark.conf.getAll


@contextmanager
def stream_conf(spark: SparkSession):
    """Fix the state store and the number of state partitions while a streaming query starts.

    State lies in RocksDB, so that it need not fit in executor memory, unless the session names another store.

    A stateful query keeps the partition count of its first start for the life of its checkpoint and is
    not coalesced at run time. spark.stayflow.state.partitions names it; otherwise a cluster uses its
    spark.sql.shuffle.partitions and local mode its cores.
    """
    name, store = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"
    before, own_store = spark.conf.get(name), _set_by_user(spark, store)
    local = spark.sparkContext.master.startswith("local")
    wanted = spark.conf.get("spark.stayflow.state.partitions", None)
    if not own_store:
        spark.conf.set(store, ROCKSDB)
    spark.conf.set(name, wanted or (str(spark.sparkContext.defaultParallelism) if local else before))
    try:
        yield
    finally:
        spark.conf.set(name, before)
        if not own_store:
            spark.conf.unset(store)
