"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stakewatch")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stakewatch-"))
        .getOrCreate()
    )


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``. A local session that names none gets its own;
    on a cluster a folder of the driver's machine would lose rows, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="stakewatch-")
    return _own_folder[app]


#: Whether the shuffle files of a job go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Whether rows dealt out by some keys of a join are dealt out again by all of them.
DEAL_AGAIN = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def for_writing(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Inside, the shuffle files of a write go when it ends; else they stay until the driver happens to collect its garbage, and those of
    all stages lie on the disks together. Only for rows that are written: nothing runs that plan again."""
    settings = {CLEANUP: "true", **settings}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Tables that the shuffles grow with.
GROWING = ["customer", "supplier", "part", "orders", "lineitem", "events"]
#: Bytes of stored input per shuffle partition, which hold several times as many bytes shuffled.
INPUT_BYTES = 4 << 20
MOST_PARTITIONS = 4096


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Stored size of the growing tables, asked of whatever file system holds them."""
    conf, total = spark._jsc.hadoopConfiguration(), 0
    for name in GROWING:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf)
        if files.exists(path):
            total += files.getContentSummary(path).getLength()
    return total


def size_partitions(spark: SparkSession, sf_dir: str) -> None:
    """Lets the number of shuffle partitions grow with the input, so that a task's share, and the memory of its sorts, does not.

    Rows widen by windows after a shuffle, so a partition that adaptive execution would take for small (64 MB) fills gigabytes of
    sort memory and spills. It still joins small partitions, up to the size set here."""
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = min(max(fixed, input_bytes(spark, sf_dir) // INPUT_BYTES), max(fixed, MOST_PARTITIONS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(number))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
