"""Session construction and lineage cuts through the cluster's shared checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job here relies on: UTC dates, AQE with skew handling, no UI.
# Broadcasts only on *measured* sizes: planning-time estimates are off (disabled), and
# AQE turns a shuffle join into a broadcast once a side's shuffle output is known to be
# under the adaptive threshold.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Joins on (account, month) whose sides are already hash-partitioned by account after
    # per-account windows keep that partitioning instead of reshuffling on both keys; an
    # account has at most one row per month there, so account alone cannot skew.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def apply_sql_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings of ``DEFAULT_CONF`` on a session built by the submitter."""
    for key, value in DEFAULT_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


# Most bytes of a file, and of a shuffle, that one task reads, and rows of the largest input to a
# shuffle partition. A wide aggregate, sort or merge join holds some 30 times its compressed
# input, so a task of Spark's 128 MB and 64 MB needs gigabytes; with these, input that grows
# gives more tasks and not larger ones.
TASK_FILE_BYTES, TASK_SHUFFLE_BYTES, TASK_ROWS = 4 << 20, 8 << 20, 250_000


def _bytes(size: str) -> int:
    """Bytes of a Spark size such as ``64MB``, ``8m`` or ``67108864b``."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.rstrip("b") or " ")


_SHUFFLE = "spark.sql.shuffle.partitions"
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _merges(spark: SparkSession) -> bool:
    """Whether adaptive execution merges small partitions of a shuffle; only then Spark reads ``_INITIAL``."""
    keys = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    return all(spark.conf.get(k).lower() == "true" for k in keys)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with in this session."""
    initial = spark.conf.get(_INITIAL, None) if _merges(spark) else None
    return int(initial or spark.conf.get(_SHUFFLE))


def bound_tasks(spark: SparkSession, rows: int) -> None:
    """Keep the input of one task the same for any size of the tables, of which the largest has
    ``rows`` rows. Smaller sizes and more partitions that are set already stay."""
    for key, most in (
        ("spark.sql.files.maxPartitionBytes", TASK_FILE_BYTES),
        ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_SHUFFLE_BYTES),
    ):
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    # what a shuffle starts with; adaptive execution merges the small ones up to the size above
    least = max(-(-rows // TASK_ROWS), int(spark.conf.get(_SHUFFLE)))
    if least > shuffle_partitions(spark):
        spark.conf.set(_INITIAL if _merges(spark) else _SHUFFLE, str(least))


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins made meanwhile keep a partitioning by some of their keys, as in ``DEFAULT_CONF``,
    also in a session of the submitter that leaves Spark's default."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, DEFAULT_CONF[key])
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app_name: str = "ledgerline") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter builds the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (else the folder set
    on the context). Tables written here outlive one session; their keys say what made them."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    try:
        return spark.sparkContext.getCheckpointDir() or None
    except Exception:  # a remote (Connect) session has no SparkContext here
        return None


def _code_version() -> str:
    """Hash of this package's source: a table written by other code is never reused."""
    root = os.path.dirname(os.path.abspath(__file__))
    h = hashlib.sha1()
    for dirpath, _, files in sorted(os.walk(root)):
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(dirpath, name), "rb") as fh:
                h.update(name.encode() + fh.read())
    return h.hexdigest()[:12]


CODE_VERSION = _code_version()


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the session's checkpoint folder. Only a local session (tests, local bench) without
    one gets a fresh local folder; on a cluster plans then stay lazy and nothing is written."""
    existing = checkpoint_dir(spark)
    if existing:
        return existing
    try:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            return None
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir="/tmp"))
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # a remote (Connect) session: plans stay lazy, nothing is written
        return None


_WRITTEN: dict[tuple[str, str], str] = {}


def _complete(spark: SparkSession, path: str) -> bool:
    """True when a committed write (its ``_SUCCESS`` marker) exists at ``path``, asked of
    the session's Hadoop file system; no data is read."""
    try:
        jvm = spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker))
    except Exception:  # no JVM gateway (a remote session): list the marker through a reader
        try:
            spark.read.text(f"{path}/_SUCCESS")
            return True
        except AnalysisException:
            return False


def materialize(
    df: DataFrame,
    name: str,
    key: str,
    partition_by: str | None = None,
    cluster_by: tuple[str, ...] = (),
    write_as: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads files instead of recomputing the
    whole mart) and lets later reports prune columns and partitions. The same
    ``key`` within one checkpoint folder reuses the written table. With no
    checkpoint folder configured the lazy plan is returned unchanged. The key must name
    the inputs (and their versions); the package's code version is added to it. ``write_as``
    gives an equal plan whose making runs a job, and is called only for a table not yet written.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if not base:
        return df
    digest = hashlib.sha1(f"{CODE_VERSION}|{key}".encode()).hexdigest()[:16]
    path = f"{base.rstrip('/')}/ledgerline/{name}-{digest}"
    cache_key = (base, path)
    if cache_key not in _WRITTEN and _complete(spark, path):
        _WRITTEN[cache_key] = path
    if cache_key not in _WRITTEN:
        out = write_as() if write_as else df
        if partition_by:
            # REBALANCE on the partition column: AQE groups rows by month, merges small
            # months and splits a month larger than the advisory size across tasks, with
            # no sampling pass over the input (a range repartition would run the last
            # stage twice). Sorted inside each task, so row groups carry tight min/max
            # statistics of the cluster keys.
            out = out.hint("rebalance", partition_by).sortWithinPartitions(partition_by, *cluster_by)
        writer = out.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # The committer writes ``_SUCCESS`` only after the job commits, and readers require
        # it. A folder that already exists without it belongs to another run still writing
        # (or to a failed one): then this run writes a folder of its own.
        try:
            writer.parquet(path)
        except AnalysisException:
            if not _complete(spark, path):
                path = f"{path}.{uuid.uuid4().hex}"
                writer.parquet(path)
        _WRITTEN[cache_key] = path
    path = _WRITTEN[cache_key]
    return read_back(spark, path, df.schema, partition_by)


def read_back(spark: SparkSession, path: str, schema, partition_by: str | None) -> DataFrame:
    """A written table, with the latest value of its partition column noted on it.

    The value is one row computed on the executors from the partition values alone. It is
    set on this exact DataFrame only: a filtered or projected child is a new object without
    it, so its rows are never described by it."""
    back = spark.read.schema(schema).parquet(path).select(*schema.names)
    if partition_by:
        back._ledgerline_latest = {partition_by: back.agg(F.max(partition_by)).first()[0]}
    return back


def latest_partition(df: DataFrame, column: str):
    """Largest value of the partition column of a table returned by ``read_back`` itself, else None."""
    return getattr(df, "_ledgerline_latest", {}).get(column)
