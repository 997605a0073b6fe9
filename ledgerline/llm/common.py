"""Helpers shared by the operators: shared storage, row ids, skew-safe joins, text folding."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# bytes.translate table that lower-cases A-Z and leaves every other byte alone
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session, else the
    context's checkpoint folder. Only a ``local`` session without either (tests) gets a
    fresh local folder; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-llm-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; never reused, so never stale."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor rereads files instead of recomputing, and values
    that depend on the partitioning (row ids) keep the value that was written."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def carried(docs: DataFrame, carry: Sequence[str], text_col: str, result: str) -> tuple[DataFrame, T.StructType]:
    """The ``carry`` columns and then the text, under names of their own, and the schema of the
    carried and the ``result`` columns. A result column wins over a carried one of its name."""
    made = T.StructType.fromDDL(result)
    kept = [c for c in dict.fromkeys(carry) if c not in made.names]
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(*[named(c).alias(f"__c{i}") for i, c in enumerate(kept)], named(text_col).alias("__t"))
    fields = [T.StructField(c, f.dataType) for c, f in zip(kept, rows.schema)]
    return rows, T.StructType([*fields, *made])


@lru_cache(maxsize=None)
def _shipped(application: str, spark: SparkSession) -> None:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ledgerline-py-")), "ledgerline.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)


#: Rows of an Arrow batch, unless the session sets another number than Spark's default: a batch of
#: 10,000 long texts is copied several times on its way to Python and back.
BATCH_ROWS = 1024
#: Bytes of texts that a task works on at a time (one text at least).
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about ``SLICE_BYTES`` of text in ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``, with this package's code sent to the executors once per application.

    At the end of a task its Python worker, which stays for later ones, gives the memory of
    the batches back to the system."""
    spark = df.sparkSession
    _shipped(spark.sparkContext.applicationId, spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def held_out(id_col: str) -> F.Column:
    """True for the rows kept out of training: crc32 of the id's text is a multiple of 5
    (a null id counts as an empty text, so it is held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: A group is hot when it has more than 1/HOT_SHARE of all rows, so there are fewer than
#: HOT_SHARE hot groups whatever the data: that bounds what ``attach`` broadcasts.
HOT_SHARE = 1000


#: Sides of at most this many narrow rows (a few dozen bytes each) are broadcast.
BROADCAST_ROWS = 200_000


def narrow_side(side: DataFrame, rows: int) -> DataFrame:
    """``side`` marked for broadcast when its counted ``rows`` are few; else left to a shuffle join."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", counted: int | None = None) -> DataFrame:
    """``rows`` joined to the one row that ``groups`` has for their ``key``.

    ``size`` is the group's row count. The fewer than HOT_SHARE groups that hold over
    1/HOT_SHARE of the rows are broadcast, so their rows never move; the others meet in
    a shuffle join in which no key can have more than that share. All groups are broadcast
    when they are ``counted`` and few."""
    if counted is not None and counted <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, how)
    limit = total // HOT_SHARE
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))
