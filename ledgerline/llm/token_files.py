"""Token ids as flat binary files with 64-bit document offsets.

``write_token_files`` deals the documents out by ranges of their id, so that the files in
the order of their number hold the documents in ascending id order. Each task encodes its
whole texts and streams them to two files of its own:

* ``<name>.bin``: the ids of all its documents, one after another, as little-endian
  unsigned integers (16 bits when the vocabulary fits, else 32);
* ``<name>.idx``: little-endian int64 ``n``, ``n + 1`` document offsets into the ``.bin``
  file (in ids), ``n`` document ids, and ``n`` bytes that are 1 where the id is not null.

The tasks report their counts, and the prefix sum of these gives every file the number of
ids before it (``base``); this list, one row per file, is the Parquet table ``manifest``.
Only files named in it count: a task that is run again writes files with other names, and
what a lost one left behind is never read. ``read_token_files`` maps the files into
memory (other file systems than local ones: reads them) and returns the documents.

Defined results: a null text is empty (its only id is the end id); null ids come first;
rows that repeat an id are ordered by a hash of their text. An empty table gives an empty
manifest and an empty result. Further columns are ignored. Ids are whole numbers (text ids
that are none are an error in ANSI mode). A path without a scheme lies in Spark's default file
system, as anywhere in Spark.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import map_arrow, narrow_side, slices
from ledgerline.llm.tokens import encoder

#: documents that the reader returns at a time
READ_DOCS = 256


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark's configuration gives it, as an address Arrow knows."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()
    for scheme in ("s3a://", "s3n://"):
        if found.startswith(scheme):
            return "s3://" + found[len(scheme) :]
    return found


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_level: bool = False,
) -> DataFrame:
    """Writes the files of ``docs`` under ``path`` (new, shared by all executors); returns the manifest."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)

    files = _qualified(docs.sparkSession, path)
    _file_system(files)  # an address that Arrow can't open fails here, not in the tasks

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer, word_level)
        store, folder = _file_system(files)
        store.create_dir(folder, recursive=True)
        offsets, ids, present = array("q", [0]), array("q"), bytearray()
        with store.open_output_stream(f"{folder}/{name}.bin") as out:
            for batch in batches:
                for docs_ in slices(batch, 1):
                    found, ends = enc.encode(docs_.column(1), end_id)
                    out.write(found.tobytes())
                    offsets.frombytes((ends[1:] + offsets[-1]).tobytes())
                    ids.frombytes(docs_.column(0).fill_null(0).to_numpy().tobytes())
                    present += docs_.column(0).is_valid().to_numpy(zero_copy_only=False).tobytes()
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.array([len(ids), *offsets, *ids], "<i8").tobytes() + bytes(present))
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "docs": [len(ids)], "ids": [offsets[-1]], "bytes_per_id": [enc.dtype.itemsize]}
        )

    written = f"{path}/written"
    map_arrow(rows, write, "part long, name string, docs long, ids long, bytes_per_id long").write.parquet(written)
    spark = docs.sparkSession
    # one row per file: the only step in a single task
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = spark.read.parquet(written).where("docs > 0")
    parts = parts.withColumns({"base": F.coalesce(before, F.lit(0)), "file": F.row_number().over(Window.orderBy("part")) - 1})
    parts.write.parquet(f"{path}/manifest")
    return spark.read.schema(parts.schema).parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents under ``path``: doc_id, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, as binary)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    count = manifest.count()
    # one task per file
    dealt = spark.range(0, count, 1, max(1, count)).join(narrow_side(manifest, count), F.col("id") == F.col("file"))
    schema = "doc_id long, start long, n_tokens long, ids binary"
    where = _qualified(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _file_system(where)

        def opened(name: str) -> pa.NativeFile:
            local = isinstance(store, pafs.LocalFileSystem)
            return pa.memory_map(f"{folder}/{name}") if local else store.open_input_file(f"{folder}/{name}")

        for batch in batches:
            for row in batch.to_pylist():
                with opened(f"{row['name']}.idx") as file:
                    index = file.read_buffer()
                n = row["docs"]
                numbers = np.frombuffer(index, "<i8", 2 * n + 2)
                offsets, ids = numbers[1 : n + 2], numbers[n + 2 :]
                missing = np.frombuffer(index, np.uint8, n, 8 * (2 * n + 2)) == 0
                width = row["bytes_per_id"]
                with opened(f"{row['name']}.bin") as file:
                    for i in range(0, n, READ_DOCS):
                        at = offsets[i : min(i + READ_DOCS, n) + 1]
                        file.seek(int(at[0]) * width)
                        tokens = np.frombuffer(file.read_buffer(int(at[-1] - at[0]) * width), f"<u{width}").astype("<u4")
                        part = at - at[0]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[i : i + READ_DOCS], pa.int64(), mask=missing[i : i + READ_DOCS]),
                                pa.array(at[:-1] + row["base"], pa.int64()),
                                pa.array(np.diff(at), pa.int64()),
                                pa.array([tokens[a:b].tobytes() for a, b in zip(part[:-1], part[1:])], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return map_arrow(dealt.select("name", "docs", "bytes_per_id", "base"), read, schema)
