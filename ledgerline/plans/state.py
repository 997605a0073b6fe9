"""Monthly aggregates of the two daily feeds, kept between runs and rebuilt only where files changed.

For each feed the state holds its monthly aggregate (user-months of usage, account-months of
ARR) as parquet under ``ROOT/<aggregate>/run=<id>/snapshot_month=<month>`` and a manifest: the
input files it was made from (path, length, time, months in it) and, for each month, the run that
holds it. A refresh lists the files, reads the new and changed ones for their months, and rebuilds
the months that those or files that are gone have rows in, from all files with rows in them. The new
manifest is committed last (``ledgerline.publish``), so a run that fails changes nothing.

An aggregate of a month depends on that month's rows alone, so the state equals a full build. What
looks across months (``lag``, look-back windows, the run date) is computed on the aggregates, which
are far smaller than the feeds.

On the driver: the file listing, as in any Spark read, and the changed paths.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import publish
from ledgerline.functions.dates import month_start
from ledgerline.operators.intermediate import int_arr_monthly, user_month_usage
from ledgerline.operators.staging import stg_arr_daily, stg_usage_daily
from ledgerline.plans.observed import RunChecks
from ledgerline.schemas import source_schemas

# Aggregate -> its feed and how a month of it is made.
AGGREGATES: dict[str, tuple[str, Callable[[DataFrame, RunChecks | None], DataFrame]]] = {
    "user_month": ("app_usage_daily", lambda raw, checks: user_month_usage(stg_usage_daily(raw), checks and checks.usage)),
    "arr_monthly": ("arr_daily", lambda raw, checks: int_arr_monthly(stg_arr_daily(raw), checks and checks.arr)),
}
MANIFEST = T.StructType(
    [
        T.StructField("aggregate", T.StringType()),
        # an input file and the months in it
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("months", T.ArrayType(T.DateType())),
        # or a month and the run that holds it
        T.StructField("month", T.DateType()),
        T.StructField("run", T.StringType()),
    ]
)


@dataclass
class State:
    """The aggregates as tables, and the months that this refresh rebuilt."""

    user_month: DataFrame
    arr_monthly: DataFrame
    rebuilt: dict[str, list[dt.date]] = field(default_factory=dict)


def _same_path(path: str) -> F.Column:
    """One spelling of a path: Spark writes ``file:/x`` in some places and ``file:///x`` in others."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def input_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path``, ``length``, ``time`` of the parquet files of a table, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(directory).select(_same_path("path").alias("path"), "length", F.col("modificationTime").alias("time"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def _months(rows: DataFrame, column: str) -> list[dt.date]:
    return [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def _read(spark: SparkSession, schema: T.StructType, directory: str, paths: list[str] | None) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.parquet(directory) if paths is None else reader.option("basePath", directory).parquet(*paths)


def _rows_of(spark: SparkSession, schema: T.StructType, directory: str, files: DataFrame, months: list[dt.date] | None) -> DataFrame:
    """The feed's rows in ``months`` (None: all), from the files that have any."""
    if months is None:
        return _read(spark, schema, directory, None)
    wanted = F.array(*[F.lit(m) for m in months]).cast("array<date>")
    needed = [r["path"] for r in files.where(F.arrays_overlap("months", wanted)).select("path").collect()]
    if not needed:
        return spark.createDataFrame([], schema)
    # the range of days reaches the scan; the months decide
    day = F.col("date")
    rows = _read(spark, schema, directory, needed)
    return rows.where((day >= months[0]) & (day <= F.last_day(F.lit(months[-1]))) & month_start("date").isin(months))


def _refresh_one(
    spark: SparkSession, name: str, directory: str, root: str, schema: T.StructType, old: DataFrame, checks: RunChecks | None
) -> tuple[DataFrame, list[dt.date] | None]:
    """The manifest rows of one aggregate after its changed months are rebuilt, and those months (None: no file changed)."""
    key = ["path", "length", "time"]
    old = old.where(F.col("aggregate") == name)
    known = old.where(F.col("path").isNotNull()).select(*key, "months")
    parts = old.where(F.col("path").isNull()).select("month", "run")
    now = input_files(spark, directory)
    first = known.isEmpty()
    changed = now.join(known, key, "left_anti")
    paths = None if first else [r["path"] for r in changed.select("path").collect()]
    gone = [] if first else _months(known.join(now, key, "left_anti").select(F.explode("months").alias("month")), "month")
    if paths == [] and not gone:
        return old, None
    run = uuid.uuid4().hex
    # months of the new files, written so that they are read once
    aside = f"{root}/changes/{run}"
    if paths != []:
        seen = _read(spark, schema, directory, paths).select(_same_path("_metadata.file_path").alias("path"), month_start("date").alias("month"))
        seen.where("month is not null").distinct().write.parquet(aside)
        fresh = spark.read.parquet(aside)
    else:
        fresh = spark.createDataFrame([], "path string, month date")
    by_file = fresh.groupBy("path").agg(F.sort_array(F.collect_set("month")).alias("months"))
    files = known.join(now, key, "left_semi").unionByName(
        changed.join(by_file, "path", "left").select(*key, F.coalesce("months", F.array().cast("array<date>")).alias("months"))
    )
    months = sorted({*gone, *_months(fresh, "month")})
    held = []
    if first or months:
        rows = _rows_of(spark, schema, directory, files, None if first else months)
        made = AGGREGATES[name][1](rows, checks).hint("rebalance", "snapshot_month").sortWithinPartitions("snapshot_month")
        made.write.partitionBy("snapshot_month").parquet(f"{root}/{name}/run={run}")
        held = [d.split("=", 1)[1] for d in publish.folders(spark, f"{root}/{name}/run={run}") if d.startswith("snapshot_month=")]
    new = spark.createDataFrame([(dt.date.fromisoformat(m), run) for m in held], "month date, run string")
    kept = parts if first else parts.where(~F.col("month").isin(months))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in MANIFEST}
    named = [d.withColumns({c: v for c, v in nothing.items() if c not in d.columns}).select(*MANIFEST.names) for d in (files, kept.unionByName(new))]
    return named[0].unionByName(named[1]).withColumn("aggregate", F.lit(name)), months


def _table(spark: SparkSession, name: str, root: str, manifest: DataFrame, shape: DataFrame) -> DataFrame:
    """One scan over the months of an aggregate, wherever their runs lie."""
    parts = manifest.where((F.col("aggregate") == name) & F.col("month").isNotNull()).select("month", "run").collect()
    if not parts:
        return shape.limit(0)
    schema = T.StructType([*[f for f in shape.schema if f.name != "snapshot_month"], T.StructField("run", T.StringType()), shape.schema["snapshot_month"]])
    paths = [f"{root}/{name}/run={p['run']}/snapshot_month={p['month']}" for p in parts]
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths).select(*shape.columns)


def refresh(
    spark: SparkSession,
    directory: str,
    root: str,
    id_type: T.DataType = T.StringType(),
    checks: RunChecks | None = None,
    strict: bool = False,
) -> State:
    """Brings the state under ``root`` up to the parquet feeds ``{directory}/<feed>`` and returns it.
    ``checks`` counts repeated days in the rebuilt months; with ``strict`` any of them is an error
    and the former state stays, so the next run finds them again."""
    directory, root = directory.rstrip("/"), root.rstrip("/")
    schemas = source_schemas(id_type)
    old = publish.latest(spark, f"{root}/manifest")
    old = _empty(spark) if old is None else old
    rows, rebuilt, shapes, changed = [], {}, {}, False
    for name, (feed, make) in AGGREGATES.items():
        part, months = _refresh_one(spark, name, f"{directory}/{feed}", root, schemas[feed], old, checks)
        rows.append(part.select(*MANIFEST.names))
        changed = changed or months is not None
        rebuilt[name] = months or []
        shapes[name] = make(spark.createDataFrame([], schemas[feed]), None)
    if strict and checks:
        checks.require()
    if changed:
        publish.commit(rows[0].unionByName(rows[1]).coalesce(1), f"{root}/manifest")
    manifest = publish.latest(spark, f"{root}/manifest")
    return State(*[_table(spark, n, root, manifest, shapes[n]) for n in AGGREGATES], rebuilt)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Removes the runs that no month of the last manifest lies in (none may be refreshing)."""
    root, manifest = root.rstrip("/"), publish.latest(spark, f"{root.rstrip('/')}/manifest")
    if manifest is None:
        return []
    used = {r["run"] for r in manifest.where("run is not null").select("run").distinct().collect()}
    old = [f"{root}/{n}/{d}" for n in AGGREGATES for d in publish.folders(spark, f"{root}/{n}") if d.removeprefix("run=") not in used]
    for path in [*old, *(f"{root}/changes/{d}" for d in publish.folders(spark, f"{root}/changes"))]:
        publish.remove(spark, path)
    return old
