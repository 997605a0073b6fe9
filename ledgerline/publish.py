"""Numbered, committed versions of a result: readers see the last complete one, whatever fails.

What a run makes is written aside, under names of its own. Only then one small table that
names it, the manifest, is written as the next version; Spark's committer marks it with
``_SUCCESS`` as its last act. A run that stops anywhere before leaves the former version in
place, and two runs that end at once can't both write the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _committed(spark: SparkSession, base: str) -> list[int]:
    files, pattern = _file_system(spark, f"{base}/v*/_SUCCESS")
    found = files.globStatus(pattern) or []
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in found)


def _path(base: str, version: int) -> str:
    return f"{base}/v{version:09d}"


def latest(spark: SparkSession, base: str) -> DataFrame | None:
    """The manifest of the last complete version under ``base``, if there is one."""
    versions = _committed(spark, base)
    return spark.read.parquet(_path(base, versions[-1])) if versions else None


def commit(manifest: DataFrame, base: str) -> None:
    """Writes ``manifest`` as the next version; an error if another run has just done so."""
    spark = manifest.sparkSession
    versions = _committed(spark, base)
    at = (versions[-1] if versions else 0) + 1
    files, folder = _file_system(spark, _path(base, at))
    while files.exists(folder):  # left incomplete by a run that failed while it committed
        at += 1
        files, folder = _file_system(spark, _path(base, at))
    manifest.write.mode("errorifexists").parquet(_path(base, at))


def folders(spark: SparkSession, base: str) -> list[str]:
    """Names of the folders in ``base``."""
    files, target = _file_system(spark, base)
    return sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()) if files.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


# ---------------------------------------------------------------- whole runs

RUNS, MANIFEST = "runs", "published"


def publish_run(spark: SparkSession, out: str, run: str) -> None:
    """Makes ``OUT/runs/<run>`` the published one."""
    commit(spark.range(1).selectExpr(f"'{run}' AS run"), f"{out}/{MANIFEST}")


def published_run(spark: SparkSession, out: str) -> str | None:
    """Folder of the run published last under ``out``."""
    manifest = latest(spark, f"{out}/{MANIFEST}")
    return None if manifest is None else f"{out}/{RUNS}/{manifest.first()['run']}"


def remove_old_runs(spark: SparkSession, out: str) -> list[str]:
    """Removes every run but the published one (also incomplete ones; none may be running)."""
    current = published_run(spark, out)
    old = [r for r in folders(spark, f"{out}/{RUNS}") if current is not None and f"{out}/{RUNS}/{r}" != current]
    for run in old:
        remove(spark, f"{out}/{RUNS}/{run}")
    return old
