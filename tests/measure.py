"""Measure every registered query: median of warm runs, shuffle bytes, and the time
DuckDB takes for the oracle SQL on the same tables (a single-node reference point).

Usage: python tests/measure.py [sf_dir] [runs]   -> prints a markdown table
Shuffle bytes come from Spark's event log, written to a fresh scratch folder.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(ev_dir: str):
    import zstandard

    for f in glob.glob(f"{ev_dir}/**/events_*", recursive=True) + glob.glob(f"{ev_dir}/local-*"):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def shuffle_bytes_by_group(ev_dir: str) -> dict[str, int]:
    job_group, stage_job, out = {}, {}, {}
    for e in _events(ev_dir):
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for sid in e["Stage IDs"]:
                stage_job[sid] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            g = stage_job.get(e["Stage ID"])
            m = e.get("Task Metrics") or {}
            b = (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            if g:
                out[g] = out.get(g, 0) + b
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    ev_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    from pyspark.sql import SparkSession

    from ledgerline import catalog
    from ledgerline.oracle import oracle_sql
    from ledgerline.session import DEFAULT_CONF, ensure_checkpoint_dir
    from tests.compare import duck

    b = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerline-measure")
    conf = dict(DEFAULT_CONF)
    conf.update(
        {
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": ev_dir,
            "spark.driver.memory": "16g",
        }
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ctx = catalog.Context(spark, sf_dir)
    _ = ctx.mart  # sources and mart written once, as in production

    con = duck(sf_dir)
    sqls = oracle_sql()
    rows = []
    for name, fn in catalog.QUERIES.items():
        df = fn(ctx)
        df.write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for i in range(runs):
            spark.sparkContext.setJobGroup(f"{name}#{i}", name)
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        t0 = time.perf_counter()
        con.execute(sqls[name]).fetchall()
        duck_s = time.perf_counter() - t0
        rows.append((name, statistics.median(times), duck_s))
    spark.sparkContext.setJobGroup("done", "done")
    spark.stop()
    sb = shuffle_bytes_by_group(ev_dir)
    print(f"| query | Spark median of {runs} warm runs (s) | shuffle bytes per run | DuckDB oracle, whole chain (s) |")
    print("|---|---|---|---|")
    for name, med, duck_s in rows:
        per_run = statistics.median([sb.get(f"{name}#{i}", 0) for i in range(runs)])
        print(f"| `{name}` | {med:.3f} | {int(per_run):,} | {duck_s:.3f} |")


if __name__ == "__main__":
    main()
