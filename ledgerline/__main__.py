"""Build the lifecycle mart and export the reports and checks.

    python -m ledgerline --csv DIR --as-of 2026-05-01 --out DIR
    spark-submit ... -m ledgerline --parquet DIR --as-of 2026-05-01 --out DIR

Writes ``mart`` (parquet by month), ``reports/<name>`` (sorted CSV with a header) and
``checks/<name>`` (sorted CSV; empty means the check passed), with ``--profiles`` also
``profiles/<name>`` (sorted CSV), to ``OUT/runs/<id>``, and names
that run in ``OUT/published`` when all of it is there, so a run that fails leaves the former
one published (``ledgerline.publish.published_run``). Every run builds the mart from the inputs
as they are now, writes it once, and reads the reports from that table. With ``--state DIR``
(parquet inputs) only the months whose input files changed are aggregated anew. Uses the
session of the submitter, with this package's SQL settings.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ledgerline import publish
from ledgerline.operators.signals import heavy_accounts
from ledgerline.plans import quality, sinks, state
from ledgerline.plans.mart import build_models, lifecycle_mart
from ledgerline.plans.observed import RunChecks
from ledgerline.rules import Rules, as_date
from ledgerline.session import apply_sql_conf, read_back
from ledgerline.sources import read_csv_sources, read_parquet_sources, testdata_sources


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    apply_sql_conf(spark)
    id_type = T.LongType() if args.id_type == "bigint" else T.StringType()
    if args.csv:
        src = read_csv_sources(spark, args.csv, id_type)
    elif args.parquet:
        src = read_parquet_sources(spark, args.parquet, id_type)
    else:
        src = testdata_sources(spark, args.testdata)
    as_of = as_date(args.as_of)
    rules = Rules(trailing_expansion=args.trailing_expansion)
    run_id = uuid.uuid4().hex
    out = f"{args.out.rstrip('/')}/{publish.RUNS}/{run_id}"
    written = {"mart": f"{out}/mart"}
    seen = RunChecks()
    if args.state:
        kept = state.refresh(spark, args.parquet, args.state, id_type, seen, args.strict)
        m = build_models(src, kept.user_month, kept.arr_monthly)
    else:
        m = build_models(src, checks=seen)
    plan = seen.mart(lifecycle_mart(m, as_of, rules, heavy_accounts(m.bridge)))
    sinks.write_mart(plan, written["mart"])
    found = seen.require() if args.strict else seen.found()
    mart = read_back(spark, written["mart"], plan.schema, "snapshot_month")
    for name, path in sinks.export_reports(mart, as_of, f"{out}/reports", rules).items():
        written[f"reports/{name}"] = path
    checks = {
        "dq_unmatched_billing": quality.dq_unmatched_billing(m.staged),
        "dq_duplicate_bridge": quality.dq_duplicate_bridge(m.bridge),
        "dq_repeat_churn": quality.dq_repeat_churn(mart),
        "dq_usage_after_zero_arr": quality.dq_usage_after_zero_arr(mart, limit=None),
        "dq_zero_usage_retained": quality.dq_zero_usage_retained(mart, as_of, rules),
        "dq_multi_movement": quality.dq_multi_movement(m.staged.arr_daily),
        "dq_unique_keys": quality.dq_unique_keys(m.staged, m.bridge, m.arr_monthly),
        "dq_not_null": quality.dq_not_null(m.staged, mart),
        "dq_accepted_values": quality.dq_accepted_values(mart),
        "run_checks": spark.createDataFrame([(n, v) for n, v in found.items() if v], "check_name string, violations bigint"),
    }
    for name, df in checks.items():
        path = f"{out}/checks/{name}"
        sinks.write_csv_report(df, path, sinks.CHECK_ORDER[name])
        written[f"checks/{name}"] = path
    if args.profiles:
        for name, path in sinks.export_profiles(src, m.arr_monthly, f"{out}/profiles").items():
            written[f"profiles/{name}"] = path
    publish.publish_run(spark, args.out.rstrip("/"), run_id)
    return written


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m ledgerline", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the five source CSV files (<name>.csv)")
    src.add_argument("--parquet", help="folder with the five source parquet tables (<name>/)")
    src.add_argument("--testdata", help="folder with the TPC-H style test tables")
    ap.add_argument("--as-of", required=True, help="run date (YYYY-MM-DD) for look-back windows")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--id-type", choices=["string", "bigint"], default="string", help="type of the id columns")
    ap.add_argument("--trailing-expansion", action="store_true", help="trailing 3-month expansion window")
    ap.add_argument("--state", help="folder of the monthly aggregates kept between runs (with --parquet)")
    ap.add_argument("--profiles", action="store_true", help="also write the profiling listings")
    ap.add_argument("--strict", action="store_true", help="stop, with nothing published, if a check of the build finds something")
    args = ap.parse_args(argv)
    if args.state and not args.parquet:
        ap.error("--state needs --parquet")
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    for name, path in run(spark, args).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
