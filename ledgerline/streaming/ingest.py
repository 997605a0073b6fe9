"""File-stream ingestion of the two daily source feeds (ARR and product usage).

Daily CSV drops are read with the fixed source schema, filtered like staging (rows
without a key or date are dropped), and appended to a parquet table partitioned by
month. The stream checkpoint makes each input file land exactly once, also when the
job is restarted after a failure; the batch mart is then rebuilt from the tables with
``sources.read_parquet_sources``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.dates import month_start
from ledgerline.schemas import source_schemas

# Key columns of the two daily feeds.
DAILY_KEYS = {"arr_daily": "billing_account_id", "app_usage_daily": "app_user_id"}


def ingest_daily(
    spark: SparkSession,
    name: str,
    source_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    id_type: T.DataType = T.StringType(),
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingestion stream of ``arr_daily`` or ``app_usage_daily``.

    ``available_now`` processes every file present and stops (a scheduled run);
    otherwise the stream keeps polling ``source_dir`` for new files.
    """
    if name not in DAILY_KEYS:
        raise ValueError(f"not a daily feed: {name}")
    schema = source_schemas(id_type)[name]
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(source_dir)
    )
    rows = raw.where(F.col(DAILY_KEYS[name]).isNotNull() & F.col("date").isNotNull()).withColumn(
        "snapshot_month", month_start("date")
    )
    writer = (
        rows.writeStream.format("parquet")
        .option("path", table_dir)
        .option("checkpointLocation", checkpoint_dir)
        .partitionBy("snapshot_month")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
