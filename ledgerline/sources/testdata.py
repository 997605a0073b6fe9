"""Derive the five raw tables from the driver's TPC-H style tables.

The reference's own CSVs are not public, so its sources are rebuilt from
``customer``, ``orders`` and ``lineitem`` with integer arithmetic that gives the
same values in Spark and in SQL (see FIXTURES.md §3). Every table grows with the
inputs; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.files import Sources

# Offset of second app accounts and the ARR unit of the mapping.
SECOND_APP_OFFSET = 10_000_000
ARR_UNIT = 1200


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_order_dates(orders: DataFrame) -> DataFrame:
    """Earliest order DATE per customer (``d0``)."""
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("d0")
    )


def _customers_with_d0(customer: DataFrame, orders: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_name", "c_mktsegment")
    return c.join(_first_order_dates(orders), on="c_custkey", how="left")


def billing_accounts(cust: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    bridge = F.when(k % 6 == 5, F.lit(None)).when(k % 20 == 1, k - 1).otherwise(k)
    return cust.select(
        k.alias("billing_account_id"),
        F.col("c_name").alias("billing_account_name"),
        bridge.cast("bigint").alias("billing_account_bridge_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("d0").alias("created_date"),
    )


def _app_row(app_id: Column, signup: Column, internal: Column) -> list[Column]:
    return [
        app_id.cast("bigint").alias("app_account_id"),
        F.concat(F.lit("App "), app_id.cast("string")).alias("app_account_name"),
        F.lit(None).cast("bigint").alias("app_parent_account_id"),
        F.col("c_custkey").alias("app_root_account_id"),
        F.col("c_custkey").alias("billing_account_bridge_id"),
        signup.alias("signup_date"),
        F.lit(None).cast("date").alias("trial_end_date"),
        internal.alias("is_internal_account"),
    ]


def app_accounts(cust: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    primary = cust.where(k % 6 != 5).select(
        *_app_row(
            k,
            F.when(k % 4 == 0, F.lit(None).cast("date")).otherwise(F.date_add("d0", (k % 15).cast("int"))),
            k % 50 == 7,
        )
    )
    second = cust.where(k % 10 == 2).select(*_app_row(k + SECOND_APP_OFFSET, F.col("d0"), F.lit(False)))
    return primary.unionByName(second)


def _user_cols(user_id: Column, app_id: Column, owner: Column, internal: Column) -> list[Column]:
    return [
        user_id.alias("app_user_id"),
        F.concat(F.lit("User "), user_id.cast("string")).alias("app_user_name"),
        app_id.alias("app_account_id"),
        F.when(user_id % 2 == 0, F.lit("basic")).otherwise(F.lit("pro")).alias("seat_tiers_array"),
        F.lit(None).cast("date").alias("signup_date"),
        owner.alias("is_account_owner"),
        internal.alias("is_internal_user"),
    ]


def app_users(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Active users: one per distinct (customer, line number); idle users: one per customer."""
    pairs = (
        lineitem.select("l_orderkey", "l_linenumber")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), on="l_orderkey")
        .select("o_custkey", "l_linenumber")
        .distinct()
    )
    ck, ln = F.col("o_custkey"), F.col("l_linenumber")
    active = pairs.select(
        *_user_cols(
            ck * 10 + ln,
            F.when((ck % 10 == 2) & (ln > 4), ck + SECOND_APP_OFFSET).otherwise(ck),
            ln == 1,
            (ln == 7) & (ck % 5 == 0),
        )
    )
    c = F.col("c_custkey")
    idle = customer.select(*_user_cols(c * 10, c, F.lit(False), F.lit(False)))
    return active.unionByName(idle)


def app_usage_daily(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per (user, ship date): raw line items repeat, so counters are summed."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    rows = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), on="l_orderkey")
    q = F.col("l_quantity").cast("bigint")
    a = F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint")

    def ind(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    # How each counter is derived from the line quantity.
    counters = {
        "meeting_count": a * (q % 4),
        "page_view_count": a * (q % 7 + 1),
        "page_visit_count": a * (q % 5),
        "note_viewed_count": a * (q % 3),
        "ai_chat_message_submitted_count": a * ind(q % 10 == 0),
        "note_synced_count": a * (q % 2),
        "dashboard_viewed_count": a * ind(q == 50),
        "meeting_agenda_viewed_count": a * 2 * ind(q % 6 == 0),
        "task_synced_count": a * (q % 3),
    }
    keyed = rows.select(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("o_custkey") * 10 + F.col("l_linenumber")).alias("app_user_id"),
        *[v.alias(k) for k, v in counters.items()],
    )
    return keyed.groupBy("date", "app_user_id").agg(*[F.sum(k).cast("bigint").alias(k) for k in counters])


def arr_daily(orders: DataFrame) -> DataFrame:
    """One row per (customer, order date) from the order with the largest key that day;
    ``starting_arr`` is the customer's previous ``ending_arr`` (0 for the first)."""
    from pyspark.sql import Window

    per_day = orders.groupBy(
        F.col("o_custkey").alias("billing_account_id"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(
        F.max("o_orderkey").alias("last_key"),
        F.max_by("o_totalprice", "o_orderkey").alias("last_price"),
    )
    k = F.col("billing_account_id")
    ending = (
        F.when(k % 3 == 0, F.lit(ARR_UNIT) * (F.year("date") - 1994))
        .when(F.col("last_key") % 9 == 0, F.lit(0))
        .otherwise(F.floor(F.col("last_price") / 100000) * (10 * ARR_UNIT) + ARR_UNIT)
        .cast("double")
    )
    # Window per customer after the per-day collapse: at most one row per calendar day.
    w = Window.partitionBy("billing_account_id").orderBy("date")
    with_end = per_day.select("billing_account_id", "date", ending.alias("ending_arr"))
    return with_end.select(
        "date",
        "billing_account_id",
        F.coalesce(F.lag("ending_arr").over(w), F.lit(0.0)).alias("starting_arr"),
        "ending_arr",
    )


def inputs_key(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the input tables: path, length and modification time of every file, from
    the tables' own file system and folded into one number (the order doesn't matter)."""
    import hashlib

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    key = 0
    for name in ("customer", "orders", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(conf)
        files = fs.listFiles(path, True) if fs.exists(path) else None
        while files is not None and files.hasNext():
            f = files.next()
            text = f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}"
            key ^= int.from_bytes(hashlib.sha1(text.encode()).digest(), "big")
    return f"{sf_dir}|{key:x}"


def largest_input(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest input table, from the footers of its files."""
    return _read(spark, sf_dir, "lineitem").count()


def testdata_sources(spark: SparkSession, sf_dir: str, materialized: bool = False) -> Sources:
    """The five sources derived from the driver's tables.

    With ``materialized=True`` each derived table is written once to the shared
    checkpoint folder and read back, so every query downstream starts from five
    source tables, as it would from the production files.
    """
    customer = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    cust = _customers_with_d0(customer, orders)
    frames = {
        "billing_accounts": billing_accounts(cust),
        "app_accounts": app_accounts(cust),
        "app_users": app_users(customer, orders, lineitem),
        "app_usage_daily": app_usage_daily(orders, lineitem),
        "arr_daily": arr_daily(orders),
    }
    if materialized:
        from ledgerline.session import materialize

        key = inputs_key(spark, sf_dir)
        frames = {name: materialize(df, f"src-{name}", key) for name, df in frames.items()}
    return Sources(**frames)
