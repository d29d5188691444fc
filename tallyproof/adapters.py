"""The supplied star-schema tables in the roles of periodic store metrics.

A store is a supplier, a reporting window a month of shipping, an SKU a part. The
expressions are plain SQL that Spark and DuckDB read alike, so that the SQL twin of
a query starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

AMOUNT = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"
COST = "CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))"
KEY = ["store_id", "period_start", "period_end"]
TEXT = ["region_type", "store_type"]
COUNTS = {
    "transaction_orders": "count(DISTINCT l_orderkey)",
    "exposure_users": "sum(l_quantity) * 10",
    "exposure_times": "sum(l_quantity) * 13",
    "entry_users": "CASE WHEN max(l_suppkey + m) % 13 <> 0 THEN sum(l_quantity) * 4 END",
    "order_users": "count(DISTINCT l_orderkey) * 2",
    "payment_users": "count(DISTINCT l_orderkey)",
    "search_exposure_users": "CASE WHEN max(l_suppkey) % 17 <> 0 THEN sum(CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END) * 7 END",
    "search_entry_users": "sum(CASE WHEN l_linenumber <= 2 THEN l_quantity ELSE 0 END) * 3",
    "activity_orders": "count(DISTINCT CASE WHEN l_discount >= 0.05 THEN l_orderkey END)",
    "refund_orders": "count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)",
    "store_average_rank": "max(l_linenumber)",
    "search_average_rank": "min(l_partkey % 50) + 1",
    "entry_times": "sum(l_quantity) * 5",
    "order_times": "count(*) * 2",
    "merchant_list_exposure_users": "sum(CASE WHEN l_linenumber >= 4 THEN l_quantity ELSE 0 END) * 2",
    "merchant_list_average_rank": "CASE WHEN max(l_suppkey) % 7 <> 0 THEN max(l_partkey % 20) + 1 END",
    "merchant_list_entry_users": "sum(CASE WHEN l_linenumber >= 5 THEN l_quantity ELSE 0 END)",
    "full_refund_orders": "count(DISTINCT CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_orderkey END)",
    "business_district_rank": "max((l_suppkey + m) % 20) + 1",
}
SUMS = {
    "transaction_amount": f"sum({AMOUNT})",
    "estimated_income_proxy": "sum(CAST(l_extendedprice * (1 - l_discount) * (1 - l_tax) AS DECIMAL(18, 6)))",
    "activity_original_transaction_amount": "sum(CASE WHEN l_discount >= 0.05 THEN CAST(l_extendedprice AS DECIMAL(18, 4)) END)",
    "activity_cost": f"sum({COST})",
    "merchant_subsidy_amount": "sum(CAST(l_extendedprice * l_discount * 0.6 AS DECIMAL(18, 6)))",
    "order_amount": "sum(CAST(l_extendedprice AS DECIMAL(18, 4)))",
    "payment_amount": f"sum(CASE WHEN l_returnflag <> 'R' THEN {AMOUNT} END)",
    "platform_subsidy_amount": "sum(CAST(l_extendedprice * l_discount * 0.4 AS DECIMAL(18, 6)))",
    "refund_amount": f"sum(CASE WHEN l_returnflag = 'R' THEN {AMOUNT} END)",
}
#: The same counts in three steps: what an order has in a store's month, what a share of the
#: month's lines has of its orders, and what the month has of its shares. Plain sums, so
#: that no row is expanded for its distinct counts.
PER_ORDER = {
    "q": "sum(l_quantity)",
    **{f"q_to_{n}": f"sum(CASE WHEN l_linenumber <= {n} THEN l_quantity ELSE 0 END)" for n in (2, 3)},
    **{f"q_from_{n}": f"sum(CASE WHEN l_linenumber >= {n} THEN l_quantity ELSE 0 END)" for n in (4, 5)},
    "lines": "count(*)",
    "last_line": "max(l_linenumber)",
    "least_50": "min(l_partkey % 50)",
    "most_20": "max(l_partkey % 20)",
    "active": "max(l_discount >= 0.05)",
    "refunded": "max(l_returnflag = 'R')",
    "fully_refunded": "max(l_returnflag = 'R' AND l_linenumber = 1)",
}
PER_SHARE = {
    "orders": "count(l_orderkey)",
    **{n: f"sum({n})" for n in ("q", "q_to_2", "q_to_3", "q_from_4", "q_from_5", "lines")},
    **{n: f"max({n})" for n in ("last_line", "most_20")},
    "least_50": "min(least_50)",
    **{n: f"count(CASE WHEN {n} THEN l_orderkey END)" for n in ("active", "refunded", "fully_refunded")},
}
PER_MONTH = {
    "transaction_orders": "sum(orders)",
    "exposure_users": "sum(q) * 10",
    "exposure_times": "sum(q) * 13",
    "entry_users": "CASE WHEN max(suppkey + m) % 13 <> 0 THEN sum(q) * 4 END",
    "order_users": "sum(orders) * 2",
    "payment_users": "sum(orders)",
    "search_exposure_users": "CASE WHEN max(suppkey) % 17 <> 0 THEN sum(q_to_3) * 7 END",
    "search_entry_users": "sum(q_to_2) * 3",
    "activity_orders": "sum(active)",
    "refund_orders": "sum(refunded)",
    "store_average_rank": "max(last_line)",
    "search_average_rank": "min(least_50) + 1",
    "entry_times": "sum(q) * 5",
    "order_times": "sum(lines) * 2",
    "merchant_list_exposure_users": "sum(q_from_4) * 2",
    "merchant_list_average_rank": "CASE WHEN max(suppkey) % 7 <> 0 THEN max(most_20) + 1 END",
    "merchant_list_entry_users": "sum(q_from_5)",
    "full_refund_orders": "sum(fully_refunded)",
    "business_district_rank": "max((suppkey + m) % 20) + 1",
}
# 1e-9: so that engines agree on amounts half-way between two cents
RATES = {
    "average_order_value": "round(transaction_amount / nullif(transaction_orders, 0) + 1e-9, 2)",
    "entry_conversion_rate_pct": "round(entry_users * 100.0e0 / nullif(exposure_users, 0), 2)",
    "order_conversion_rate_pct": "round(order_users * 100.0e0 / nullif(entry_users, 0), 2)",
    "payment_conversion_rate_pct": "round(payment_users * 100.0e0 / nullif(order_users, 0), 2)",
    "activity_cost_ratio_pct": "round(activity_cost * 100.0e0 / nullif(activity_original_transaction_amount, 0), 2)",
}
METRICS = [*COUNTS, *SUMS, *RATES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(suppkey, store_id, region_type, store_type)"""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("suppkey"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("store_id"),
        F.col("r_name").alias("region_type"), F.when(F.col("s_acctbal") >= 0, "direct").otherwise("partner").alias("store_type"),
    )


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("period_start", F.trunc(F.to_date("l_shipdate"), "MM"))


#: Lines that a task holds about, so that its memory doesn't grow with the table.
LINES = 200_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which the lines are dealt: as many as they need, and no fewer than
    other shuffles have. A number of its own is kept as it is at run time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES))


def _dealt(spark: SparkSession, sf_dir: str, n: int, by: str) -> DataFrame:
    """Lines of each store in one of n tasks, so that sums of its months need no further
    exchange of lines; those of a store with more than LINES in as many shares as they
    need, by another column. Few stores are so large: at most one for LINES of all lines."""
    shares = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.ceil(F.count("*") / LINES).alias("_shares")).where(F.col("_shares") > 1)
    share = F.coalesce(F.pmod(F.xxhash64(by), F.col("_shares")), F.lit(0)).cast("int")
    lines = _monthly(spark, sf_dir).join(F.broadcast(shares), "l_suppkey", "left").withColumn("_share", share).drop("_shares")
    return lines.repartition(n, "l_suppkey", "_share")


def store_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each store and month: keys, store attributes and metrics. The rows of a
    store are in one task."""
    n, month = tasks(spark, sf_dir), ["suppkey", "period_start", "_share"]
    # an order has few lines in a month: the rows are narrower than what a map-side sum would send
    lines = _dealt(spark, sf_dir, n, "l_orderkey").withColumnRenamed("l_suppkey", "suppkey")
    orders = lines.groupBy(*month, "l_orderkey").agg(*(F.expr(e).alias(c) for c, e in {**PER_ORDER, **SUMS}.items()))
    shares = orders.groupBy(*month).agg(*(F.expr(e).alias(c) for c, e in PER_SHARE.items()), *(F.sum(c).alias(c) for c in SUMS))
    named = shares.withColumn("store_id", F.concat(F.lit("S"), F.col("suppkey").cast("string"))).repartition(n, "store_id").withColumn("m", F.expr("month(period_start) + 12 * year(period_start)"))
    sums = named.groupBy("store_id", "suppkey", "period_start").agg(
        *(F.expr(f"CAST({e} AS BIGINT)").alias(c) for c, e in PER_MONTH.items()), *(F.expr(f"CAST(sum({c}) AS DOUBLE)").alias(c) for c in SUMS)
    )
    out = sums.join(stores(spark, sf_dir).drop("suppkey"), "store_id").withColumns({"period_end": F.last_day("period_start"), "period_month": F.date_format("period_start", "yyyy-MM")})
    return out.select(*KEY, "period_month", *TEXT, *COUNTS, *SUMS, *(F.expr(e).alias(c) for c, e in RATES.items()))


def sku_period(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """The best parts by amount of each store and month, dealt by their key. Some amounts
    are missing."""
    month, n = ["l_suppkey", "period_start"], tasks(spark, sf_dir)
    # nearly every line is a part of its own in a month: summing before the exchange would only fill memory
    lines = _dealt(spark, sf_dir, n, "l_partkey")
    sold = lines.groupBy(*month, "_share", "l_partkey").agg(F.expr(f"sum({AMOUNT})").alias("amount"), F.expr("CAST(sum(l_quantity) AS BIGINT)").alias("sales_volume"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("amount"), "l_partkey"))
    first = sold.withColumn("sku_rank", rank(*month, "_share")).where(F.col("sku_rank") <= top).drop("_share", "sku_rank")
    named = first.withColumns({"store_id": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "period_end": F.last_day("period_start")})
    best = named.repartition(n, *KEY).withColumn("sku_rank", rank(*KEY)).where(F.col("sku_rank") <= top)
    return best.select(
        *KEY, "sku_rank",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku_name"), F.when(F.col("l_partkey") % 11 != 0, F.col("amount").cast("double")).alias("sku_transaction_amount"), "sales_volume",
    )


#: The same rows in DuckDB, as common table expressions sp and sku.
SP = f"""lm AS (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, month(l_shipdate) + 12 * year(l_shipdate) AS m FROM lineitem),
st AS (SELECT s_suppkey AS suppkey, 'S' || s_suppkey AS store_id, r_name AS region_type, CASE WHEN s_acctbal >= 0 THEN 'direct' ELSE 'partner' END AS store_type FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sm AS (SELECT l_suppkey AS suppkey, period_start, {", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in COUNTS.items())}, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in SUMS.items())} FROM lm GROUP BY l_suppkey, period_start),
sp AS (SELECT store_id, period_start, last_day(period_start) AS period_end, strftime(period_start, '%Y-%m') AS period_month, region_type, store_type, {", ".join([*COUNTS, *SUMS])}, {", ".join(f"{e} AS {n}" for n, e in RATES.items())} FROM sm JOIN st USING (suppkey))"""
SKU = f"""sk AS (SELECT l_suppkey, period_start, l_partkey, sum({AMOUNT}) AS amount, CAST(sum(l_quantity) AS BIGINT) AS sales_volume FROM lm GROUP BY ALL),
sku AS (SELECT 'S' || l_suppkey AS store_id, period_start, last_day(period_start) AS period_end, CAST(sku_rank AS INT) AS sku_rank, 'P' || l_partkey AS sku_name, CASE WHEN l_partkey % 11 <> 0 THEN CAST(amount AS DOUBLE) END AS sku_transaction_amount, sales_volume
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, period_start ORDER BY amount DESC, l_partkey) AS sku_rank FROM sk) WHERE sku_rank <= 5)"""
