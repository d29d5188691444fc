"""Aggregates, joins and windows over store-period panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import numbers as N
from ..sources import files

KEY = ["store_id", "period_start", "period_end"]


def top_sum(skus: DataFrame, ranks: int = 3) -> DataFrame:
    """The guarded amount of the first ranks of each list; later ranks don't count."""
    return skus.where(F.col("sku_rank") <= ranks).groupBy(*KEY).agg(N.guarded_sum("sku_transaction_amount", "sku_rank", ranks).alias("top3_amount"))


def with_top(panel: DataFrame, skus: DataFrame, parts: int | None = None) -> DataFrame:
    """The panel with its top-list sums, null where there is no list; parts: see dealt."""
    return dealt(panel, parts, *KEY).join(top_sum(skus), KEY, "left")


def previous(df: DataFrame, metrics: list[str], by: str = "store_id", order: str = "period_start") -> DataFrame:
    """Adds prev_<metric> of the row before, all over one window."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumns({f"prev_{m}": F.lag(m).over(w) for m in metrics})


def latest(df: DataFrame, by: str = "store_id", order: str = "period_start") -> DataFrame:
    """Adds is_latest: whether a row is its group's last."""
    return df.withColumn("is_latest", F.col(order) == F.max(order).over(Window.partitionBy(by)))


def coverage(panel: DataFrame, months: list[str], metrics: list[str]) -> DataFrame:
    """Observed months of each store, whether they are the expected ones, guarded
    averages, and attributes that all months agree on."""
    observed = panel.groupBy("store_id").agg(
        F.countDistinct("period_month").alias("n_months"), F.min("period_month").alias("first_month"), F.max("period_month").alias("last_month"),
        F.array_join(F.array_sort(F.collect_set("period_month")), "|").alias("observed_months"),
        *(N.guarded_avg(m).alias(f"avg_{m}") for m in metrics), N.unanimous("region_type").alias("region_type"),
    )
    return observed.withColumn("ready", (F.col("n_months") == len(months)) & (F.col("observed_months") == "|".join(sorted(months))))


def pivoted(panel: DataFrame, months: list[str], metrics: list[str], seen: bool = False) -> DataFrame:
    """One row for each store with <metric>_<month> for the given months; seen: and
    with how many of them there are, the first and the last."""
    month = F.col("period_month")
    found = [F.countDistinct(month).alias("observed_month_count"), F.min(month).alias("first_observed_month"), F.max(month).alias("last_observed_month")] if seen else []
    cells = [F.max(F.when(F.col("period_month") == m, F.col(c))).alias(f"{c}_{m.replace('-', '_')}") for c in metrics for m in months]
    return panel.where(F.col("period_month").isin(months)).groupBy("store_id").agg(N.unanimous("region_type").alias("region_type"), N.unanimous("store_type").alias("store_type"), *found, *cells)


def endpoints(wide: DataFrame, months: list[str], amounts: list[str], rates: list[str], counted: list[str] = ()) -> DataFrame:
    """Adds last - first of each metric, and its percentage where first > 0 (not for
    counted ones); rates get percentage points."""
    first, last = (m.replace("-", "_") for m in (months[0], months[-1]))
    cell = lambda c, m: F.col(f"{c}_{m}").cast("double")
    out = {f"{c}_delta": F.round(cell(c, last) - cell(c, first), 2) for c in [*amounts, *counted]}
    out |= {f"{c}_pct": F.when(cell(c, first) > 0, N.change_pct(cell(c, last), cell(c, first))) for c in amounts}
    out |= {f"{c}_pp": F.round(cell(c, last) - cell(c, first), 2) for c in rates}
    return wide.withColumns(out)


def all_or_nothing(df: DataFrame, batch: str, bad) -> DataFrame:
    """Adds held: whether any row of the batch is bad."""
    return df.withColumn("held", F.max(F.coalesce(bad, F.lit(False)).cast("int")).over(Window.partitionBy(batch)) == 1)


def unpivoted(wide: DataFrame, months: list[str], metrics: list[str]) -> DataFrame:
    """(store_id, period_month, metrics) from <metric>_<month> columns."""
    row = lambda m: F.struct(F.lit(m).alias("period_month"), *(F.col(f"{c}_{m.replace('-', '_')}").alias(c) for c in metrics))
    return wide.select("store_id", F.inline(F.array(*map(row, months))))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows dealt by their keys over so many tasks, which run time keeps as they are, so
    that a task's rows don't grow with the table; None leaves them to Spark."""
    return df.repartition(parts, *keys) if parts else df


def pairs(df: DataFrame, keys: list[str], order: str, block: int = 1000) -> DataFrame:
    """Pairs a, b of rows with equal keys where a's order column is the smaller. A
    group's rows are dealt in their order to blocks of so many, and a block meets itself
    and each later one in a cell of its own, so that a large group's pairs are spread over
    tasks, no two rows are compared twice, and a task holds a block. Only the places, for
    which a row is sent once, take a group's rows to one task. The cells are few bytes and
    very many pairs: they are dealt by a number of tasks of their own, as merging small
    partitions at run time would put them all into one."""
    group, last = Window.partitionBy(*keys), F.floor((F.count("*").over(Window.partitionBy(*keys)) - 1) / block)
    own = df.withColumns({"_own": F.floor((F.row_number().over(group.orderBy(order)) - 1) / block).cast("int"), "_last": last.cast("int")})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(first, to, i, j):
        cells = own.withColumn("_met", F.explode(F.sequence(first, to))).withColumns({"_i": F.col(i), "_j": F.col(j)})
        return dealt(cells.drop("_own", "_last", "_met"), parts, *keys, "_i", "_j")

    a, b = side(F.col("_own"), F.col("_last"), "_own", "_met").alias("a"), side(F.lit(0), F.col("_own"), "_met", "_own").alias("b")
    return a.join(b, [*keys, "_i", "_j"]).where(F.col(f"a.{order}") < F.col(f"b.{order}"))


def placed(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in the order of all rows. Ranges of the order are
    sorted apart and stored with their rows' numbers; a range's rows follow those of the
    ranges before it, of which only the counts are summed in one place. Rows with equal
    order columns get places next to each other."""
    number = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(number, 33), "_number": number.bitwiseAND(F.lit((1 << 33) - 1))})
    path = files.fresh_path(df.sparkSession, "ranges")
    ranged.write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n") + 1).alias("_before"))
    return ranged.join(before, "_range").withColumn(name, F.col("_before") + F.col("_number")).drop("_range", "_number", "_before")
