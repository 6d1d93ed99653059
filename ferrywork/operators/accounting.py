"""Accounting of a copy: metrics by table, outcomes of batches, failures, throughput and caps of lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_metrics(units: DataFrame) -> DataFrame:
    """Per table of units (table, size, status: written, failed or skipped, batch): scanned, written, failed, skipped,
    bytes (of what was written) and batches."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    size = F.sum(F.when(F.col("status") == "written", F.col("size")).otherwise(0)).cast("bigint").alias("bytes")
    return units.groupBy("table").agg(F.count(F.lit(1)).alias("scanned"), n("written"), n("failed"), n("skipped"), size, F.count_distinct("batch").alias("batches"))


def proportional(tables: DataFrame, failed: Column, skipped: Column, size: Column) -> DataFrame:
    """A batch's failed and skipped units and bytes dealt to its tables (table, scanned) by their share, cut to whole
    numbers, where no unit is named. One row a table; the total is a window over them."""
    from pyspark.sql.window import Window

    share = F.col("scanned") / F.sum("scanned").over(Window.partitionBy())
    cut = lambda c: F.floor(c * share).cast("bigint")
    return tables.withColumns({"failed": cut(failed), "skipped": cut(skipped), "bytes": cut(size)}).withColumn("written", F.col("scanned") - F.col("failed") - F.col("skipped"))


def outcomes(units: DataFrame, failed: DataFrame | None, skipped: DataFrame | None, key: str = "key") -> DataFrame:
    """Units with their status: failed and skipped keys as named, all others written. Keys are joined, never collected."""
    rows = units.withColumn("status", F.lit("written"))
    for name, keys in (("skipped", skipped), ("failed", failed)):
        if keys is not None:
            mark = keys.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
            rows = rows.join(mark, F.col(key) == F.col("_key"), "left").withColumn("status", F.when(F.col("_hit"), name).otherwise(F.col("status"))).drop("_key", "_hit")
    return rows


def units_by_keys(units: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The units of the given keys: what is tried again."""
    return units.join(keys.select(key).distinct(), key, "left_semi")


def failure_summary(errors: DataFrame) -> DataFrame:
    """Per category: how many errors and the first message by position (category, position, message)."""
    return errors.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min_by("message", "position").alias("example"))


def busiest_table(metrics: DataFrame) -> DataFrame:
    """The table with most scanned units; ties go to the first name."""
    return metrics.agg(F.min_by("table", F.struct((-F.col("scanned")).alias("n"), F.col("table"))).alias("table"))


def scanned_tables(units: DataFrame) -> DataFrame:
    """Different tables in the order in which they were first scanned (table, position)."""
    return units.groupBy("table").agg(F.min("position").alias("position"))


def index_columns(catalog: DataFrame) -> DataFrame:
    """Per index its columns in the order of their position (table, index, position, column)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"])
    return catalog.groupBy("table", "index").agg(ordered.alias("columns"))


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group for a report; how many there are is counted whole beside them (n)."""
    from pyspark.sql.window import Window

    each = Window.partitionBy(group)
    return rows.withColumns({"n": F.count(F.lit(1)).over(each), "_i": F.row_number().over(each.orderBy(*order))}).where(F.col("_i") <= most).drop("_i")


def newest_first(runs: DataFrame, most: int = 0) -> DataFrame:
    """Runs (id, started) from the last one back; all of them, or `most`."""
    rows = runs.orderBy(F.desc("started"), "id")
    return rows.limit(most) if most else rows


@dataclass
class Progress:
    """Totals so far. throughput() is rows a second; remaining() whole seconds at that rate, 0 if unknown."""

    scanned: int = 0
    written: int = 0
    failed: int = 0
    skipped: int = 0
    bytes: int = 0
    batches: int = 0
    seconds: float = 0.0
    peak: float = 0.0

    def add(self, scanned: int, written: int, failed: int = 0, skipped: int = 0, size: int = 0, seconds: float = 0.0) -> None:
        self.scanned += scanned
        self.written += written
        self.failed += failed
        self.skipped += skipped
        self.bytes += size
        self.batches += 1
        self.seconds += seconds
        self.peak = max(self.peak, self.throughput())

    def throughput(self) -> float:
        return self.written / self.seconds if self.seconds > 0 else 0.0

    def remaining(self) -> int:
        rate = self.throughput()
        return int((self.scanned - self.written) / rate) if rate > 0 and self.scanned > self.written else 0


def throughput(batches: DataFrame) -> DataFrame:
    """average and peak rows a second, seconds that remain, of batches (position, scanned, written, seconds).

    The peak is the largest average up to any batch. Running sums over one row a batch.
    """
    from pyspark.sql.window import Window

    run = Window.orderBy("position")
    sofar = batches.select(F.sum("written").over(run).alias("w"), F.sum("seconds").over(run).alias("s"), "scanned", "written", "seconds")
    total = sofar.agg(F.sum("written").alias("w"), F.sum("scanned").alias("n"), F.sum("seconds").alias("s"), F.max(F.when(F.col("s") > 0, F.col("w") / F.col("s"))).alias("peak"))
    average = F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(0.0)
    return total.select(average.alias("average"), F.coalesce("peak", F.lit(0.0)).alias("peak"), F.when((average > 0) & (F.col("n") > F.col("w")), F.floor((F.col("n") - F.col("w")) / average)).otherwise(0).cast("bigint").alias("remaining"))
