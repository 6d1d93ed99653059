"""Conflict strategies, deduplication, batches and resumption."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(target: DataFrame, incoming: DataFrame, keys: list[str], strategy: str = "overwrite", order: list[Column] | None = None) -> DataFrame:
    """The target after writing: one row a key; columns are united, missing ones null.

    overwrite: incoming rows set the columns that they have, a target's other columns stay; skip: they only fill keys
    that are missing; error: a key that exists raises when the result is read. Of incoming rows that repeat a key the
    last in `order` counts (without an order, one of them). One keyed join, whichever side is larger; no row is looked up
    one by one. Null keys equal each other.
    """
    if strategy not in ("overwrite", "skip", "error"):
        raise ValueError(f"unknown strategy {strategy}")
    last = keep_last(incoming, keys, order or [F.lit(0)])
    names = [*target.columns, *(c for c in incoming.columns if c not in target.columns)]
    a = target.select(F.struct(*target.columns).alias("_a"), *(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)))
    b = last.select(F.struct(*last.columns).alias("_b"), *(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)))
    on = reduce(Column.__and__, (F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))))
    old, new = F.col("_a").isNotNull(), F.col("_b").isNotNull()

    def value(name: str) -> Column:
        mine, theirs = (F.col(f"{side}.{name}") if name in df.columns else None for side, df in (("_a", target), ("_b", last)))
        if mine is None or theirs is None:
            return (theirs if mine is None else mine).alias(name) if strategy == "overwrite" or theirs is None else F.when(~old, theirs).alias(name)
        return (F.when(new, theirs).otherwise(mine) if strategy == "overwrite" else F.when(old, mine).otherwise(theirs)).alias(name)

    both = a.join(b, on, "full_outer")
    if strategy == "error":
        both = both.where(F.when(old & new, F.raise_error(F.lit("a key exists already"))).otherwise(True))
    return both.select(*(value(n) for n in names))


def conflicts(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.join(target.select(*keys).distinct(), keys, "left_semi")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key. An aggregation (the row with the largest order), so hot keys are combined before the
    shuffle; columns of any type may stand beside the order."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)))).alias("_best"))
    return best.select("_best.*").select(*df.columns)


def unwritten(df: DataFrame, written: DataFrame, key: str) -> DataFrame:
    return df.join(written.select(key).distinct(), key, "left_anti")


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder of spark.checkpoint.dir. A folder of our own where that is unset, in local
    mode only: on a cluster it would be the driver's own disk."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ferrywork-"))
    return df.checkpoint(eager=True)


def numbered_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """A `batch` number for runs of `size` rows in order.

    Row numbers come from range partitions and the counts of those before, so no task sorts the whole table. The ranges
    are sampled anew whenever they are planned, so the numbered rows are kept before their counts are taken.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    within = durable(placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    counts = within.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return within.join(before, "_p").withColumn("batch", F.floor((F.col("_i") + F.col("_before") - 1) / size).cast("bigint")).drop("_p", "_i", "_n", "_before")


def byte_batches(sizes: list[int], budget: int) -> list[int]:
    """Batch numbers of units in order: greedy, a unit above the budget alone. Within one scan batch, so it is short."""
    out, batch, held = [], 0, 0
    for size in sizes:
        if held and held + size > budget:
            batch, held = batch + 1, 0
        out.append(batch)
        held += size
    return out


def split_by_bytes(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """byte_batches() within each scan batch `group`: rows are dealt by it, sorted and numbered as they stream by, so no
    list of a group is held. Columns: group, order, batch."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, held = object(), 0, 0
        for rows in batches:
            out = []
            for g, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if g != now:
                    now, batch, held = g, 0, 0
                if held and held + n > budget:
                    batch, held = batch + 1, 0
                out.append(batch)
                held += n
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int32())], [group, order, "batch"])

    dealt = df.select(group, order, F.col(size).cast("bigint").alias(size)).repartition(F.col(group)).sortWithinPartitions(group, order)
    return dealt.mapInArrow(number, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, batch int")


def rows_per_statement(widest: int, columns: int, packet: int = 16 << 20, most: int = 10_000, parameters: int = 0) -> int:
    """Rows of one INSERT: what fits into a packet if rows are a fifth wider than the widest seen, `most` at most, and
    within the number of parameters that a server takes (0: any)."""
    rows = max(1, min(most, packet // max(1, int(widest * 1.2))))
    return max(1, min(rows, parameters // max(1, columns))) if parameters else rows


def widest_row(df: DataFrame, sample: int = 10) -> int:
    """Characters of the widest of the first rows, as JSON."""
    return df.limit(sample).agg(F.max(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
