"""Continuous copying: keyed upserts of a stream into a Parquet table, and deduplication with bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrywork.operators.writing import keep_last, merge
from ferrywork.sources.registry import _fs, exists, switch

#: Parts that a table's keys are dealt into by their hash; a micro-batch rewrites those that it touches.
BUCKETS = 64


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(BUCKETS)).cast("int")


def _buckets(spark: SparkSession, path: str) -> list[int]:
    """Parts of a table at the path, after setting right what a run that broke off between two renames has left."""
    fs, at = _fs(spark, path)
    names = lambda p: {f.getPath().getName() for f in fs.listStatus(at(p))} if fs.exists(at(p)) else set()
    found = names(path)
    for lost in names(f"{path}.old") - found:
        if lost.startswith("_bucket="):
            fs.rename(at(f"{path}.old/{lost}"), at(f"{path}/{lost}"))
            found.add(lost)
    return sorted(int(n.removeprefix("_bucket=")) for n in found if n.startswith("_bucket="))


def dealt(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Deals a table that lies at the path into parts, once."""
    if exists(spark, path) and not _buckets(spark, path):
        rows = spark.read.parquet(path).withColumn("_bucket", _bucket(keys))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.new")
        switch(spark, path)


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[Column], strategy: str = "overwrite") -> None:
    """Merges rows into a table that is kept in parts: only the parts whose keys the rows have are read and rewritten,
    each put in place by itself. Merging rows twice changes nothing, so a run that broke off is simply run again."""
    spark = batch.sparkSession
    dealt(spark, path, keys)
    last = keep_last(batch, keys, order).withColumn("_bucket", _bucket(keys)).persist()
    try:
        touched = sorted(r[0] for r in last.select("_bucket").distinct().collect())  # BUCKETS numbers at most
        there = set(_buckets(spark, path))
        rows = last.drop("_bucket")
        if there & set(touched):
            old = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
            rows = merge(old, rows, keys, strategy)
        rows.withColumn("_bucket", _bucket(keys)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.stage")
        fs, at = _fs(spark, path)
        fs.mkdirs(at(path))
        fs.mkdirs(at(f"{path}.old"))
        for n in touched:
            part = f"_bucket={n}"
            fs.delete(at(f"{path}.old/{part}"), True)
            if n in there:
                fs.rename(at(f"{path}/{part}"), at(f"{path}.old/{part}"))
            fs.rename(at(f"{path}.stage/{part}"), at(f"{path}/{part}"))
            fs.delete(at(f"{path}.old/{part}"), True)
    finally:
        last.unpersist()


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str, strategy: str = "overwrite") -> StreamingQuery:
    """Each micro-batch is reduced to the last row of a key and merged into the parts of the table that it touches; a table
    that lies at the path undivided is dealt into parts first. A batch that is run again after a failure does no harm.
    Stopping the query pauses the copy between two batches; starting it again goes on."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert(batch, path, keys, order, strategy)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Drops repeated keys; the state holds the keys of the watermark's span only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
