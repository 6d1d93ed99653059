"""Helpers shared by the corpus operators: Arrow mapping, durable cuts, hot-group splitting, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that Python works on at once (one row at least).
SLICE_ROWS, SLICE_BYTES = 1024, 2_000_000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_worker_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver only has it on sys.path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def give_back() -> None:
    """Returns to the system what this process's allocators hold and do not use. Idle Python workers live on beside the
    next stage, within the memory of their executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow over slices of bounded size, so long texts never pile up in Python."""
    ensure_worker_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(SLICE_ROWS, int(SLICE_BYTES / max(1, batch.nbytes / max(1, batch.num_rows)))))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own in local mode
    only (one machine, as in tests); on a cluster that would be the driver's own disk, so it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ferrywork-ckpt-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint; lost executors lose nothing of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spooled(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table under the checkpoint folder (compact, column-pruned on rereading)."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    _SPOOLED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that spooled() wrote and nobody has deleted.
_SPOOLED: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes what spooled() wrote so far; for callers whose results are written already."""
    while _SPOOLED:
        delete(spark, _SPOOLED.pop())


def meeting_blocks(df: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Adds _bx, _by so that any two rows of one key share a (key, _bx, _by) group, and no group grows with the key.

    A key of n rows is dealt into ceil(n / block) parts by the member's hash; each part meets each other part once
    and itself in every group it is in. Keys of up to `block` rows stay in one group. Exact: no pair is left out.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64(member, F.lit(7)), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = df.join(hot, key, "left").withColumn("_own", part)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return dealt.withColumn("_other", other).withColumn("_bx", F.least("_own", "_other")).withColumn("_by", F.greatest("_own", "_other")).drop("_own", "_other", "_parts")


#: Edges of a task in components(). Up to SMALL a graph is joined up by one task; the result is the same either way.
EDGES, SMALL = 50_000, 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by the smaller root, over edges (a, b): rows (node, root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each pre-aggregated before its shuffle and
    checkpointed. A graph of at most `small` different edges (some megabytes) needs no rounds: one task joins it up.
    Nodes without an edge to another node are not listed. Raises if `rounds` do not suffice.
    """
    ensure_worker_path(edges.sparkSession)
    star = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        row = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == seen or row[0] == 0:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        if seen is None and row[0] <= small:
            return cut(star.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_joined, "node long, root long"))
        seen, parts = tuple(row), -(-row[0] // EDGES)
        star = star.coalesce(parts)
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(parts)
        large = _met(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = _met(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).unionByName(least.select("a", F.col("m").alias("b")))
        star = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of their a. The key is not the one that `least` was grouped by, so both sides are dealt for
    the join alone and Spark may split a node of many edges over tasks (adaptive skew join)."""
    key = F.col("a").bitwiseXOR(F.lit(1))
    return edges.withColumn("_x", key).join(least.select(key.alias("_x"), "m"), "_x").drop("_x")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.ChunkedArray]]:
    """The runs of two or more equal keys (the first `keys` columns, no nulls) of a sorted stream, one at a time."""
    rest: pa.Table | None = None

    def runs(table: pa.Table, last: bool):
        n = table.num_rows
        change = np.zeros(max(n - 1, 0), bool)
        for c in range(keys):
            values = table.column(c).to_numpy()
            change |= values[1:] != values[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
        if not last:
            bounds = bounds[:-1]
        for k in np.flatnonzero(np.diff(bounds) > 1):
            yield table.slice(bounds[k], bounds[k + 1] - bounds[k]).columns
        return table.slice(bounds[-1])

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            rest = yield from runs(table if rest is None else pa.concat_tables([rest, table]).combine_chunks(), False)
    if rest is not None and rest.num_rows:
        yield from runs(rest, True)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over n nodes: every connection, without every pair.

    near(node, others) says which of the others are linked to the node; it is asked only about nodes not yet reached,
    so a group that is all linked costs n comparisons.
    """
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            node = queue.pop()
            hit = near(node, left)
            new, left = left[hit], left[~hit]
            out += [(node, int(x)) for x in new]
            queue += new.tolist()
    return out


#: Bits of a sieve, as rows of 64: at most 2**18 rows whatever it was made of, so it may be broadcast.
SIEVE_BITS = 24


def sieved(df: DataFrame, column: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of df whose `column` may be among wanted[name]: all that are, and few others.

    A bitmap of fixed size over hashes (a Bloom filter with one hash), put together by the executors and joined by
    broadcast, so that rows that an exact join would drop anyway are not shuffled for it.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c, F.lit(5)), 64 - SIEVE_BITS)
    bits = wanted.select(place(name).alias("_p")).groupBy(F.shiftright("_p", 6).alias("_row")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_bits"))
    marked = df.withColumn("_p", place(column)).join(F.broadcast(bits), F.shiftright("_p", 6) == F.col("_row"))
    return marked.where("(shiftrightunsigned(_bits, cast(_p & 63 as int)) & 1L) = 1").select(*df.columns)
