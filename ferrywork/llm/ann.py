"""Approximate nearest neighbours: anisotropic four-bit product quantisation, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrywork.llm.common import cut, ensure_worker_path, groups, map_batches

#: Numbers of the sample that the index is fitted on (vectors times dimensions), and vectors that meet in one group.
SAMPLE_NUMBERS, VECTORS, QUERIES = 1_500_000, 8192, 1024
#: Partitions at most; dimensions of a subspace (16 centres each); candidates a group reranks exactly for a query.
PARTITIONS, SUB, RERANK = 4096, 2, 100
#: Inner products from this cosine up shall be kept: residuals along the vector weigh more than those across it.
THRESHOLD = 0.2
#: Standard errors of a scan's estimate within which a vector is still reranked: none is cut off by a count.
MARGIN = 2.5
#: Share of the sample's true neighbours that the probed partitions must hold.
PROBE_RECALL = 0.98


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    for k in range(0, len(x), 4096):
        far = (centres**2).sum(1) - 2 * x[k : k + 4096] @ centres.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(axis=1)[:, None])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=c, minlength=k) for c in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


class Index:
    """Partitions by nearest centroid; residuals in SUB-dimensional parts of 16 centres each, by score-aware loss.

    Nearness is an inner product: |q - x|^2 is smallest where <q, x> - |x|^2 / 2 is largest. So the error that counts is <q, e> of the residual's error e, largest for queries along x: the loss
    |e|^2 + (eta - 1) <x / |x|, e>^2 with eta = (d - 1) t^2 / (1 - t^2) penalises its parallel part.
    """

    def __init__(self, sample: np.ndarray, partitions: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        x = self.pad(sample)
        self.weight = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) - 1
        self.centroids = kmeans(x, partitions, rng)
        residual = x - self.centroids[nearest(x, self.centroids)[:, 0]]
        parts = residual.reshape(len(x), -1, SUB)
        self.books = np.stack([kmeans(parts[:, m], 16, rng) for m in range(parts.shape[1])])
        for _ in range(3):
            self._refit(x, parts, self.codes(x, residual))

    def pad(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))

    @staticmethod
    def _along(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).reshape(len(x), -1, SUB)

    def codes(self, x: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Centres of each part: coordinate descent on the loss, from the nearest ones."""
        parts, along = residual.reshape(len(x), -1, SUB), self._along(x)
        out = np.stack([nearest(parts[:, m], self.books[m])[:, 0] for m in range(parts.shape[1])], axis=1)
        error = parts - self.books[np.arange(parts.shape[1]), out]
        parallel = (along * error).sum(axis=2)
        total = parallel.sum(axis=1)
        for _ in range(2):
            for m in range(parts.shape[1]):
                e = parts[:, m, None, :] - self.books[m][None]
                p = (e * along[:, m, None, :]).sum(axis=2)
                best = ((e**2).sum(axis=2) + self.weight * (total[:, None] - parallel[:, m, None] + p) ** 2).argmin(axis=1)
                out[:, m] = best
                new = p[np.arange(len(x)), best]
                total += new - parallel[:, m]
                parallel[:, m] = new
        return out.astype(np.uint8)

    def _refit(self, x: np.ndarray, parts: np.ndarray, codes: np.ndarray) -> None:
        """The centres that make the loss least for the codes, part by part."""
        along = self._along(x)
        for m in range(parts.shape[1]):
            error = parts - self.books[np.arange(parts.shape[1]), codes]
            rest = (along * error).sum(axis=(1, 2)) - (along[:, m] * error[:, m]).sum(axis=1)
            metric = np.eye(SUB) + self.weight * along[:, m, :, None] * along[:, m, None, :]
            aim = (metric @ parts[:, m, :, None])[:, :, 0] + self.weight * rest[:, None] * along[:, m]
            for c in range(16):
                own = codes[:, m] == c
                if own.any():
                    self.books[m, c] = np.linalg.solve(metric[own].sum(axis=0), aim[own].sum(axis=0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Partition, packed codes (two to a byte), half of |x|^2 - 2 <x, e> and |e| of vectors as they are in the table.

        With the second, <q, x - e> less it is off by <q - x, e> only: little for near queries."""
        x = self.pad(x)
        own = nearest(x, self.centroids)[:, 0]
        codes = self.codes(x, x - self.centroids[own])
        e = x - self.centroids[own] - self.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return own, codes[:, ::2] | codes[:, 1::2] << 4, (x**2).sum(axis=1) / 2 - (x * e).sum(axis=1), np.linalg.norm(e, axis=1)

    def scan(self, queries: np.ndarray, partition: int, packed: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Estimates -|q - x|^2 / 2 + |q|^2 / 2 of all pairs: a table of 16 inner products a part, looked up by code."""
        q = self.pad(queries)
        tables = np.einsum("qms,mcs->qmc", q.reshape(len(q), -1, SUB), self.books)
        out = (q @ self.centroids[partition])[:, None] - bias[None]
        for m in range(tables.shape[1]):
            out += tables[:, m, packed[:, m // 2] >> (4 * (m % 2)) & 15]
        return out


def _fit(rows: DataFrame, n: int, dims: int) -> tuple[Index, int]:
    """The index and how many partitions a query probes, from a sample in the order of a hash."""
    size = max(1000, SAMPLE_NUMBERS // dims)
    found = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(size).select("vector").toArrow()["vector"]
    sample = np.frombuffer(b"".join(found.to_pylist()), np.float64).reshape(-1, dims)
    partitions = int(np.clip(min(np.sqrt(n), len(sample) / 32), 1, PARTITIONS))
    index = Index(sample, partitions)
    x, probe = index.pad(sample), index.pad(sample[:: max(1, len(sample) // 200)])
    true = nearest(probe, x, 11)[:, 1:]
    rank = np.argsort(nearest(probe, index.centroids, partitions) if partitions > 1 else np.zeros((len(probe), 1), int), axis=1)
    place = np.take_along_axis(rank, nearest(x, index.centroids)[:, 0][true], axis=1)
    return index, int(min(partitions, np.quantile(place, PROBE_RECALL, method="higher") + 1)) if place.size else partitions


def search(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query (rows whose key is divisible by `every`): query_id, rank, vec_id, score of its k nearest, by Euclidean
    distance on the original vectors in double precision; ties go to the smaller vec_id, fewer rows if there are fewer.

    Null vectors or keys, zero vectors and such with null or non-finite components take no part, nor do vectors of
    another length than the most frequent one. Rows that repeat a key are one vector (the smallest array). Empty tables
    give no rows. Each partition is dealt into groups of at most about VECTORS vectors and QUERIES queries, however many
    it holds; each group scans all its codes for each query and reranks exactly the RERANK best and every other
    vector whose estimate less MARGIN standard errors is within the k-th of them. The index is fitted on
    a bounded sample and its size is bounded; every vector is in it.
    """
    spark = vectors.sparkSession
    ensure_worker_path(spark)
    given = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, n = lengths[0]["dims"], lengths[0]["n"]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dims)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vector"])

    rows = cut(map_batches(given.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v")), pack, "id long, vector binary"))
    fitted, probes = _fit(rows, n, dims)
    shared = spark.sparkContext.broadcast(fitted)  # at most PARTITIONS centroids

    def unpack(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, packed, bias, err = shared.value.encode(unpack(batch.column(1)))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(bias), pa.array(err)], ["part", "id", "vector", "codes", "bias", "err"])

    def ask(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = nearest(shared.value.pad(unpack(batch.column(1))), shared.value.centroids, probes)
        at = np.repeat(np.arange(batch.num_rows), near.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(c.take(pa.array(at)) for c in batch.columns)], ["part", "id", "vector"])

    placed = map_batches(rows, place, "part int, id long, vector binary, codes binary, bias double, err double")
    asked = map_batches(rows.where(F.pmod("id", F.lit(every)) == 0), ask, "part int, id long, vector binary")
    count = lambda df, block, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    blocks = cut(count(placed, VECTORS, "nv").join(count(asked, QUERIES, "nq"), "part"))  # one row a partition
    mine = lambda name: F.pmod(F.xxhash64("id", F.lit(9)), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = placed.join(blocks, "part").withColumn("bv", mine("nv")).withColumn("bq", each("nq")).withColumn("kind", F.lit(0))
    right = asked.join(blocks, "part").withColumn("bq", mine("nq")).withColumn("bv", each("nv")).withColumn("kind", F.lit(1)).withColumns({"codes": F.lit(None).cast("binary"), "bias": F.lit(0.0), "err": F.lit(0.0)})
    names = ["part", "bv", "bq", "kind", "id", "vector", "codes", "bias", "err"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part, _, _, kind, ids, vector, codes, bias, err in groups(batches, 3):
            kind, ids, x = kind.to_numpy(), ids.to_numpy(), unpack(vector)
            own, asking = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(own) or not len(asking):
                continue
            packed = np.frombuffer(b"".join(codes.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
            bias, err = (c.take(pa.array(own)).to_numpy() for c in (bias, err))
            out: list[list] = [[], [], []]
            for at in range(0, len(asking), 64):
                q = asking[at : at + 64]
                scores = index.scan(x[q], part[0].as_py(), packed, bias)
                scores[ids[q][:, None] == ids[own][None]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :RERANK]
                for row in range(len(q)):
                    first = np.sort(((x[own[best[row]]] - x[q[row]]) ** 2).sum(axis=1)[scores[row, best[row]] > -np.inf])
                    reach = first[min(k, len(first)) - 1] if len(first) else 0.0
                    others = np.flatnonzero(scores[row] > -np.inf)
                    about = np.maximum(((x[q[row]] - index.mean) ** 2).sum() - 2 * scores[row, others], 0)
                    some = others[about - MARGIN * 2 * np.sqrt(about / dims) * err[others] <= reach]
                    some = np.union1d(some, best[row][scores[row, best[row]] > -np.inf])
                    exact = np.sqrt(((x[own[some]] - x[q[row]]) ** 2).sum(axis=1))
                    order = np.lexsort((ids[own[some]], exact))[:k]
                    out[0].append(np.full(len(order), ids[q[row]]))
                    out[1].append(ids[own[some[order]]])
                    out[2].append(exact[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    met = left.select(*names).unionByName(right.select(*names)).repartition("part", "bv", "bq").sortWithinPartitions("part", "bv", "bq", "kind", "id")
    found = met.mapInArrow(match, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
