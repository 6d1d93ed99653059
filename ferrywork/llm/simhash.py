"""SimHash near-duplicates: pigeonring filtering of candidates, full Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.common import components, cut, ensure_worker_path, forest, groups, map_batches, meeting_blocks

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Offset and width of the ring's segments: one more than the distance, so that some segment is equal.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of one key that meet in one group; more are dealt into blocks that meet pair by pair.
BLOCK = 1024

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles (repeats counted)."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        data, m = xxhash.xxh64_digest(line, SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        m = n - SHINGLE + 1
        data = b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, map(slice, starts[:m].tolist(), ends[SHINGLE - 1 :].tolist())), repeat(SEED)))
    by_byte = np.frombuffer(data, np.uint8).reshape(m, 8)  # the most significant byte first
    out = 0
    for k in range(8):
        counts = np.bincount(by_byte[:, k], minlength=256) @ _BITS
        out = out << 8 | int(np.packbits(counts * 2 > m, bitorder="little")[0])
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long). A null text has no words: fingerprint zero."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return map_batches(rows, one, "doc_id long, fp long")


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k % len(SEGMENTS)]
    return (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)


def chain_keys(fp: np.ndarray) -> list[np.ndarray]:
    """Keys under which a pair within DISTANCE surely meets.

    Some ring start has a chain whose first l segments differ in at most floor(l * 4 / 5) bits for every l: an equal
    segment, then one with a bit of difference at most. So each start gives the key of both segments as they are, and
    one for each zero of the second set to one: of two values a bit apart, one becomes the other that way.
    """
    out = []
    for k in range(len(SEGMENTS)):
        width = SEGMENTS[(k + 1) % len(SEGMENTS)][1]
        base = (np.uint64(k) << np.uint64(26)) | (_segment(fp, k) << np.uint64(13))
        second = _segment(fp, k + 1)
        out.append((np.arange(len(fp)), base | second))
        for b in range(width):
            zero = np.flatnonzero((second >> np.uint64(b)) & np.uint64(1) == 0)
            out.append((zero, base[zero] | second[zero] | np.uint64(1 << b)))
    return out


def linked(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of the others pass the chain from `start` and then the full check against one."""
    differ = others ^ one
    so_far, passed = np.zeros(len(others), np.uint8), np.ones(len(others), bool)
    for length in range(1, len(SEGMENTS)):
        so_far += np.bitwise_count(_segment(differ, start + length - 1))
        passed &= so_far <= DISTANCE * length // len(SEGMENTS)
    passed[passed] = np.bitwise_count(differ[passed]) <= DISTANCE
    return passed


def links(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between reps (id, fp; both distinct) that connect all within DISTANCE bits.

    Each group of rows under one key gives a spanning forest of its links, never all its pairs; a hot key is split.
    """
    ensure_worker_path(reps.sparkSession)

    def post(batch: pa.RecordBatch) -> pa.Table:
        fp = batch.column(1).to_numpy().view(np.uint64)
        at, keys = map(np.concatenate, zip(*chain_keys(fp), strict=True))
        return pa.table([pa.array(keys.view(np.int64)), *(c.take(pa.array(at)) for c in batch.columns)], ["key", "id", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for key, _, _, ids, fps in groups(batches, 3):
            ids, where = np.unique(ids.to_numpy(), return_index=True)
            if len(ids) > 1:
                fp = fps.to_numpy().view(np.uint64)[where]
                start = key[0].as_py() >> 26
                for x, y in forest(len(fp), lambda node, others, fp=fp, start=start: linked(fp[node], fp[others], start)):
                    a.append(ids[x])
                    b.append(ids[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    posted = map_batches(reps.select("id", "fp"), post, "key long, id long, fp long")
    dealt = meeting_blocks(posted, "key", "id", block).select("key", "_bx", "_by", "id", "fp")
    return dealt.repartition("key", "_bx", "_by").sortWithinPartitions("key", "_bx", "_by").mapInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Copies share a fingerprint and are one node, so a group of copies costs one row. Rows that repeat a doc_id each get
    the same answer. Rows without doc_id get their fingerprint, and the component of a document with the same
    fingerprint if one has an id, else null. An empty table gives an empty result.
    """
    own = cut(fingerprints(docs, text, key))
    reps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    roots = components(links(reps))
    labels = reps.join(roots, reps["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return own.join(labels, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
