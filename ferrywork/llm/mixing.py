"""Mixing sources to target weights: blocks of packed words, multinomial counts per shard, index permutations."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ferrywork.llm.common import cut, ensure_worker_path

#: Words of a block (at least), blocks of an output shard, and parts a source's documents are dealt into for their running sums.
BLOCK, SHARD, PARTS = 256, 4096, 1024
#: Slots of a mix at most: what the generator draws exactly from. Blocks of a larger mix hold more words, by doubling.
SLOTS = 500_000_000
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
SEED = 20_240_501


def sizes(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(totals: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Targets of sources in order, whose weights repeat: shares of `share` of all sizes by weight, none above `most`
    times its source. What is above goes to the others by weight, again until none is above. Exact fractions."""
    weight = [weights[k % len(weights)] for k in range(len(totals))]
    out: list[Fraction | None] = [None] * len(totals)
    rest, open_ = share * sum(totals), set(range(len(totals)))
    while open_:
        by = sum(weight[k] for k in open_)
        above = [k for k in open_ if rest * weight[k] > most * totals[k] * by]
        if not above:
            for k in open_:
                out[k] = rest * weight[k] / by
            break
        for k in above:
            out[k] = Fraction(most * totals[k])
        rest -= sum(most * totals[k] for k in above)
        open_ -= set(above)
    return [x if x is not None else Fraction(0) for x in out]


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the given indices: four Feistel rounds, walked until inside.

    No table of n entries is kept, so any task maps any slot by itself.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    outside = np.ones(len(out), bool)
    while outside.any():
        left, right = out[outside] >> np.uint64(half), out[outside] & mask
        for r in range(4):
            left, right = right, left ^ (_scramble(right, key * 7919 + r) & mask)
        out[outside] = left << np.uint64(half) | right
        outside = out >= n
    return out.astype(np.int64)


def shard_counts(slots: list[int], shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots in it): multinomial draws given what all shards hold together.

    Shards are halved down to the one asked for; each halving draws, from a generator of its own, how many of the
    sources' slots fall to the left half (multivariate hypergeometric: a multinomial given its totals). So the counts of
    all shards add up to `slots` exactly, and any task finds those of its shard in log2(shards) draws.
    """
    left, here, low, high = np.zeros(len(slots), np.int64), np.array(slots, np.int64), 0, shards
    total = int(here.sum())
    bound = lambda k: total * k // shards
    while high - low > 1:
        mid = (low + high) // 2
        n = bound(mid) - bound(low)
        part = np.random.default_rng((seed, low, high)).multivariate_hypergeometric(here, n, method="marginals")
        if shard < mid:
            here, high = part, mid
        else:
            left, here, low = left + part, here - part, mid
    return left, here


class Mix(NamedTuple):
    """laid: the documents, end to end by source (_k, _start, _size and their own columns). spans: for each slot of each
    output shard the words of documents that fill it: _shard, _position, _k, _start, _from, _to (words of the document)."""

    laid: DataFrame
    spans: DataFrame


def block_words(words: int, block: int = BLOCK) -> int:
    """Words of a block: `block`, doubled until the mix's words take SLOTS slots at most. So counts are drawn exactly at
    any size, and the number of shards and tasks is bounded."""
    while words // block > SLOTS // 2:
        block *= 2
    return block


def plan_mix(docs: DataFrame, size: str, source: str, order: str, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """The mix of documents of which `size` words, `source` and the id `order` are given.

    1. Each source's documents are laid end to end in the order of a hash and cut into blocks of `block` words (the
       last one may be shorter). Running sums are taken over PARTS parts of a source and then over its parts, so no task
       holds a source.
    2. A source gives target / size passes: whole ones take each block once, the last one a part of the blocks; its last
       two slots are cut so that the source's words meet its target to the word. Output shards hold `shard` slots; their
       source counts are drawn by shard_counts(), and their slots stand in the order of a permutation.
    3. The j-th slot of a source is block permuted(j mod blocks) of pass j div blocks. Blocks are joined to documents by
       source and index.

    Sources are collected to the driver with one row each (a name and a size), nothing else is. Ties of the order hash go
    by `order`, then size. Sources sort by code point (UTF-8 bytes), null last; a null size counts as 0.
    """
    spark = docs.sparkSession
    ensure_worker_path(spark)
    docs = cut(docs.select(F.col(order).alias("_order"), F.col(source).alias("_source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size")))
    by_source = docs.groupBy(F.col("_source").alias("name")).agg(F.sum("_size").alias("total")).collect()
    by_source.sort(key=lambda r: (r["name"] is None, (r["name"] or "").encode()))
    totals = [int(r["total"]) for r in by_source]
    goal = targets(totals)
    words = [int(x) for x in goal]
    block = block_words(sum(words), block)
    blocks = [-(-t // block) for t in totals]
    slots = []
    for t, b, w in zip(totals, blocks, words, strict=True):
        passes, rest = divmod(w, t) if t else (0, 0)
        slots.append(passes * b + (min(rest // block + 2, b) if rest else 0))
    shards = max(1, -(-sum(slots) // shard))
    schema = T.StructType([T.StructField("_k", T.IntegerType()), T.StructField("_name", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_words", T.LongType()), T.StructField("_blocks", T.LongType()), T.StructField("_slots", T.LongType())])
    sources = spark.createDataFrame([(k, r["name"], t, float(g), w, b, s) for k, (r, t, g, w, b, s) in enumerate(zip(by_source, totals, goal, words, blocks, slots, strict=True))], schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                before, here = shard_counts(slots, shards, number, seed)
                k, index, whole = [], [], []
                for s in np.flatnonzero(here):
                    j = np.arange(before[s], before[s] + here[s])
                    for p in np.unique(j // blocks[s]):
                        own = j[j // blocks[s] == p]
                        index.append(permuted(own % blocks[s], blocks[s], (seed * 31 + int(s)) * 64 + int(p)))
                        k.append(np.full(len(own), s, np.int32))
                        whole.append(own)
                cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (k, index, whole)]
                n = len(cols[0])
                place = permuted(np.arange(n), n, seed * 17 + number) if n else cols[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), pa.array(place, pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["_shard", "_position", "_k", "_block", "_slot"])

    numbers = spark.range(0, shards, 1, -(-shards // 16))
    drawn = numbers.mapInArrow(draw, "_shard long, _position int, _k int, _block long, _slot long").join(F.broadcast(sources), "_k")  # one row a source, as collected above
    length = F.least(F.lit(block), F.col("source_size") - F.col("_block") * block)
    partial = F.col("_slot") >= F.floor(F.col("_words") / F.col("source_size")) * F.col("_blocks")
    used = cut(_given(drawn.withColumns({"_len": length, "_partial": partial})).select("_shard", "_position", "_k", "_block", "_give"))

    place = F.xxhash64("_order", F.lit(seed))
    placed = docs.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_name"))).withColumns({"_hash": place, "_part_of": F.pmod(F.shiftright(place, 20), F.lit(PARTS))})
    sums = placed.groupBy("_k", "_part_of").agg(F.sum("_size").alias("_sum"))
    offsets = sums.select("_k", "_part_of", (F.sum("_sum").over(Window.partitionBy("_k").orderBy("_part_of")) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy("_k", "_part_of").orderBy("_hash", "_order", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = cut(placed.withColumn("_run", F.sum("_size").over(inside)).join(offsets, ["_k", "_part_of"]).withColumn("_start", F.col("_offset") + F.col("_run") - F.col("_size")).drop("_run", "_offset", "_hash", "_name"))
    held = laid.where("_size > 0").select("_k", "_start", "_size", F.explode(F.expr(f"sequence(_start div {block}, (_start + _size - 1) div {block})")).alias("_block"))
    low, high = F.greatest("_start", F.col("_block") * block), F.least(F.col("_start") + F.col("_size"), F.col("_block") * block + F.col("_give"))
    spans = used.join(held, ["_k", "_block"]).where(high > low).select("_shard", "_position", "_k", "_start", (low - F.col("_start")).alias("_from"), (high - F.col("_start")).alias("_to"))
    return Mix(laid, spans)


def _given(drawn: DataFrame) -> DataFrame:
    """Adds _give: the words that a slot takes of its block: all it holds, but for the last two slots of the partial
    pass, which give what is missing to the source's words. One of them may hold the source's short block."""
    tail = F.col("_partial") & (F.col("_slot") >= F.col("_slots") - 2)
    drawn = cut(drawn)
    before = drawn.where(F.col("_partial") & ~tail).groupBy("_k").agg(F.sum("_len").alias("_before"))
    rest = F.col("_words") % F.col("source_size") - F.coalesce("_before", F.lit(0))
    earlier = F.sum("_len").over(Window.partitionBy("_k").orderBy("_slot")) - F.col("_len")  # two rows a source
    ends = drawn.where(tail).join(before, "_k", "left").withColumn("_give", F.greatest(F.lit(0), F.least(F.col("_len"), rest - earlier))).drop("_before")
    return drawn.where(~tail).withColumn("_give", F.col("_len")).unionByName(ends)


def mix(docs: DataFrame, size: str, source: str, order: str, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Per row: the columns `order` and `source`, size, source_size, target (double) and taken (bigint): the words that
    the mix's spans hold of it, repeats counted."""
    laid, spans = plan_mix(docs, size, source, order, block, shard, seed)
    taken = spans.groupBy("_k", "_start").agg(F.sum(F.col("_to") - F.col("_from")).alias("taken"))
    zero = laid.where("_size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    some = laid.where("_size > 0").join(taken, ["_k", "_start"], "left")
    out = zero.unionByName(some, allowMissingColumns=True)
    return out.select(F.col("_order").alias(order), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _sized(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), sizes(F.col(text)).alias("size"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The query's rows: doc_id, size, source_size, target, taken. A null text has size 0; a null source is a source."""
    return mix(_sized(docs, text, source, key), "size", "source", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix itself: shard, position, source, text (the words of a block, by single spaces): blocks joined to the texts
    of their documents by source and index. Documents need ids that differ; rows without id give no words."""
    laid, spans = plan_mix(_sized(docs, text, source, key).where("doc_id is not null"), "size", "source", "doc_id", block, shard)
    whole = docs.select(F.col(key).cast("bigint").alias("_order"), F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)")).alias("_all"))
    words = spans.join(laid.where("_size > 0").select("_k", "_start", "_order", "_source"), ["_k", "_start"]).join(whole, "_order")
    piece = F.struct("_start", F.array_join(F.slice("_all", F.col("_from").cast("int") + 1, (F.col("_to") - F.col("_from")).cast("int")), " ").alias("words"))
    made = words.groupBy("_shard", "_position", "_source").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))  # one block
    return made.select(F.col("_shard").alias("shard"), F.col("_position").alias("position"), F.col("_source").alias("source"), F.array_join("_pieces.words", " ").alias("text"))


#: Parts that the documents of one order of size are dealt into for running sums; units of a share.
ROUNDED, UNITS = 64, 1_000_000_000


def copies(shares: DataFrame) -> DataFrame:
    """_doc and _copies: whole numbers near _x (a share of at least 0) such that those of each _source add up, and so do
    their words (_words), but for a few documents.

    Controlled rounding: the fractions are summed up along the documents of a source in the order of their size, and a
    document is taken once more where the sum passes a whole number. Running sums go over parts (one order of size, a
    part of a hash), then over the parts of a source.
    """
    fraction = ((F.col("_x") - F.floor("_x")) * UNITS).cast("bigint")
    part = F.floor(F.log2(F.greatest("_words", F.lit(1)))).cast("int") * ROUNDED + F.pmod(F.xxhash64("_doc", F.lit(SEED)), F.lit(ROUNDED)).cast("int")
    rows = shares.withColumns({"_f": fraction, "_p": part})
    sums = rows.groupBy("_source", "_p").agg(F.sum("_f").alias("_sum"))
    before = sums.select(F.col("_source").alias("_s"), F.col("_p").alias("_q"), (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_p")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_source", "_p").orderBy("_doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("_run", F.sum("_f").over(inside)).join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    upto = F.col("_before") + F.col("_run") + UNITS // 2
    more = F.floor(upto / UNITS) - F.floor((upto - F.col("_f")) / UNITS)
    return run.select("_doc", (F.floor("_x") + more).cast("int").alias("_copies"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix as documents, whole texts: each row as often as the mix takes its words, rounded so that the words of each
    source come near its target (copies()). Rows that repeat an id come equally often. Rows without words or id stay once."""
    taken = mix(_sized(docs, text, source, key), "size", "source", "doc_id").where("doc_id is not null and size > 0")
    shares = taken.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.col("taken") / F.col("size")).alias("_x"), F.max("size").alias("_words"), F.max("source").alias("_source"))
    joined = docs.join(copies(cut(shares)), docs[key].cast("bigint") == F.col("_doc"), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
