"""Substring dedup: MinHash banding of paragraphs, exact Jaccard of those that collide, removal by components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrywork.llm.common import components, cut, ensure_worker_path, forest, groups, map_batches, meeting_blocks, sieved, spooled

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a line that is a paragraph (at least), of a passage (exactly), and of a removed run of passages (at least).
PARAGRAPH, PASSAGE, RUN = 25, 20, 45
#: Shingles from which the anchor of a passage is the smallest. Any run of PASSAGE + ANCHOR - 1 = RUN words that two
#: texts share holds an anchor of both with PASSAGE words after it, so shared runs of that length are always found. For
#: the same reason such a run goes on for at most EDGE words before its first passage and after its last one.
ANCHOR = 26
EDGE = ANCHOR - 1
BLOCK = 256

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune(similarity: float = SIMILARITY, recall: float = 0.99, rows: int = 3) -> int:
    """Bands of `rows` hashes that a pair of the given similarity shares one of with at least the given probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


ROWS = 3
BANDS = tune(rows=ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fold(parts: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        out = _mix((out ^ p) * _STEP + np.uint64(1))
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each word of all texts (A-Z lower-cased), the words up to the end of each text (one more, from 0), and
    the paragraphs as word ranges: lines of PARAGRAPH words or more; the whole text if it has none (SHINGLE words or more)."""
    import xxhash

    words, ends, ranges = [], [0], []
    for text in texts:
        first, lines = len(words), len(ranges)
        for line in text.encode().translate(_LOWER).split(b"\n"):
            start = len(words)
            words += line.split()
            if len(words) - start >= PARAGRAPH:
                ranges.append((start, len(words)))
        if len(ranges) == lines and len(words) - first >= SHINGLE:
            ranges.append((first, len(words)))
        ends.append(len(words))
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.array(ends), np.array(ranges, np.int64).reshape(-1, 2)


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    return _fold([words[k : k + n] for k in range(SHINGLE)], 1) if n > 0 else np.empty(0, np.uint64)


def paragraphs(sh: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content hashes and bands (one row a paragraph) of the word ranges."""
    if not len(ranges):
        return np.empty(0, np.uint64), np.empty((0, BANDS), np.uint64)
    s, n = ranges[:, 0], ranges[:, 1] - ranges[:, 0] - SHINGLE + 1
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    within = np.arange(n.sum()) - np.repeat(first, n)
    own = sh[np.repeat(s, n) + within]
    least = [np.minimum.reduceat(_mix(own * f), first) for f in _FACTORS]
    bands = [_fold([np.full(len(s), b, np.uint64), *least[b * ROWS : (b + 1) * ROWS]], 2) for b in range(BANDS)]
    content = np.bitwise_xor.reduceat(_mix(own + _STEP * within.astype(np.uint64)), first)
    return _fold([content, n.astype(np.uint64)], 3), np.stack(bands, axis=1)


def passages(sh: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and content hashes of the passages of PASSAGE words at the anchors of texts that end at ends[1:].

    An anchor is the MinHash of a sliding window of ANCHOR shingles, so texts that share a run choose the same ones in it.
    """
    if len(sh) < ANCHOR:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(sh, ANCHOR)
    end = np.repeat(ends[1:], np.diff(ends))  # of the text of each word
    at = []
    for k in range(0, len(windows), 65_536):
        start = np.arange(k, min(k + 65_536, len(windows)))
        start = start[start + ANCHOR + SHINGLE - 1 <= end[start]]  # windows within one text
        at.append(windows[start].argmin(axis=1) + start)
    found = np.unique(np.concatenate(at))
    found = found[found + PASSAGE <= end[found]]
    return found, _fold([sh[found + k] for k in range(0, PASSAGE, SHINGLE)], 4)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, text and th, the text's hash: rows of one doc_id with different texts are told apart by it."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("th", F.xxhash64("text"))


def units(rows: DataFrame) -> DataFrame:
    """Per row of _rows(): doc_id, th, n_words and arrays over its units, paragraphs first, then passages: unit (content
    hash), start, end (words), run (whether it is a passage), bands (none of a passage: equal ones are one unit)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        words, ends, ranges = word_hashes(batch.column(1).to_pylist())
        sh = shingles(words)
        unit, bands = paragraphs(sh, ranges)
        at, passage = passages(sh, ends)
        cuts = [np.searchsorted(np.searchsorted(ends, x, "right") - 1, np.arange(len(ids) + 1)) for x in (ranges[:, 0], at)]
        out: list[list] = [[] for _ in range(6)]
        none = np.empty(0, np.int64)
        for k, doc in enumerate(ids):
            p, w = (slice(c[k], c[k + 1]) if doc is not None else slice(0, 0) for c in cuts)
            start, end = np.concatenate([ranges[p, 0], at[w]]) - ends[k], np.concatenate([ranges[p, 1], at[w] + PASSAGE]) - ends[k]
            run = np.repeat([False, True], [len(unit[p]), len(at[w])])
            for column, value in zip(out, (ends[k + 1] - ends[k], np.concatenate([unit[p], passage[w]]).view(np.int64), start, end, run, [*bands[p].view(np.int64), *[none] * len(at[w])]), strict=True):
                column.append(value)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(out, (pa.int32(), longs, ints, ints, pa.list_(pa.bool_()), pa.list_(longs)), strict=True))], ["doc_id", "th", "n_words", "unit", "start", "end", "run", "bands"])

    return map_batches(rows.select("doc_id", "text", "th"), one, "doc_id long, th long, n_words int, unit array<long>, start array<int>, end array<int>, run array<boolean>, bands array<array<long>>")


def _each(made: DataFrame, *names: str) -> DataFrame:
    """A row for each unit of each row: doc_id, th and the named fields."""
    return made.select("doc_id", "th", F.explode(F.arrays_zip(*names)).alias("u")).select("doc_id", "th", *(f"u.{n}" for n in names))


def _read_again(rows: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """text and `own` (the wanted fields, a list of structs) of each row that is wanted by doc_id and th."""
    by_row = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("own"))
    return sieved(rows.where("doc_id is not null"), "th", wanted, "th").join(by_row, ["doc_id", "th"])


def _shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted unit (unit, doc_id, th, start, end): unit and its different shingles (32 bits of each hash), read from
    its document. Sets are compared within a pair, where shingles that differ look equal once in 2**32."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        unit, sets = [], []
        for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sh = shingles(word_hashes([text])[0])
            for u in own:
                unit.append(u["unit"])
                sets.append(np.unique((sh[u["start"] : u["end"] - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32)).view(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], ["unit", "shingles"])

    return map_batches(_read_again(rows, wanted, ["unit", "start", "end"]).select("text", "own"), one, "unit long, shingles array<int>").dropDuplicates(["unit"])


def similar(rows: DataFrame, made: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of unit contents with a Jaccard similarity of SIMILARITY or more on word shingles.

    Contents that share a band meet in one group (hot bands in blocks) and are verified on their whole shingle sets;
    each group gives a spanning forest. Equal contents are one unit.
    """
    ensure_worker_path(rows.sparkSession)
    posted = _each(made, "unit", "bands").select("unit", F.explode("bands").alias("key"))
    shared = cut(posted.groupBy("key").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low <> high").select("key"))
    meet = cut(sieved(posted, "key", shared, "key").distinct().join(shared, "key", "left_semi"))  # a unit once, however often it stands
    found = meet.select("unit").distinct()
    at = sieved(_each(made, "unit", "start", "end"), "unit", found, "unit").groupBy("unit").agg(F.min(F.struct("doc_id", "th", "start", "end")).alias("at"))
    wanted = cut(at.join(found, "unit", "left_semi").select("unit", "at.*"))  # one row a unit before anything is joined
    dealt = meeting_blocks(meet, "key", "unit", block).join(_shingle_sets(rows, wanted), "unit")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, _, _, unit, sh in groups(batches, 3):
            unit, where = np.unique(unit.to_numpy(), return_index=True)
            own = [frozenset(sh[int(k)].as_py()) for k in where]

            def near(node: int, others: np.ndarray, own=own) -> np.ndarray:
                x = own[node]
                return np.array([len(x & own[o]) >= SIMILARITY * len(x | own[o]) for o in others.tolist()], bool)

            for x, y in forest(len(own), near):
                a.append(unit[x])
                b.append(unit[y])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select("key", "_bx", "_by", "unit", "shingles").repartition("key", "_bx", "_by").sortWithinPartitions("key", "_bx", "_by").mapInArrow(match, "a long, b long")


def _words_around(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted run (doc_id, th, start, end): the hashes of up to EDGE words before it (nearest first) and after it."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for doc, th, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = word_hashes([text])[0].view(np.int64)
            for at in own:
                s, e = at["start"], at["end"]
                for column, value in zip(out, (doc, th, s, e, words[max(s - EDGE, 0) : s][::-1], words[e : e + EDGE]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "th", "start", "end", "before", "after"])

    held = _read_again(rows, wanted, ["start", "end"]).select("doc_id", "th", "text", "own")
    return map_batches(held, one, "doc_id long, th long, start int, end int, before array<long>, after array<long>")


def extended(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """`hits` are passages (doc_id, th, start, end) with their keeper (low) and its place (at: th, start, end). Spans (doc_id, th, start, end) of runs of passages that repeat a keeper's, extended to the ends of the equal run.

    Passages of one run overlap or touch; those with the same keeper at the same distance are put together, and what is
    before the first and after the last is compared with the keeper's text word by word, for at most EDGE words a side:
    an equal run of RUN words or more ends there.
    """
    lane = Window.partitionBy("doc_id", "th", "low", "at.th", F.col("at.start") - F.col("start")).orderBy("start")
    step = hits.withColumn("_new", F.coalesce((F.col("start") - F.lag("start").over(lane) > PASSAGE).cast("int"), F.lit(0)))
    chained = step.withColumn("_chain", F.sum("_new").over(lane)).select("doc_id", "th", F.col("low").alias("k_doc"), F.col("at.th").alias("k_th"), (F.col("at.start") - F.col("start")).alias("_far"), "_chain", "start", "end")
    by = ["doc_id", "th", "k_doc", "k_th", "_far", "_chain"]
    runs = cut(chained.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end")).selectExpr("doc_id", "th", "start", "end", "k_doc", "k_th", "start + _far as k_start", "end + _far as k_end"))
    asked = runs.select("doc_id", "th", "start", "end").unionByName(runs.selectExpr("k_doc as doc_id", "k_th as th", "k_start as start", "k_end as end")).distinct()
    around = spooled(_words_around(rows, asked))
    theirs = around.selectExpr("doc_id as k_doc", "th as k_th", "start as k_start", "end as k_end", "before as k_before", "after as k_after")

    def same(side: str) -> Column:
        """Words up to the first that differs or is missing on either side."""
        equal = F.zip_with(side, f"k_{side}", lambda x, y: F.coalesce(x == y, F.lit(False)))
        place = F.coalesce(F.array_position(equal, F.lit(False)), F.lit(0))
        return F.when(place > 0, place - 1).otherwise(F.size(equal)).cast("int")

    both = runs.join(theirs, ["k_doc", "k_th", "k_start", "k_end"]).join(around, ["doc_id", "th", "start", "end"])
    return both.select("doc_id", "th", (F.col("start") - same("before")).alias("start"), (F.col("end") + same("after")).alias("end"))


def merged(spans: DataFrame) -> DataFrame:
    """doc_id, th and spans (start, end), in order and apart, of spans (doc_id, th, start, end, run) that may overlap.

    What is put together of passages alone counts from RUN words on. Running sums over a row's spans: none is copied.
    """
    lane = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    seen = F.max("end").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    joint = spans.withColumn("_new", F.coalesce((F.col("start") > seen).cast("int"), F.lit(0))).withColumn("_k", F.sum("_new").over(lane))
    whole = joint.groupBy("doc_id", "th", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("run").alias("run"))
    kept = whole.where(~F.col("run") | (F.col("end") - F.col("start") >= RUN))
    return kept.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _answers(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: doc_id, th, class_id, n_words, removed_words, is_clean, spans."""
    rows = _rows(docs, text, key)
    made = spooled(units(rows))
    # copies of a whole text lose it all and need no comparing
    texts = made.where(f"n_words >= {SHINGLE} and doc_id is not null").groupBy("th").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"))
    copied = cut(texts.where("owner < _last").select("th", "owner"))
    once = made.join(copied, "th", "left").where("owner is null or owner = doc_id").select(*made.columns)
    roots = components(similar(rows, once))
    each = _each(once, "unit", "start", "end", "run")
    held = each.groupBy("unit").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    known = held.join(roots, held["unit"] == roots["node"], "left").where("root is not null or low < high")
    clustered = cut(known.select("unit", "low", "high", F.coalesce("root", "unit").alias("root")))
    by_root = clustered.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("root", "low")
    keepers = cut(clustered.select("unit", "root").join(by_root, "root"))
    hits = cut(sieved(each, "unit", keepers, "unit").join(keepers.select("unit", "low"), "unit"))
    places = cut(hits.where("run and doc_id = low").groupBy("unit").agg(F.min(F.struct("th", "start", "end")).alias("at")))  # where a keeper holds a passage
    repeats = hits.where("doc_id > low")
    links = repeats.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()
    row = Window.partitionBy("doc_id", "th").orderBy("start", "run")
    held_by = F.coalesce(F.max(F.when(~F.col("run"), F.col("end"))).over(row), F.lit(0))  # a paragraph that goes anyway
    loose = repeats.withColumn("_to", held_by).where("run and end > _to")
    runs = loose.join(places, "unit").select("doc_id", "th", "low", "at", "start", "end")
    spans = repeats.where("not run").select("doc_id", "th", "start", "end", "run").unionByName(extended(rows, runs).withColumn("run", F.lit(True)))
    removed = cut(merged(spans))
    classes = components(links.join(removed.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi"))
    own = made.select("doc_id", "th", F.col("n_words").cast("bigint").alias("n_words")).join(copied, "th", "left").join(removed, ["doc_id", "th"], "left")
    whole = F.coalesce(F.col("owner") < F.col("doc_id"), F.lit(False))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    own = own.withColumn("spans", F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("spans", none)))
    own = own.withColumn("_first", F.when(whole, F.col("owner")).otherwise(F.col("doc_id"))).join(classes.select(F.col("node").alias("_first"), "root"), "_first", "left")
    lost = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("bigint")
    return own.select("doc_id", "th", F.coalesce("root", "_first").alias("class_id"), "n_words", lost.alias("removed_words"), (lost == 0).alias("is_clean"), "spans")


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, class_id, n_words, removed_words, is_clean, spans.

    Units are paragraphs (lines of 25 words or more; the whole text where it has none) and, for what repeats inside longer
    lines, passages of 20 words at anchors that are MinHashes of sliding windows. Paragraphs that share a band are
    compared; those whose five-word shingles have a Jaccard similarity of 0.8 or more are joined to clusters by
    components. Equal passages are one unit. In each cluster the document with the smallest doc_id keeps its text.
    Passages that repeat are verified word by word to the ends of the equal run and go if at least 45 words do so together.
    `spans` are the word ranges [start, end) that go from a row, merged and in order. class_id is the smallest doc_id
    connected through what goes (its own for a document that shares none). A copy of a whole text loses all of it.

    Repeats within one text stay, and so do lines of less than 25 words inside longer texts and texts of less than 5
    words. Null texts have no words. Rows without doc_id take no part: class null, nothing removed. Rows that repeat a
    doc_id and text get the same answer; different texts of one doc_id each have their own spans, and what repeats among
    them stays. Spans are word ranges of the whole text, so long texts need no cap. An empty table gives an empty result.
    """
    return _answers(docs, text, key).drop("th")


def without_spans(text: str, spans: list) -> str:
    """The text without the words of the spans (and the white space after them)."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : starts[s["start"]]])
        at = starts[s["end"]]
    return "".join([*out, text[at:]]).rstrip(" \t\n\v\f\r")


def remove_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` without the repeated spans; documents of which nothing is left go. Others keep all their columns.

    n_chars, if there is such a column, follows the text.
    """
    ensure_worker_path(docs.sparkSession)

    @F.arrow_udf("string")  # no pandas: its import alone takes some 27 MB of every worker
    def cutting(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_spans(t.as_py(), s.as_py()) if t.is_valid and s.is_valid else None for t, s in zip(texts, spans, strict=True)], pa.string())

    found = _answers(docs, text, key).where("removed_words > 0").select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("spans").alias("_spans")).dropDuplicates(["_doc", "_th"])
    joined = docs.join(found, (docs[key].cast("bigint") == found["_doc"]) & (F.xxhash64(docs[text].cast("string")) == found["_th"]), "left")
    changed = joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(cutting(F.col(text), F.col("_spans"))))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return changed.where(F.col("_spans").isNull() | (F.length(text) > 0)).select(*docs.columns)
