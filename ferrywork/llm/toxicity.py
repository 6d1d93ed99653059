"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.common import cut, ensure_worker_path, map_batches

#: Labelled documents of each class that the models are fitted on, and twice as many that the scale is fitted on: a
#: sample in the order of a hash. Only this part is bounded; the shared counts cover every document.
SAMPLE = 10_000
#: Bins of the word before, for the shared counts. How many differ is read off the filled bins by linear counting, which
#: holds for some ten million words before a word.
BITS = 20
#: Buckets (a power of two) that pairs of words are dealt into to be counted, and pairs that a task holds before it sends them.
DEALT, HELD = 10, 2_000_000
#: What is taken off counts of 1, 2, 3 and more: an expression seen once or twice is left to the shared counts.
DISCOUNTS = (1.0, 1.75, 2.5)
STEM, WINDOW, TELLING = 4, 12, 2

_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def split(text: str) -> list[bytes]:
    """Words: runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII."""
    return text.encode().translate(_WORDS).split()


class Vocabulary:
    """The words of the fitted sample and their stems (the first STEM bytes), numbered in order."""

    def __init__(self, words: list[bytes]):
        import xxhash

        self.words = {w: k for k, w in enumerate(words)}
        self.stems = {w: k for k, w in enumerate(sorted({w[:STEM] for w in words}))}
        self.stem_of = np.array([self.stems[w[:STEM]] for w in words], np.int64)
        self.bins = np.fromiter((xxhash.xxh32_intdigest(w) & (1 << BITS) - 1 for w in words), np.int64, len(words))
        self.n, self.items = len(words), len(words) + len(self.stems) + 1

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word (-1 if it is not in the sample) and its item: the word itself, else n + its stem, else
        the last one."""
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        items, last = ids.copy(), len(self.stems)
        for k in np.flatnonzero(ids < 0).tolist():
            items[k] = self.n + self.stems.get(words[k][:STEM], last)
        return ids, items

    def before(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """The bin of the word before each word; 0 at first."""
        import xxhash

        if not words:
            return ids
        bins = self.bins[ids] if self.n else np.zeros(len(ids), np.int64)
        for k in np.flatnonzero(ids < 0).tolist():
            bins[k] = xxhash.xxh32_intdigest(words[k]) & (1 << BITS) - 1
        return np.concatenate([[0], bins[:-1]])


def part(key: str) -> Column:
    """crc32 of the id's decimal text, modulo 5; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def contexts(docs: DataFrame, text: str, vocabulary) -> np.ndarray:
    """For each item of the (broadcast) vocabulary, how many different words come before it in all documents.

    Different pairs of an item and a bin go to 2**DEALT buckets by bits of the bin, as sorted numbers of the other bits,
    so a bucket is put together and counted without a row for each pair and no frequent word makes a bucket large. Each
    task then sends a row for each item it counted.
    """
    low, items = BITS - DEALT, vocabulary.value.items
    kind = "<u4" if items < 1 << (32 - low) else "<u8"
    wide = max(items.bit_length(), 1) + low  # bits of a pair within its bucket

    def packed(pairs: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(pairs))
        bounds = np.searchsorted(found, np.arange((1 << DEALT) + 1) << wide)
        own = (found & ((1 << wide) - 1)).astype(kind)
        filled = np.flatnonzero(np.diff(bounds))
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([own[bounds[k] : bounds[k + 1]].tobytes() for k in filled], pa.binary())], ["bucket", "pairs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, v = [], 0, vocabulary.value
        for batch in batches:
            for t in batch.column(0):
                words = split(t.as_py() or "")
                ids, item = v.read(words)
                before = v.before(words, ids)
                held.append(before >> low << wide | item << low | before & ((1 << low) - 1))
                n += len(words)
                if n > HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bucket, held, n = np.zeros(items, np.int64), None, [], 0

        def add() -> None:
            at, own = np.unique(np.unique(np.concatenate(held)) >> low, return_counts=True)
            counts[at.astype(np.int64)] += own

        for batch in batches:
            for number, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and number != bucket:
                    add()
                    held, n = [], 0
                bucket = number
                held.append(np.frombuffer(pairs.as_py(), kind))
                n += len(held[-1])
                if n > HELD and n > 2 * len(held[0]):
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
        if held:
            add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["item", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(gather, "bucket int, pairs binary")
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tally, "item long, n long")
    found = dealt.groupBy("item").agg(F.sum("n").alias("n")).toArrow()
    filled, bins = np.bincount(found["item"].to_numpy(), weights=found["n"].to_numpy(), minlength=items), 1 << BITS
    return -bins * np.log1p(-np.minimum(filled, bins - 1) / bins)


def discount(count: np.ndarray) -> np.ndarray:
    return np.array([0.0, *DISCOUNTS])[np.minimum(count, 3).astype(np.int64)]


class Class:
    """The interpolated Kneser-Ney model of one class, for the words of the vocabulary.

    p(w | u) takes a discount off the count of u w and gives what that frees to p(w), which rests on how many different
    words w follows (its continuation count); what the discounts free there goes to p(stem of w), shared out among the
    words of the stem by the shared counts, and from there to the shared counts of all stems.
    """

    def __init__(self, v: Vocabulary, shared: np.ndarray, words: np.ndarray, after: np.ndarray, freed: np.ndarray, pair: np.ndarray, count: np.ndarray):
        """words: continuation counts; after, freed: counts of what follows each word (the text's start last), and the
        discounts off them; pair (word << 32 | next word, sorted) and count of pairs found twice or more."""
        by_stem = np.bincount(v.stem_of, weights=shared[: v.n], minlength=len(v.stems)) + shared[v.n : -1]
        whole = by_stem.sum() + shared[-1]
        off, total = discount(words), max(words.sum(), 1.0)
        of_stem = np.bincount(v.stem_of, weights=words, minlength=len(v.stems))
        off_stem = discount(of_stem)
        stem = (of_stem - off_stem + max(off_stem.sum(), 1.0) * by_stem / whole) / total
        rest = max(off.sum(), 1.0) / total
        word = (words - off) / total + rest * stem[v.stem_of] * shared[: v.n] / by_stem[v.stem_of]
        #: p(w) of items: of words; of others (by stem, the last for other stems) less their share of the stem, the same in any class
        self.p = np.concatenate([word, rest * np.append(stem, max(off_stem.sum(), 1.0) / total / whole)])
        self.n = v.n
        self.rest = np.append(np.where(after > 0, freed / np.maximum(after, 1), 1.0), 1.0)  # the last: an unknown word before
        self.after, self.pair, self.more = np.append(np.maximum(after, 1), 1), pair, count - discount(count)

    def logs(self, ids: np.ndarray, items: np.ndarray, u: np.ndarray) -> np.ndarray:
        p = self.p[items] * self.rest[u]
        if len(self.pair):
            key = u << 32 | np.maximum(ids, 0)
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            p = p + np.where((self.pair[at] == key) & (ids >= 0) & (u <= self.n), self.more[at], 0) / self.after[u]
        return np.log(p)


class Models:
    """Both classes' models over one vocabulary."""

    def __init__(self, v: Vocabulary, shared: np.ndarray, own: list[tuple]):
        self.v = v
        self.classes = [Class(v, shared + 0.5, *x) for x in own]

    def log_odds(self, text: str) -> np.ndarray:
        """log p(word | word before, toxic) - log p(word | word before, ordinary) of each word."""
        ids, items = self.v.read(split(text))
        u = np.concatenate([[self.v.n], np.where(ids[:-1] < 0, self.v.n + 1, ids[:-1])]) if len(ids) else ids
        ordinary, toxic = (c.logs(ids, items, u) for c in self.classes)
        return toxic - ordinary

    def features(self, text: str) -> tuple[float, float, float]:
        """Log-likelihoods of the toxic model less those of the ordinary one, normalised by length: of the whole text, of
        the WINDOW words in a row where that is largest, and of the TELLING words where it is largest, so that a long
        text hides nothing. Zeros without words."""
        x = self.log_odds(text)
        if not len(x):
            return 0.0, 0.0, 0.0
        sums = np.concatenate([[0.0], np.cumsum(x)])
        window = float((sums[WINDOW:] - sums[:-WINDOW]).max()) if len(x) > WINDOW else float(x.sum())
        return float(x.mean()), window / WINDOW, float(np.sort(x)[::-1][:TELLING].sum() / TELLING)


def fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with intercept and a weak prior, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w, prior = np.zeros(a.shape[1]), np.diag([1e-3] + [1e-2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + prior, a.T @ (y - p) - prior @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    return docs.join(F.broadcast(chosen.where("use = 0")), docs[key].cast("bigint") == F.col("_doc")).select("toxic", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def words_of(sample: DataFrame) -> Vocabulary:
    """The vocabulary of the sample; its size is bounded by the sample's."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(1).to_pylist() for w in split(t)}), pa.binary())], ["word"])

    return Vocabulary(sorted(map(bytes, map_batches(sample, words, "word binary").distinct().toArrow()["word"].to_pylist())))


def class_counts(sample: DataFrame, vocabulary) -> list[tuple]:
    """What Class needs of each class, counted over pairs of a word (the text's start: n) and the next one."""
    n = vocabulary.value.n

    def pairs(batch: pa.RecordBatch) -> pa.Table:
        made: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        for toxic, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = vocabulary.value.read(split(t))[0]
            made[toxic].append(np.concatenate([[n], ids[:-1]]) << 32 | ids if len(ids) else ids)
        out = []
        for toxic, x in enumerate(made):
            pair, count = np.unique(np.concatenate(x), return_counts=True)
            out.append(pa.table([pa.array(np.full(len(pair), toxic, np.int32)), pa.array(pair), pa.array(count)], ["toxic", "pair", "count"]))
        return pa.concat_tables(out)

    counted = cut(map_batches(sample, pairs, "toxic int, pair long, count long").groupBy("toxic", "pair").agg(F.sum("count").alias("count")))
    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    off = F.when(F.col("count") == 1, DISCOUNTS[0]).when(F.col("count") == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])
    words = counted.groupBy("toxic", second.alias("at")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    after = counted.groupBy("toxic", first.alias("at")).agg(F.sum("count").alias("n"), F.sum(off).alias("freed")).toArrow()
    often = counted.where("count > 1").toArrow()
    out = []
    for c in (0, 1):
        w, u, o = (t.filter(pa.compute.equal(t["toxic"], c)) for t in (words, after, often))
        filled = lambda t, name, size: np.bincount(t["at"].to_numpy(), weights=t[name].to_numpy(), minlength=size)
        order = np.argsort(o["pair"].to_numpy())
        out.append((filled(w, "n", n), filled(u, "n", n + 1), filled(u, "freed", n + 1), o["pair"].to_numpy()[order], o["count"].to_numpy()[order]))
    return out


def choose(labels: DataFrame, key: str, toxic: str, sample: int) -> DataFrame:
    """_doc, toxic and use (0: models, 1: scale) of at most 4 * sample labelled rows whose part is not 0.

    Models take up to `sample` documents of either class, from parts 1 to 3; the scale takes part 4. Of several labels of a
    document the largest counts; rows without id or label are left out.
    """
    own = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).cast("bigint").alias("_doc")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    own = cut(own.withColumn("_part", part("_doc")).where("_part <> 0").withColumn("_order", F.xxhash64("_doc", F.lit(11))))
    picks = [own.where((F.col("_part") < 4) & (F.col("toxic") == c)).orderBy("_order", "_doc").limit(sample).withColumn("use", F.lit(0)) for c in (0, 1)]
    picks.append(own.where("_part = 4").orderBy("_order", "_doc").limit(2 * sample).withColumn("use", F.lit(1)))
    return cut(picks[0].unionByName(picks[1]).unionByName(picks[2]).select("_doc", "toxic", "use"))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted, mean_log_odds, window_log_odds, word_log_odds.

    Scores come from the text alone. Null and empty texts have log odds 0 and get the score of that. A null id is not
    held out. Without labels of both classes no model can be learnt: every score is then the share of toxic labels
    among those of the scale (0 if there are none). Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    ensure_worker_path(spark)
    chosen = choose(labels, key, toxic, sample)
    docs, key, text = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text"
    sample = _sample(docs, chosen, key, text)
    vocabulary = spark.sparkContext.broadcast(words_of(sample))
    own, shared = class_counts(sample, vocabulary), contexts(docs, text, vocabulary)
    models = spark.sparkContext.broadcast(Models(vocabulary.value, shared, own))  # its size is bounded by the sample's
    names = ["mean", "window", "word"]

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [models.value.features(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.float64()) for k in range(3))], ["id", *names])

    schema = "id long, mean double, window double, word double"
    scale = docs.join(F.broadcast(chosen.where("use = 1")), docs[key].cast("bigint") == F.col("_doc")).select(F.col("toxic").cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    sampled = map_batches(scale, features, schema).toArrow()
    y, x = sampled["id"].to_numpy().astype(float), np.column_stack([sampled[n].to_numpy() for n in names])
    if 0 < y.sum() < len(y):
        w = [float(v) for v in fit_scale(x, y)]
    else:  # one class or none: the base rate
        rate = min(max(y.mean() if len(y) else 0.0, 1e-6), 1 - 1e-6)
        w = [float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0]
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    logit = sum((F.lit(v) * F.col(n) for v, n in zip(w[1:], names, strict=True)), F.lit(w[0]))
    scored = map_batches(rows, features, schema).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(part("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(n).alias(f"{n}_log_odds") for n in names))
