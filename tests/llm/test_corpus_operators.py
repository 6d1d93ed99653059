"""Near-duplicates, substrings, mixing, toxicity, neighbours, chat and the pipeline against plain versions."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ferrywork.llm import ann, chat, common, mixing, queries, quality, simhash, substring, toxicity

D = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def words(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]


def plain_fingerprint(text):
    w = words(text.translate(LOW))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + 4] for k in range(len(w) - 3)] if len(w) > 3 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(texts):
    fp = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    u, ids = Union(), sorted(fp)
    for k, a in enumerate(ids):
        u.find(a)
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                u.join(a, b)
    return fp, {i: u.find(i) for i in ids}


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def test_components(spark):
    rng, u = random.Random(2), Union()
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    for a, b in edges:
        if a != b:
            u.join(a, b)
    for small in (0, common.SMALL):  # by rounds, and by one task
        found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
        assert found == {x: u.find(x) for x in u}
        assert common.components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def test_blocks_meet_all_pairs(spark):
    rows = common.meeting_blocks(spark.createDataFrame([(1, k) for k in range(50)] + [(2, 99)], "key long, id long"), "key", "id", 7).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r["key"], r["_bx"], r["_by"]].add(r["id"])
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert all((a, b) in met for a in range(50) for b in range(50)) and max(map(len, groups.values())) < 35


def test_sieve_keeps_all_wanted(spark):
    kept = common.sieved(spark.range(5000), "id", spark.range(0, 5000, 50).withColumnRenamed("id", "x"), "x").collect()
    assert {r["id"] for r in kept} >= set(range(0, 5000, 50)) and len(kept) < 300


def test_op4(spark):
    fp, group = plain_groups(texts_of(spark))
    rows = queries.queries()["op4_simhash"](spark, D).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == {i: (fp[i], group[i]) for i in fp}


@pytest.mark.parametrize("block", [4, 1024])
def test_pigeonring_links(spark, block):
    rng, u, values = random.Random(7), Union(), set()
    for _ in range(30):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(12)}
    values = sorted(values)
    for k, a in enumerate(values):
        for j in range(k):
            if (a ^ values[j]).bit_count() <= 4:
                u.join(j, k)
    rows = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "id long, fp long")
    found = {r["node"]: r["root"] for r in common.components(simhash.links(rows, block)).collect()}
    assert found == {x: u.find(x) for x in u}


def test_near_duplicates_of_odd_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    of = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and {of[i]["component_id"] for i in (0, 1, 2)} == {0} and of[4]["component_id"] == 3 and of[6]["component_id"] == 5
    assert of[0]["fingerprint"] == "0" * 16 and of[None]["component_id"] is None
    assert simhash.near_duplicates(no_docs).count() == 0


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_substring(spark):
    shared, near = passage(1, 60), passage(2, 80).split()
    edited = near[:40] + ["changed"] + near[41:]
    texts = {1: f"{passage(3, 40)} {shared} {passage(4, 30)}", 2: f"{passage(5, 33)} {shared} {passage(6, 51)}", 3: passage(7, 300), 4: f"{passage(8, 20)}\n{' '.join(near)}", 5: f"{' '.join(edited)}\n{passage(9, 45)}", 6: shared, 7: f"{passage(10, 90)}\nthe same short line\n", 8: f"{passage(11, 90)}\nthe same short line\n"}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert {i: r["class_id"] for i, r in rows.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1, 7: 7, 8: 8}
    assert {i for i, r in rows.items() if not r["is_clean"]} == {2, 5, 6}
    left = {r["doc_id"]: r for r in substring.remove_passages(docs).collect()}
    assert all(left[i]["text"] == texts[i] for i in (1, 3, 4, 7, 8))
    assert 6 not in left  # a document that is wholly a repeat goes
    assert passage(6, 51).split()[-20:] == left[2]["text"].split()[-20:] and left[2]["n_chars"] == len(left[2]["text"]) < len(texts[2]) - 60
    assert left[5]["text"] == passage(9, 45)


def test_substring_finds_shared_runs(spark):
    texts, seen, later = texts_of(spark), {}, set()
    for i in sorted(texts):
        w = words(texts[i].translate(LOW))
        for k in range(len(w) - 44):
            if seen.setdefault(tuple(w[k : k + 45]), i) != i:
                later.add(i)
    rows = queries.queries()["op10_substring_dedup"](spark, D).collect()
    assert len(rows) == len(texts) and later <= {r["doc_id"] for r in rows if not r["is_clean"]}


def test_bands_reach_the_recall(spark):
    """Paragraph pairs of Jaccard 0.8 and a little more, each edge looked for by itself."""
    assert substring.BANDS == 7 and 1 - (1 - 0.8**substring.ROWS) ** substring.BANDS > 0.99
    rng, docs, pairs = random.Random(17), [], 600
    for k in range(pairs):
        a = [f"w{rng.getrandbits(40)}" for _ in range(94)]  # 90 shingles
        b = a[:84] + [f"w{rng.getrandbits(40)}" for _ in range(10)]  # 80 of them and 10 others
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    rows = substring._rows(spark.createDataFrame(docs, "doc_id long, text string"), "text", "doc_id")
    made = substring.units(rows)
    whole = made.select("doc_id", F.explode(F.arrays_zip("unit", "run")).alias("u")).where("not u.run").select("u.unit", "doc_id").collect()
    doc = {r["unit"]: r["doc_id"] for r in whole}
    found = {frozenset((doc[r["a"]], doc[r["b"]])) for r in substring.similar(rows, made).collect() if r["a"] in doc and r["b"] in doc}
    assert sum(frozenset((2 * k, 2 * k + 1)) in found for k in range(pairs)) >= 0.98 * pairs


def test_short_paragraphs(spark):
    """Lines of 5 to 24 words: inside longer texts they stay, however often they repeat; whole texts of them are compared."""
    texts, lines = {}, {n: passage(200 + n, n) for n in range(5, 25)}
    for n, line in lines.items():
        texts[n] = f"{passage(300 + n, 30)}\n{line}"
        texts[100 + n] = f"{line}\n{passage(400 + n, 30)}"
        texts[1000 + n] = texts[1100 + n] = f"{passage(1500 + n, n)}\n{passage(1600 + n, 3)}"
    near = passage(500, 24)
    texts |= {200: near, 201: near + " more", 202: passage(501, 12), 203: passage(502, 12)}
    rows = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(rows[i]["is_clean"] for n in lines for i in (n, 100 + n, 1000 + n)) and all(rows[i]["is_clean"] for i in (200, 202, 203))
    assert all([tuple(x) for x in rows[1100 + n]["spans"]] == [(0, n + 3)] and rows[1100 + n]["class_id"] == 1000 + n for n in lines)
    assert rows[201]["removed_words"] == 25


def test_substring_removes_repeats_alone(spark):
    """Every removed word of the smallest tables lies in a line, text or run that an earlier document holds or nearly so."""
    texts = texts_of(spark)
    rows = {r["doc_id"]: r for r in queries.queries()["op10_substring_dedup"](spark, D).collect()}
    split = {i: words(t.translate(LOW)) for i, t in texts.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    for i, r in rows.items():
        for s in r["spans"]:
            own = {tuple(split[i][k : k + 5]) for k in range(s["start"], s["end"] - 4)}
            others = set().union(*(g for j, g in grams.items() if rows[j]["class_id"] == r["class_id"] and j != i))
            assert len(own & others) >= 0.8 * len(own) - 8  # a Jaccard of 0.8 of each unit, but for its two ends


def test_rows_that_share_an_id(spark):
    """Different texts under one doc_id are rows of their own, of other lengths and with other spans."""
    long, short = passage(71, 120), passage(72, 30)
    docs = spark.createDataFrame([(1, f"{passage(73, 40)} {long}"), (5, f"{passage(74, 50)} {long} {passage(75, 20)}"), (5, short), (5, short), (None, long)], "doc_id long, text string")
    rows = substring.repeated_passages(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["removed_words"]) for r in rows) == [(0, 120, 0), (1, 160, 0), (5, 30, 0), (5, 30, 0), (5, 190, 120)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in substring.remove_passages(docs).collect())
    assert left == sorted([(0, long), (1, f"{passage(73, 40)} {long}"), (5, f"{passage(74, 50)} {passage(75, 20)}"), (5, short), (5, short)])


def test_substring_extends_to_the_ends(spark):
    """Runs inside longer lines go to the word, next to words that differ, at a text's edges and from whole documents."""
    texts = {0: passage(600, 900)}
    w = texts[0].split()
    runs = {k: (37 * k % 700, 45 + 5 * k) for k in range(1, 25)}
    for k, (at, n) in runs.items():
        own, before, after = " ".join(w[at : at + n]), passage(700 + k, k % 3 * 9), passage(800 + k, k % 4 * 9)
        texts[k] = f"{before} {own} {after}".strip()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert rows[0]["is_clean"]
    assert {k: [tuple(x) for x in rows[k]["spans"]] for k in runs} == {k: [(k % 3 * 9, k % 3 * 9 + n)] for k, (_, n) in runs.items()}
    assert {r["doc_id"] for r in substring.remove_passages(docs).collect()} == {0} | {k for k in runs if k % 3 or k % 4}


def test_substring_of_odd_rows(docs, no_docs):
    rows = substring.repeated_passages(docs).collect()
    of = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and not of[6]["is_clean"] and of[5]["is_clean"] and of[None]["class_id"] is None and of[0]["n_words"] == 0
    assert substring.remove_passages(docs).columns == docs.columns
    assert substring.repeated_passages(no_docs).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100]) == [Fraction(200), Fraction(500, 3), Fraction(250, 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_shards_add_up():
    before = np.zeros(3, int)
    for k in range(9):
        left, here = mixing.shard_counts([500, 70, 3], 9, k)
        assert (left == before).all()
        before += here
    assert before.tolist() == [500, 70, 3]


def test_op2(spark):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = queries.queries()["op2_mixing"](spark, D).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.queries()["op2_mixing"](spark, D).collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(size)
    assert [target[s] for s in names] == [float(x) for x in mixing.targets([size[s] for s in names])]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_blocks_of_the_mix(spark):
    """The mix's blocks hold the words that op2 counts, each block in one piece of its source's text, none above 2 times."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.mixed_blocks(docs, shard=100).collect()
    assert len({(r["shard"], r["position"]) for r in rows}) == len(rows)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["position"])
    assert all(0 <= min(v) and max(v) < 100 for v in by_shard.values()) and len(by_shard) > 3  # the last slots of a source may give no words
    taken, found = defaultdict(int), defaultdict(int)
    for r in mixing.mix_documents(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        taken[r["source"]] += r["taken"]
    for r in rows:
        found[r["source"]] += len(words(r["text"]))
        assert 0 < len(words(r["text"])) <= mixing.BLOCK
    assert found == taken
    texts = {r["source"]: set() for r in rows}
    for r in docs.collect():
        texts[r["source"]] |= set(words(r["text"]))
    assert all(set(words(r["text"])) <= texts[r["source"]] for r in rows)


def test_blocks_grow_with_the_mix():
    assert mixing.block_words(10**9) == 256 and mixing.block_words(3 * 10**13) <= 2**18
    assert all(10**k // mixing.block_words(10**k) <= mixing.SLOTS // 2 for k in range(1, 18))


def test_whole_documents_near_their_target(spark):
    rng = random.Random(8)
    rows = [(k, f"s{k % 3}", rng.choice((1, 5, 40, 300, 2000)), rng.random() * 2) for k in range(6000)]
    found = {r["_doc"]: r["_copies"] for r in mixing.copies(spark.createDataFrame(rows, "_doc long, _source string, _words long, _x double")).collect()}
    assert all(int(x) <= found[k] <= int(x) + 1 for k, _, _, x in rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r[1] == s]
        assert abs(sum(found[k] * n for k, _, n, _ in own) - sum(x * n for _, _, n, x in own)) < 2 * 2000


def test_mixing_of_odd_rows(docs, no_docs):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 9 and all(r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_op7(spark):
    import zlib

    rows = {r["doc_id"]: r for r in queries.queries()["op7_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93 and sum(a and b for a, b in held) / sum(a for a, _ in held) > 0.6


def test_contexts_of_all_documents(spark):
    """Words after thousands of others, in several documents, words that no labelled document holds, and other stems."""
    texts = [" ".join(f"w{k} often" for k in range(j * 1000, j * 1000 + 2000)) + " rare oftener else" for j in range(3)]
    v = toxicity.Vocabulary([b"often", b"rare"])
    before = defaultdict(set)
    for t in texts:
        w = t.split()
        for x, y in zip(["", *w], w):
            before[{"often": 0, "rare": 1, "oftener": 2}.get(y, 4)].add(x)
    found = toxicity.contexts(spark.createDataFrame([(t,) for t in texts], "text string"), "text", spark.sparkContext.broadcast(v))
    assert len(found) == 5 and found[:3] == pytest.approx([len(before[k]) for k in range(3)], rel=0.01) and found[4] == pytest.approx(len(before[4]), rel=0.01)
    assert found[0] > 3900 and found[3] == 0


def plain_models(samples, corpus):
    """p(word | word before) of both classes from dictionaries, for words of the samples."""
    off = lambda c: (0, 1.0, 1.75, 2.5)[min(c, 3)]
    vocabulary = sorted({w for texts in samples for t in texts for w in t.split()})
    pairs = {(x, y) for t in corpus for x, y in zip(["", *t.split()], t.split())}
    shared = {w: 0.5 + sum(y == w for _, y in pairs) for w in vocabulary}
    stems = sorted({w[:4] for w in vocabulary})
    stem = {s: 0.5 + len({x for x, y in pairs if y[:4] == s and y not in shared}) + sum(n for w, n in shared.items() if w[:4] == s) for s in stems}
    whole = sum(stem.values()) + 0.5 + len({x for x, y in pairs if y[:4] not in stem})
    out = []
    for texts in samples:
        bigrams = defaultdict(int)
        for t in texts:
            for x, y in zip(["", *t.split()], t.split()):
                bigrams[x, y] += 1
        follows = {w: sum(y == w for _, y in bigrams) for w in vocabulary}
        of_stem = {s: sum(n for w, n in follows.items() if w[:4] == s) for s in stems}
        total, rest, rest_stem = len(bigrams), sum(map(off, follows.values())), sum(map(off, of_stem.values()))

        def p(u, w, bigrams=bigrams, follows=follows, of_stem=of_stem, total=total, rest=rest, rest_stem=rest_stem):
            s = w[:4]
            of = (of_stem[s] - off(of_stem[s]) + rest_stem * stem[s] / whole) / total
            one = (follows[w] - off(follows[w])) / total + rest / total * of * shared[w] / stem[s]
            after = [c for (x, _), c in bigrams.items() if x == u]
            if not after:
                return one
            c = bigrams.get((u, w), 0)
            return (c - off(c)) / sum(after) + sum(map(off, after)) / sum(after) * one

        out.append(p)
    return out, vocabulary


def test_kneser_ney_like_plain(spark):
    rng, letters = random.Random(4), "lowei lowen loweit stark starr mild milder und oder aber".split()
    texts = [" ".join(rng.choice(letters[c:]) for _ in range(rng.randint(1, 14))) for c in (0, 3) for _ in range(12)]
    corpus = texts + ["und neu starkes aber mild", "loweix ganz anders"]
    rows = spark.createDataFrame([(int(k >= 12), t) for k, t in enumerate(texts)], "toxic int, text string")
    v = spark.sparkContext.broadcast(toxicity.words_of(rows))
    shared = toxicity.contexts(spark.createDataFrame([(t,) for t in corpus], "text string"), "text", v)
    models = toxicity.Models(v.value, np.round(shared), toxicity.class_counts(rows, v))
    (ordinary, toxic), vocabulary = plain_models([texts[:12], texts[12:]], corpus)
    assert [w.decode() for w in v.value.words] == vocabulary
    for t in texts:
        w = t.split()
        want = [np.log(toxic(x, y) / ordinary(x, y)) for x, y in zip(["", *w], w)]
        assert models.log_odds(t) == pytest.approx(want)
    for p in (ordinary, toxic):  # nothing is lost but what words outside the sample get
        assert 0.5 < sum(p("und", w) for w in vocabulary) <= 1


def test_toxicity_of_odd_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == pytest.approx([1e-6] * 9)
    assert toxicity.toxicity(no_docs, none).count() == 0


def test_op8_recall(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    rows, hit, n = defaultdict(list), 0, 0
    for r in queries.queries()["op8_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect():
        rows[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - vectors[q]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        true = {int(ids[k]): far[k] for k in np.lexsort((ids, far))[:10]}
        assert [k for k, *_ in sorted(rows[q])] == list(range(1, 11))
        assert all(s == pytest.approx(np.linalg.norm(vectors[q] - vectors[v]), abs=1e-12) for _, v, s in rows[q])
        hit, n = hit + len(set(true) & {v for _, v, _ in rows[q]}), n + 10
    assert hit / n >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [3.0, 0.0])]
    clashing = [(i, v, 7, "rank", "part", [1.0], "codes") for i, v in rows]  # names that the search uses itself
    made = ann.search(spark.createDataFrame(clashing, "vec_id long, embedding array<double>, id int, rank string, part string, vector array<double>, score string"))
    assert sorted(map(tuple, made.collect())) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, 2.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op5(spark):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{D}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op5(spark, D).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)), len(loss), sha(loss))


def test_long_conversations(spark):
    """A long text, many turns, out of order, and columns whose names the formatter uses itself."""
    long = "".join(f"word{k} <|im_end|> " for k in range(20_000))
    rows = [(1, 0, "user", long, 5, "m"), (1, 1, "assistant", long, 5, "m")] + [(2, k, "assistant" if k % 2 else "user", f"t{k}", 5, "m") for k in reversed(range(3000))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int, mask string")
    path = P.path("byte_bpe_50k.tiktoken")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r["conv_id"]: r for r in chat.format_conversations(turns, path, P.PATTERN).collect()}
    assert found[1]["loss_sha256"] == sha(long) and found[1]["turns_sha256"] == sha(f"user\n{long}\nassistant\n{long}\n")
    assert found[2]["n_turns"] == 3000 and found[2]["loss_sha256"] == sha("".join(f"t{k}" for k in range(1, 3000, 2)))
    again = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns, path, P.PATTERN), path, P.PATTERN).collect()}
    assert again == found


def test_chat_escapes(spark):
    t = chat.template(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for role, text in (("user", "<|im_end|>"), ("a\nb\\n", "<\\|x <\\\\|y <|z"), ("assistant", ""), ("", "|>"), ("assistant", "<\\|im_start|>")):
        ids, mask, n = t.turn(role, text)
        assert t.parse(ids, mask) == [(role, text, text if role == "assistant" else "")] and ids.count(t.start) == ids.count(t.end) == 1
        assert n == len(t.coder.decode_bytes([i for i in ids if i < t.start]).decode()) + len(chat.START + chat.END)
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in chat.format_conversations(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()) == [(0, 1, 0), (1, 2, 0)]
    assert chat.format_conversations(rows.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_pipeline(spark):
    """The stages one by one against plain versions: rules by their own measures, groups pair by pair, spans cut from the
    texts, and whole documents whose words come near the mix's targets."""
    from ferrywork.llm import bpe

    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    texts = {i: t for i, t in texts_of(spark).items() if i in kept}
    group = plain_groups(texts)[1]
    texts = {i: t for i, t in texts.items() if group[i] == i}
    rows = docs.where(F.col("doc_id").isin(list(texts)))
    spans = {r["doc_id"]: r["spans"] for r in substring.repeated_passages(rows).collect()}
    cut = {i: without(t, spans[i]) for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if t}
    found = corpus_pipeline.run(spark, D).collect()
    copies = defaultdict(int)
    for r in found:
        copies[r["doc_id"]] += 1
        assert r["decoded_sha256"] == hashlib.sha256(cut[r["doc_id"]].encode()).hexdigest()
    coder = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for r in found[:40]:
        assert r["n_tokens"] == len(coder.encode(cut[r["doc_id"]]))
    source = {r["doc_id"]: r["source"] for r in rows.select("doc_id", "source").collect()}
    size = defaultdict(int)
    for i, t in cut.items():
        size[source[i]] += len(words(t))
    names = sorted(size)
    for s, goal in zip(names, mixing.targets([size[s] for s in names])):
        own = [i for i in cut if source[i] == s]
        assert all(copies[i] <= 2 for i in own)
        assert abs(sum(copies[i] * len(words(cut[i])) for i in own) - goal) <= 2 * max(len(words(cut[i])) for i in own)


def without(text, spans):
    gone, out, at = {k for s in spans for k in range(s["start"], s["end"])}, [], 0
    starts = [m.start() for m in __import__("re").finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    pieces = [text[: starts[0]]] + [text[a:b] for a, b in zip(starts, starts[1:])]
    if not spans:
        return text
    return "".join([pieces[0], *(p for k, p in enumerate(pieces[1:]) if k not in gone)]).rstrip(" \t\n\v\f\r")


def test_stages_of_odd_rows(spark, docs, no_docs):
    """Null ids and texts, repeated rows, empty tables and clashing columns in every stage."""
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        assert name == "byte_bpe" or made.columns == docs.columns
        made.collect()
        assert stage(spark, no_docs, "").count() == 0
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sum(r["doc_id"] is None for r in near) == 1 and {r["doc_id"] for r in near if r["doc_id"] is not None} == {0, 3, 5}


def test_workers_of_substring_dedup_need_no_pandas():
    """Its import takes some 27 MB of each of the many Python workers of an executor."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import sys, ferrywork.llm.substring; assert 'pandas' not in sys.modules"], check=True, cwd=substring.__file__.split("/ferrywork/")[0])
