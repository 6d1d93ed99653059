"""Token counts, licenses, quality and BPE against their libraries and plain versions."""

import hashlib
import random
import time

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from ferrywork.llm import bpe, licenses, quality, queries, token_counts

D = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "ß", "字", "1", "'s", "'ll", "the", "ing", "😀", "_", "!!", "\N{LOWER ONE EIGHTH BLOCK}", "<s>", "\x00"]


def odd_texts(n, longest=60):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 6), (300, 8), (16_384, 256)])
def test_chunked_counts_equal_whole(chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    codec = token_counts.counter(P.path("piece_bpe_32k.model"))
    assert codec.provable
    for t in odd_texts(1500) + ["x" * 5000, " " * 3000, "word " * 4000]:
        assert token_counts.count(t, codec, chunk, overlap) == len(model.encode(t))


def test_op1(spark):
    model, texts = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), texts_of(spark)
    rows = queries.op1(spark, D).collect()
    assert len(rows) == len(texts)
    assert all((r["n_tokens"], r["n_bytes"]) == (len(model.encode(texts[r["doc_id"]])), len(texts[r["doc_id"]].encode())) for r in rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def test_json_counts():
    assert token_counts.counter(P.path("byte_bpe_50k.json")).whole("hello world") == 2


def test_op9(spark):
    ranks = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks
    library, texts = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), texts_of(spark)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op9(spark, D).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))


def test_bpe_like_library_and_back():
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in odd_texts(4000):
        assert codec.encode(t) == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_appends_and_edits_are_exact():
    codec, rng = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(3)
    word = lambda n: "".join(rng.choice("aehtnoisré") for _ in range(n)).encode()
    for _ in range(200):
        a, b, new = word(rng.randint(0, 60)), word(rng.randint(1, 30)), word(rng.randint(0, 8))
        assert bpe.Prefixes(codec, a).append(b).ids() == bpe.Prefixes(codec, a + b).ids()
        i = rng.randint(0, len(a))
        j = rng.randint(i, len(a))
        table = bpe.Prefixes(codec, a)
        table.edit(i, j, new)
        assert table.ids() == bpe.Prefixes(codec, a[:i] + new + a[j:]).ids()
    table = bpe.Prefixes(codec, word(4000))
    assert table.edit(10, 11, b"z") < 500  # only near the edit


def test_encode_and_decode_documents(docs):
    made = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    back = bpe.decode_documents(made, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((r["text"] or "").encode() for r in docs.collect())


def test_op3(spark):
    words = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low, texts = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)}), texts_of(spark)
    for r in queries.op3(spark, D).collect():
        w, places, labels = words.findall(texts[r["doc_id"]].translate(low)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            own = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_rules():
    assert len(licenses.rules()) > 300
    low = "SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0; see apache.org/licenses/LICENSE-2.0".lower()
    assert [x[2] for x in licenses.detect(low)] == ["mit", "apache-2.0", "apache-2.0"]
    assert licenses.detect("licensed under cc by-nc 4.0")[0][2] == "cc-by-nc-4.0"
    assert licenses.scan("Apache License Apache License")[:4] == (4, 2, 0, 2)
    assert licenses.scan("")[:7] == (0, 0, None, None, "", "", 0.0)


def test_license_forms():
    """Names over line ends and two spaces, expressions with several identifiers, and keywords that occur in what their rules match."""
    labels = lambda text: {x[2] for x in licenses.detect(text.lower())}
    assert labels("licensed under the\n   apache license,  version 2.0") == {"apache-2.0"}
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause") == {"mit", "apache-2.0", "bsd-3-clause"}
    assert labels("Permission to use, copy, modify, and/or\n distribute this software for any purpose") == {"isc"}
    assert labels("do what the fuck you want to public license") == {"wtfpl"} and labels("success accepts") == set()


def test_license_places_are_linear():
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        found = licenses.scan("cc by " * n)
        took.append(time.process_time() - began)
        assert found[:4] == (2 * n, n, 0, 2 * n - 2)
    assert took[1] < 40 * took[0]


def test_op6(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{D}/documents.parquet')")
    df = quality.quality_rules(spark.read.parquet(f"{D}/documents.parquet"))
    answer = db.sql(quality.oracle())
    names = [x[0] for x in answer.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(answer.fetchall())


def repeat_words(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


def test_repeats(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc" if k % 2 else "abcdefghijklmnopqrst") for _ in range(rng.randint(0, 90))) for k in range(120)]
    rows = quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["n_repeat_words"] == repeat_words(texts[r["doc_id"]].split()) for r in rows)


def test_odd_rows(spark, docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    counts = token_counts.count_tokens(docs, path).collect()
    assert len(counts) == 9 and {r["n_tokens"] for r in counts if r["doc_id"] in (0, 1)} == {0}
    assert {tuple(r)[1:] for r in licenses.scan_licenses(docs).drop("spans").collect() if r["doc_id"] == 0} == {(0, 0, None, None, "", "", 0.0)}
    judged = quality.judge(docs)
    assert {r["kept"] for r in judged.where("doc_id in (0, 1, 2, 3)").collect()} == {False}
    assert quality.judge(docs, prefix="_").where("_kept").select(*docs.columns).columns == docs.columns
    assert quality.quality_rules(docs).where("doc_id = 0").first()["base_failed"]
    for made in (token_counts.count_tokens(no_docs, path), licenses.scan_licenses(no_docs), quality.quality_rules(no_docs), bpe.round_trip(no_docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)):
        assert made.count() == 0


def test_a_resting_codec_holds_nothing_and_encodes_alike(monkeypatch):
    """Idle workers stand beside the next stage, so what they remember goes; between slices it stays."""
    monkeypatch.setattr(bpe, "REST", 0.3)
    codec, texts = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), odd_texts(300) * 2
    held = lambda: [len(x) for m in (codec.pieces, codec.after_space, codec.after_line) for x in (m, m.old)] + [len(codec.known), len(codec.child), len(codec.last_of) - 1]
    with codec.at_work():
        first = [codec.encode(t) for t in texts]
        time.sleep(0.6)
        busy = held()
    with codec.at_work():  # at once, before the rest is over
        assert held() == busy and any(busy)
    codec.rest.join(10)
    assert not any(held())
    with codec.at_work():
        assert [codec.encode(t) for t in texts] == first


def test_a_resting_codec_drops_its_tables(monkeypatch):
    """Spark keeps idle workers while any works, so the rank file's tables must not stay beside the next stages."""
    monkeypatch.setattr(bpe, "REST", 0.3)
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    large = lambda: [k for k, v in vars(codec).items() if isinstance(v, (dict, list, set)) and len(v) > 1000]
    with codec.at_work():
        ids = codec.encode("unhappily tokenised")
        assert large()
    codec.rest.join(10)
    assert not large()
    assert codec.encode("unhappily tokenised") == ids and codec.decode(ids) == b"unhappily tokenised"


def test_only_prefixes_that_a_token_leads_to_are_worked_out():
    codec, rng = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(8)
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    words = ["".join(rng.choice("aehtnoisré") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    size = 0
    for word in words:
        before = len(codec.child)
        assert codec.encode(word) == library.encode_ordinary(word)
        size += len(codec.child) - before
    assert size < 0.7 * sum(len(w.encode()) for w in words)
