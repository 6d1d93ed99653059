"""Token counts of whole texts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ferrywork.llm.common import map_batches

#: Bytes of one chunk; longer texts are encoded chunk by chunk.
CHUNK = 16_384
#: Bytes that neighbouring chunks share at first.
OVERLAP = 256


class PieceCounter:
    """Counts of a sentencepiece BPE model.

    A position is a proven stable boundary if a space follows a character that is neither a space nor the space mark:
    when no piece of the vocabulary holds another character before the mark, no merge can ever cross it, so both sides
    are encoded together exactly as alone. `provable` says whether this vocabulary and its normaliser give that proof;
    without it, texts are encoded whole.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(self.MARK in p.lstrip(self.MARK) for p in pieces)
        as_is = "".join(self.model.encode("a  b ﬁ", out_type=str)) == " a  b ﬁ".replace(" ", self.MARK)
        self.provable, self.mark = as_is and not crossing, self.MARK.encode()

    def stable(self, data: bytes, at: int) -> bool:
        return self.provable and 0 < at < len(data) and data[at] == 32 and data[at - 1] != 32 and not data.endswith(self.mark, 0, at)

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def starts(self, data: bytes) -> list[int]:
        """The byte at which each token starts, as the library gives the offsets."""
        return [p.begin for p in self.model.encode(data.decode(), return_type="proto").pieces]


class JsonCounter:
    """Counts of a tokenizers file; its texts are encoded whole (no boundary is proven for an arbitrary pre-tokenizer)."""

    provable = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False))


@lru_cache(2)
def counter(path: str) -> PieceCounter | JsonCounter:
    """One per worker process."""
    return JsonCounter(path) if path.endswith(".json") else PieceCounter(path)


def _at_character(data: bytes, at: int) -> int:
    """The first byte of the character that holds byte `at`."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count(text: str, codec, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the text; equal to encoding it in one piece, whatever chunk and overlap (bytes) are.

    Neighbouring chunks overlap. Both are encoded with offsets; they are spliced at a stable boundary inside the
    overlap where both start a token. If there is none, the overlap is doubled, and once it covers the chunk, the chunk.
    """
    if len(text) <= chunk // 4 or not codec.provable:
        return codec.whole(text)
    data = text.encode()
    if len(data) <= chunk:
        return codec.whole(text)
    start, size, kept_from, total = 0, chunk, 0, 0
    while True:
        end = _at_character(data, start + size) if start + size < len(data) else len(data)
        left = [start + i for i in codec.starts(data[start:end])]
        if end == len(data):
            return total + sum(i >= kept_from for i in left)
        shared, splice = overlap, None
        while splice is None:
            after = max(start + 1, _at_character(data, end - shared))
            if after <= start + 1:
                break
            right = {after + i for i in codec.starts(data[after : end])}
            splice = next((p for p in left if p > max(after, kept_from) and p in right and codec.stable(data, p)), None)
            shared *= 2
        if splice is None:  # no such boundary in the whole chunk: a longer one from the same start
            size *= 2
            continue
        total += sum(kept_from <= i < splice for i in left)
        start, size, kept_from = after, chunk, splice


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No begin, end or added tokens, no truncation. A null text counts as empty (0, 0, false); null keys, repeated rows
    and further columns of any name do no harm: only key and text are read, each row by itself, without a shuffle.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = counter(path)
        texts = pc.fill_null(batch.column(1), "")
        n = pa.array([count(t, codec, chunk, overlap) for t in texts.to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return map_batches(rows, one, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
