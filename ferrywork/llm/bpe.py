"""Byte-level BPE encoding and decoding by prefix dynamic programming."""

from __future__ import annotations

import base64
import hashlib
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, partial
from sys import getsizeof

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ferrywork.llm.common import give_back, map_batches

#: White space as the rank files' library defines it (Unicode White_Space); Python's \s holds four characters more.
WHITE = "\t-\r \x85\xa0" + chr(0x1680) + f"{chr(0x2000)}-{chr(0x200A)}" + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Bytes of stretches and their ids that one worker remembers, in two generations together; bytes of a place in a dict.
REMEMBERED, PLACE = 72_000_000, 64
#: Marks (one byte each) of what was asked once; beyond half of them they are cleared.
MARKS = 1 << 21
#: Seconds without work after which a worker forgets all that and drops its tables. Spark keeps idle workers as long as
#: any of them works, beside stages that need the memory; the tasks of one stage follow each other faster.
REST = 2.0


#: ASCII marks that end a run of letters and, one or more, are a match of the pattern; the apostrophe may begin others.
MARKED = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


class Memo(dict):
    """A dict that computes what it lacks and remembers what was asked twice, so that rare keys take no room.

    When its half of the bytes is used up, its entries become the old generation; those used again return, so what is
    frequent stays however much text goes by.
    """

    def __init__(self, compute, limit: int = REMEMBERED, longest: int = 64):
        self.compute, self.half, self.longest = compute, limit // 2, longest
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.old, self.room, self.marks, self.marked = {}, self.half, bytearray(MARKS), 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            at = hash(key) & MARKS - 1
            if not self.marks[at]:
                self.marks[at], self.marked = 1, self.marked + 1
                if self.marked > MARKS // 2:
                    self.marks, self.marked = bytearray(MARKS), 0
                return value
        if len(key) <= self.longest:
            if self.room < 0:
                self.old = self.copy()
                self.clear()
                self.room = self.half
            self.room -= getsizeof(key) + getsizeof(value) + PLACE
            self[key] = value
        return value


#: Prefixes and pairs of tokens that one worker remembers (some 100 bytes each); beyond it starts anew.
PREFIXES, PAIRS = 250_000, 150_000
#: Lengths of tokens to try where no longer token ends in the last four bytes.
SHORT = (4, 3, 2, 1)
#: Attributes of a codec that its rank file gives, some 30 MB together.
TABLES = ("ranks", "tokens", "names", "by_name", "sizes", "longest", "lengths")


class Prefixes:
    """The table of one byte string: for each prefix, the unique last token of its encoding.

    The encoding of a prefix that ends in token t is the encoding of the prefix before t, then t; t fits exactly if the
    pair (last token before, t) stays apart when merged. So one token a prefix holds every encoding, appends are exact,
    and after an edit only prefixes near it change.
    """

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        if data:
            self.append(data)

    def append(self, more: bytes) -> Prefixes:
        self.data += more
        self._extend(len(self.data), None)
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces data[start:end]; returns how many prefixes were worked out anew."""
        old, cut = self.last, end
        shift = len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        return self._extend(len(self.data), (old, start + len(new), shift)) if cut <= len(old) else 0

    def _extend(self, to: int, before) -> int:
        """With `before`, stops as soon as as many prefixes in a row agree with the old table as a token can be long."""
        codec, data, last = self.codec, self.data, self.last
        ranks, known, fits, alone, longest, lengths = codec.ranks.get, codec.known.get, codec.fits, codec.alone, codec.longest, codec.lengths.get
        agreed, first = 0, len(last)
        for e in range(first + 1, to + 1):
            for n in lengths(data[e - 4 : e], SHORT) if e > 3 else SHORT:
                if n > e:
                    continue
                s = e - n
                t = ranks(data[s:e])
                if t is None:
                    continue
                if s == 0:
                    ok = alone(t)
                elif (ok := known(last[s - 1] << 32 | t)) is None:
                    ok = fits(last[s - 1], t)
                if ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"byte {data[e - 1]} has no token")
            if before:
                old, edited, shift = before
                agreed = agreed + 1 if e > edited and old[e - 1 - shift] == last[-1] else 0
                if agreed > longest:
                    last.extend(old[e - shift :])
                    return e - first
        return to - first

    def ids(self) -> list[int]:
        out, e = [], len(self.last)
        while e:
            out.append(self.last[e - 1])
            e -= len(self.codec.tokens[out[-1]])
        return out[::-1]


class Codec:
    """A rank file. encode() gives what merging by rank gives, decode() the bytes again."""

    def __init__(self, path: str, pattern: str):
        self.path = path
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s+(?!\S)", f"[{WHITE}]+(?![^{WHITE}])").replace(r"\s+", f"[{WHITE}]+"))
        self.spaces = re.compile(f" (?=[^{WHITE}])")
        self.white = re.compile(f"[{WHITE}]").search
        self.lines = re.compile(f"(?<=[^{WHITE}])\n(?=[^{WHITE}])")
        self.known: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self.last_of: dict[bytes, int] = {b"": -1}
        self.pieces = Memo(self._piece, REMEMBERED // 4)
        self.after_space = Memo(partial(self._stretch, " "))
        self.after_line = Memo(partial(self._stretch, ""), REMEMBERED // 4)
        self.line_end = f",{self._piece(chr(10))},"
        self.lock, self.rest = threading.Lock(), None

    def __getattr__(self, name: str):
        """The tables of the rank file are read when one is asked for, and again after a rest."""
        if name not in TABLES:
            raise AttributeError(name)
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = {t: b for b, t in ranks.items()}
        names = {t: str(t) for t in tokens}
        made = (ranks, tokens, names, {names[t]: b for t, b in tokens.items()}, {t: len(b) for t, b in tokens.items()}, max(map(len, ranks)), self._lengths(ranks))
        tables = dict(zip(TABLES, made, strict=True))
        self.__dict__.update(tables)
        return tables[name]

    @contextmanager
    def at_work(self) -> Iterator[Codec]:
        """What it remembers stays meanwhile, and goes REST seconds after the last of these ends."""
        with self.lock:
            if self.rest:
                self.rest.cancel()
            try:
                yield self
            finally:
                self.rest = threading.Timer(REST, self._rested)
                self.rest.daemon = True
                self.rest.start()

    def _rested(self) -> None:
        with self.lock:
            if self.rest is threading.current_thread():  # else work came in between
                self.forget()
                for name in TABLES:
                    self.__dict__.pop(name, None)
                give_back()

    def forget(self) -> None:
        """Empties all that is only remembered; what is asked again is worked out again."""
        for memo in (self.pieces, self.after_space, self.after_line):
            memo.forget()
        self.known.clear()
        self._split.clear()
        self._forget_prefixes()

    def _forget_prefixes(self) -> None:
        self.last_of.clear()
        self.last_of[b""] = -1

    @property
    def child(self) -> set[bytes]:
        """The prefixes remembered, beside the empty one that they grow from."""
        return self.last_of.keys() - {b""}

    @staticmethod
    def _lengths(ranks: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
        """Lengths, longest first, of the tokens that end in given four bytes, besides the short ones."""
        found: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 4:
                found.setdefault(token[-4:], set()).add(len(token))
        return {end: (*sorted(lengths, reverse=True), *SHORT) for end, lengths in found.items()}

    def _stretch(self, space: str, stretch: str) -> str:
        """Ids of a stretch without white space that follows `space`. Letters alone are one match of the pattern, with
        the space; marks after them are one more."""
        if stretch.isalpha():
            return self._piece(space + stretch)
        letters = stretch.rstrip(MARKED)
        if len(letters) < len(stretch) and letters.isalpha():
            return f"{(self.after_space if space else self.after_line)[letters]},{self.pieces[stretch[len(letters) :]]}"
        return ",".join(map(self.pieces.__getitem__, self.pattern.findall(space + stretch)))

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost among equals; stops before the last merge that leaves one part."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte, (-1, -1) if merging never reaches t."""
        if t not in self._split:
            parts = self.merged(self.tokens[t])
            self._split[t] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self._split[t]

    def alone(self, t: int) -> bool:
        return self.split(t) != (-1, -1)

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes are merged together.

        Merges inside a and b and the one across run in order of rank. Take the merges of both sides back, latest
        first, and look at the pair that touches across: if it has a token of a lower rank than the merge that would
        use up one of its sides, it merges first, and a, b never come to be. Equal ranks go to the leftmost pair.
        """
        if (known := self.known.get(a << 32 | b)) is not None:
            return known
        if len(self.known) > PAIRS:
            self.known.clear()
        x, y, ok = a, b, self.alone(a) and self.alone(b)
        until = 1 << 60  # the rank at which x or y is used up by a merge inside its own side; across must come before it
        while ok:
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and across < until:
                ok = False
                break
            sx, sy = self.split(x), self.split(y)
            if sx is None and sy is None:
                break
            if sy is None or (sx is not None and x > y):  # x came last: before it, its right half touched y
                until, x = x, sx[1]
            else:  # y came last; at an equal rank the pair across is further left and goes first
                until, y = y + 1, sy[0]
        self.known[a << 32 | b] = ok
        return ok

    def _last(self, prefix: bytes) -> int:
        """The last token of a prefix; of the prefixes before it only those are worked out that a token leads to."""
        n, ranks, last_of = len(prefix), self.ranks.get, self.last_of
        for k in self.lengths.get(prefix[-4:], SHORT):
            if k < n:
                t = ranks(prefix[n - k :])
                if t is None:
                    continue
                before = prefix[: n - k]
                a = last_of.get(before)
                if a is None:
                    a = last_of[before] = self._last(before)
                ok = self.known.get(a << 32 | t)
                if self.fits(a, t) if ok is None else ok:
                    return t
            elif k == n and (t := ranks(prefix)) is not None and self.alone(t):
                return t
        raise ValueError(f"byte {prefix[-1]} has no token")

    def _piece(self, piece: str) -> str:
        """Ids of one match of the pattern: its last token, that of the prefix before, and so on; long ones by a table."""
        data = piece.encode()
        t = self.ranks.get(data)
        if t is not None and self.alone(t):
            return self.names[t]
        if len(data) > 64:
            return ",".join(map(self.names.__getitem__, Prefixes(self, data).ids()))
        last_of, names, sizes, out = self.last_of, self.names, self.sizes, []
        if len(last_of) > PREFIXES:
            self._forget_prefixes()
        while data:
            t = last_of.get(data)
            if t is None:
                t = self._last(data)
            out.append(names[t])
            data = data[: -sizes[t]]
        out.reverse()
        return ",".join(out)

    def encode_joined(self, text: str) -> str:
        """Decimal ids, joined by commas.

        A space before a character that is no white space always starts a match of the pattern, and a single end of
        line between two such characters is one, so the text is cut there and the ids of frequent stretches are
        remembered.
        """
        return self.line_end.join(map(self._line, self.lines.split(text))) if text else ""

    def _line(self, line: str) -> str:
        first, *rest = self.spaces.split(line)
        if first and not self.white(first):
            start = [self.after_line[first]]
        else:
            start = [",".join(map(self.pieces.__getitem__, self.pattern.findall(first)))] if first else []
        return ",".join([*start, *map(self.after_space.__getitem__, rest)])

    def encode(self, text: str) -> list[int]:
        return list(map(int, filter(None, self.encode_joined(text).split(","))))

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.by_name.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, ids (array<int>). A null text is empty: no ids. Rows are independent; nothing is shuffled."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        with codec(path, pattern).at_work() as c:
            ids = [c.encode(t) for t in pc.fill_null(batch.column(1), "").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(_rows(docs, text, key), one, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, data (binary): the bytes of the ids; null ids give no bytes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        with codec(path, pattern).at_work() as c:
            data = [c.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return map_batches(encoded.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"`{ids}` as ids"), one, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes each whole text, decodes the ids and returns digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same codec as encode_documents and decode_documents, without moving the ids between processes. Null texts are
    empty ones: n_tokens 0 and the digests of nothing. Null keys and repeated rows stay, each with its own row.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        with codec(path, pattern).at_work() as c:
            for t in pc.fill_null(batch.column(1), "").to_pylist():
                ids = c.encode_joined(t)
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(c.decode_joined(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(_rows(docs, text, key), one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
