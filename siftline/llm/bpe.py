"""Byte-level BPE encoding and decoding (operator 9).

Method: the symbols of a pre-token are a doubly linked list; a priority queue holds the merge ranks
of adjacent pairs, and entries whose symbols have changed since are skipped when they come up.
Decoding concatenates vocabulary strings and maps their characters back to bytes.

Texts are cut into pre-tokens by the pattern of the vocabulary. The new pre-tokens of a few MB of
texts are merged in step, each with its own list and queue (a row of an array), so that no text pays
for a merge that a worker has done before: it keeps what it has met in tables of bounded size, whose
older half is forgotten when they are full. With a stretch of text between spaces it keeps what the
result is made of (ids, or decimal ids and decoded bytes).

Cases: null text counts as empty (no ids); empty text has no ids; the strings of special tokens in
a text become the ids of these tokens, as the vocabulary's own library does; texts of any length are
encoded whole; repeated rows give repeated results; extra input columns are left out unless asked
for with ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from siftline.llm.textops import slices
from siftline.session import ship

#: The split pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after a character that is no white space always starts a pre-token, so what stands on
#: either side of it can be encoded apart.
_CUT = re.compile(r"(?<=\S) ")
_NO_CUT = re.compile(r"\s ")  # a text without these can be cut at every space
TABLE_ENTRIES = 300_000
BATCH = 4 << 20  # bytes of text that are encoded together
WIDTHS = (4, 8, 16, 32, 64)  # pre-tokens up to so many bytes are merged together
_workers: dict[str, Encoder] = {}


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary strings, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table(dict):
    """What ``make`` gives for sets of keys. When more than ``size`` are held, a new generation begins,
    into which only keys asked for again are carried over; keys of over ``LONG`` letters stay for one call."""

    LONG = 64

    def __init__(self, make: Callable[[list[str]], Iterable], size: int = TABLE_ENTRIES):
        super().__init__()
        self.make, self.size, self.older, self.passing = make, size, {}, []

    def hold(self, keys: set[str]) -> None:
        """Makes all of ``keys`` present until the next call."""
        for k in self.passing:
            self.pop(k, None)
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        old = new.intersection(self.older)
        for k in old:
            self[k] = self.older[k]
        new -= old
        self.passing = [k for k in new if len(k) > self.LONG]
        new = list(new)
        self.update(zip(new, self.make(new)))


class Encoder:
    """Encodes and decodes with a vocabulary file's content (JSON text of a byte-level BPE)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_chars()
        self.strings = {i: s for s, i in vocab.items()}
        self.bytes_of = {i: bytes(map(chars.__getitem__, s)) if all(c in chars for c in s) else s.encode() for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        # a pair is named by one number; a merge by its rank, which leads to the merged id
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 20 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.of_bytes = [self.ranks.get(a << 20 | b, -1) for a in self.of_byte for b in self.of_byte]
        self.pattern = regex.compile(SPLIT)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids, self.byte_pairs, self.merged_ids = np.array(self.of_byte), np.array(self.of_bytes), np.array(self.merged)
        pairs = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(pairs)
        self.pair_keys, self.pair_ranks = pairs[order], np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order]
        self.tokens = Table(self._tokens)
        self.firsts = Table(lambda chunks: self._chunks(chunks, ""))
        self.spaced = Table(lambda chunks: self._chunks(chunks, " "))

    def merge(self, raw: bytes) -> list[int]:
        """The ids that are left of a pre-token's bytes when the pair of least rank (leftmost first)
        is merged until there is none."""
        n, rank_of, merged_of, of_bytes = len(raw), self.ranks.get, self.merged, self.of_bytes
        symbols = [self.of_byte[b] for b in raw]
        # the rank of the pair that begins at each symbol as things stand; -1 where it can't be merged
        now = [of_bytes[a << 8 | b] for a, b in zip(raw, raw[1:])]
        now.append(-1)
        queue = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != rank:
                continue  # stale: one of the two has been merged since
            j = after[i]
            symbols[i] = merged = merged_of[rank]
            symbols[j] = now[j] = now[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = rank = rank_of(merged << 20 | symbols[k], -1)
                if rank >= 0:
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                now[h] = rank = rank_of(symbols[h] << 20 | merged, -1)
                if rank >= 0:
                    heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def merge_many(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge` of many pre-tokens: all ids, and where each one's begin. The queues of pre-tokens
        of like length are rows of one array, and every step takes the least entry of each row."""
        size = np.array([len(t) for t in tokens], np.int64)
        count, parts = np.zeros(len(tokens), np.int64), []
        for low, width in zip((0, *WIDTHS), WIDTHS):
            own = np.flatnonzero((size > low) & (size <= width))
            for at in range(0, len(own), 1 << 16):
                rows = own[at : at + (1 << 16)]
                raw = np.frombuffer(b"".join([tokens[r].ljust(width, b"\0") for r in rows.tolist()]), np.uint8).reshape(len(rows), width)
                symbols = self._merged_rows(raw, size[rows])
                left = symbols >= 0
                count[rows] = left.sum(1)
                parts.append((rows, symbols[left]))
        for r in np.flatnonzero(size > WIDTHS[-1]).tolist():
            ids = self.merge(tokens[r])
            count[r] = len(ids)
            parts.append((np.array([r]), np.array(ids)))
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(begin[-1], np.int64)
        for rows, ids in parts:
            n = count[rows]
            out[np.arange(len(ids)) + np.repeat(begin[rows] - (np.cumsum(n) - n), n)] = ids
        return out, begin

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def _merged_rows(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[pre-token, place]: ids, -1 where a symbol has been merged away."""
        n, width = raw.shape
        place, none = np.arange(width), np.iinfo(np.int64).max
        inside = place < size[:, None]
        symbols = np.where(inside, self.byte_ids[raw], -1)
        out = symbols.copy()
        now = np.full((n, width + 1), -1)
        now[:, : width - 1] = np.where(inside[:, 1:], self.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], -1)
        queue = np.full((n, 3 * width), none)
        queue[:, :width] = np.where(now[:, :width] >= 0, now[:, :width] << 8 | place, none)
        symbols = np.pad(symbols, ((0, 0), (0, 1)), constant_values=-1)  # the place after the last one
        before = np.tile(np.arange(-1, width), (n, 1))
        after = np.where(place + 1 < size[:, None], place + 1, width)
        free, where, every = np.full(n, width), np.arange(n), np.arange(n)
        while len(every):
            slot = queue.argmin(1)
            entry = queue[every, slot]
            open_ = entry < none
            if open_.sum() < 0.7 * len(every):  # rows that are done leave
                out[where] = symbols[:, :width]
                symbols, now, queue, before, after, free, where, slot, entry = (x[open_] for x in (symbols, now, queue, before, after, free, where, slot, entry))
                every, open_ = np.arange(len(where)), np.ones(len(where), bool)
            queue[every, slot] = none
            i, rank = entry & 255, entry >> 8
            r = np.flatnonzero(open_ & (now[every, np.minimum(i, width)] == rank))  # others are stale: merged since
            i, rank = i[r], rank[r]
            j, merged = after[r, i], self.merged_ids[rank]
            symbols[r, i], symbols[r, j], now[r, j] = merged, -1, -1
            k = after[r, j]
            after[r, i], before[r, k] = k, i
            for left, right, at in ((merged, symbols[r, k], i), (symbols[r, before[r, i]], merged, before[r, i])):
                new = np.where(at >= 0, self._rank(left, right), -1)
                now[r[at >= 0], at[at >= 0]] = new[at >= 0]
                p = new >= 0
                queue[r[p], free[r[p]]] = new[p] << 8 | at[p]
                free[r[p]] += 1
        out[where] = symbols[:, :width]
        return out

    def _values(self, ids: np.ndarray, begin: np.ndarray) -> list:
        """What is kept of each pre-token: its ids as little-endian unsigned 32-bit numbers."""
        raw, at = ids.astype("<u4").tobytes(), (4 * begin).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _joined(self, values: list):
        return b"".join(values)

    def _tokens(self, tokens: list[str]) -> list:
        return self._values(*self.merge_many([t.encode() for t in tokens]))

    def _chunks(self, chunks: list[str], lead: str) -> list:
        # a space and ASCII letters are one pre-token
        cut = [[lead + c] if c.isascii() and c.isalpha() else self.pattern.findall(lead + c) for c in chunks]
        self.tokens.hold(set(chain.from_iterable(cut)))
        token = self.tokens.__getitem__
        return [token(x[0]) if len(x) == 1 else self._joined([token(t) for t in x]) for x in cut]

    def parts(self, texts: list[str | None]) -> list[list]:
        """For each text what is kept of its stretches between spaces and of its special tokens, in order."""
        stretches: list[list[tuple[str, str | list[str]]]] = []
        for text in texts:
            some = [text] if text else []
            if text and self.cut_special is not None and any(s in text for s in self.special):
                some = self.cut_special.split(text)
            stretches.append([(part, "") if i % 2 else (part, self._cut(part)) for i, part in enumerate(some) if part])
        cuts = [words for own in stretches for _, words in own if words]
        self.firsts.hold({w[0] for w in cuts if w[0]})
        self.spaced.hold(set(chain.from_iterable(islice(w, 1, None) for w in cuts)))
        first, spaced, out = self.firsts.__getitem__, self.spaced.__getitem__, []
        for own in stretches:
            found = []
            for part, words in own:
                if not words:
                    found += self._values(np.array([self.special[part]]), np.array([0, 1]))
                    continue
                if words[0]:
                    found.append(first(words[0]))
                found += map(spaced, islice(words, 1, None))
            out.append(found)
        return out

    def _cut(self, text: str) -> list[str]:
        return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        return [b"".join(p) for p in self.parts(texts)]

    def encode(self, text: str | None) -> array:
        return array("I", self.encode_many([text])[0])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Digests(Encoder):
    """Keeps with each stretch of text its decimal ids and the bytes of its vocabulary strings, so that
    a document's digests are made of joined parts without a step for each id."""

    def _values(self, ids: np.ndarray, begin: np.ndarray) -> list[tuple[str, bytes]]:
        shown, raw, at = list(map(str, ids.tolist())), list(map(self.bytes_of.__getitem__, ids.tolist())), begin.tolist()
        return [(",".join(shown[a:b]), b"".join(raw[a:b])) for a, b in zip(at, at[1:])]

    def _joined(self, values: list) -> tuple[str, bytes]:
        return ",".join([v[0] for v in values]), b"".join([v[1] for v in values])

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, and digests of the decimal ids and of the decoded text."""
        for parts in self.parts(texts):
            ids, raw = self._joined(parts)
            text = raw.decode("utf-8", "replace")
            yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encoder_of(content: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder for each vocabulary, kind and worker."""
    key = f"{kind.__name__} {hashlib.md5(content.encode(), usedforsecurity=False).hexdigest()}"
    if key not in _workers:
        _workers[key] = kind(content)
    return _workers[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def map_texts(docs: DataFrame, vocabulary: str, text_col: str, keep: list[str], schema: str, make: Callable[[Encoder, list[str | None], pa.RecordBatch], pa.RecordBatch], kind: type[Encoder] = Encoder) -> DataFrame:
    """Runs ``make`` on Arrow batches with the worker's encoder. The vocabulary (a fixed file of one
    or two MB) is broadcast; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    content = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value, kind)
        for batch in batches:
            for part, _, _ in slices(batch, 0, BATCH):
                yield make(encoder, part.column(0).to_pylist(), part)

    return docs.select(F.col(text_col).alias("__text"), *keep).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids array<int>, decoded string: the ids of each whole text and their decoding."""
    kind = dict(docs.dtypes)[id_col]

    def make(encoder, texts, batch):
        ids = [np.frombuffer(x, "<u4") for x in encoder.encode_many(texts)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())], [id_col, "ids", "decoded"])

    return map_texts(docs, vocabulary, text_col, [id_col], f"`{id_col}` {kind}, ids array<int>, decoded string", make)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 of :func:`encode`'s columns, taken where they are made."""
    kind = dict(docs.dtypes)[id_col]

    def make(encoder, texts, batch):
        n, ids_sha, text_sha = zip(*encoder.digests(texts))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs, vocabulary, text_col, [id_col], f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, Digests)
