"""Packing of documents into training sequences (operator 2).

Method: power-of-two decomposition. A document's ids (with one end id) are cut into pieces of
``limit`` ids and, for the rest, into pieces whose lengths are the powers of two of its binary
form, longest first. Each piece is a sequence of its own; sequences of equal length form a bucket,
from which batches of one shape are drawn, so no sequence crosses documents and none is padded.

Ids come from a native encoder built from the same vocabulary file, asked once for each stretch of
text between spaces that a worker has not met lately.

Nothing is shuffled: pieces come from the task that encodes their document. ``sequence_id`` is the
task's number and a counter in it, which a rerun of a lost task gives again. Memory: one batch of
documents.

Cases: null and empty texts are one piece holding only the end id; a null document id stays null;
repeated documents are packed again with sequences of their own.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from siftline.llm.bpe import SPLIT, Encoder, map_texts

LIMIT = 1024
END_ID = 0


class NativeEncoder(Encoder):
    """An encoder whose merges run in native code: a merge's rank is the order of its result's id."""

    def __init__(self, content: str):
        super().__init__(content)
        ranks = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.native = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, chunks: list[str], lead: str) -> list[bytes]:
        encode = self.native.encode_ordinary
        return [array("I", encode(lead + c)).tobytes() for c in chunks]


def lengths_of(n: int, limit: int) -> list[int]:
    """``limit`` as often as it goes, then the binary form of what is left."""
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if (n % limit) >> b & 1]


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: id_col, start, length (its bucket), ids_crc32, doc_tokens, sequence_id,
    offset, and the ids themselves (``with_ids``). ``limit`` is a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    kind = dict(docs.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")

    def make(encoder, texts, batch):
        at, start, length, crc, total, ids = [], [], [], [], [], []
        for i, found in enumerate(encoder.encode_many(texts)):
            own = memoryview(found + end)
            n, pos = len(own) // 4, 0
            for size in lengths_of(n, limit):
                piece = own[4 * pos : 4 * (pos + size)]
                at.append(i)
                start.append(pos)
                length.append(size)
                crc.append(zlib.crc32(piece))
                total.append(n)
                pos += size
            ids.append(own)
        columns = [batch.column(1).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    out = map_texts(docs, vocabulary, text_col, [id_col], schema, make, NativeEncoder)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences by length, a folder for each bucket: readers of one folder get batches of one shape."""
    packed.write.partitionBy("length").parquet(path)
