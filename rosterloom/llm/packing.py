"""Packing by power-of-two decomposition.

A document of n tokens is cut, front to back, into pieces of the largest
length allowed and then into the binary digits of what is left: 2048 + ... +
1024 + ... + 1. Each piece is a sequence of its own, and sequences of equal
length form a bucket from which batches are drawn. No sequence crosses
documents and none needs padding. The cut is made where the text is read, so
packing needs no shuffle, and the largest row is one sequence.

Null and empty texts are the closing id alone; a text is encoded whole, however
long. Equal rows, and rows of equal or null id, are packed each. An empty table
gives an empty one. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.pretoken import Lexicon, chunk_ids
from rosterloom.llm.textbuf import Chunk, bounded_batches, chunks, trimmed


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """A tokenizers file whose pre-tokens are lower-cased words without white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        signs = _byte_signs()
        model = self._tokenizer.model
        self._lexicon = Lexicon(lambda words: [[t.id for t in model.tokenize("".join([signs[b] for b in w]))] for w in words])

    def whole(self, text: bytes) -> list[int]:
        return self._tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        return chunk_ids(chunk, False, self._lexicon, self.whole)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def forget_tokenizers() -> None:
    """Drops the tokenizers with their tables of seen words, about 100 MB each."""
    _TOKENIZERS.clear()


def binary_cuts(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with so many tokens: each piece's document, start and length."""
    full = counts // longest
    rest = counts % longest
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    has = (rest[:, None] & bits[None, :]) > 0
    docs = np.concatenate([np.repeat(np.arange(len(counts)), full), np.nonzero(has)[0]])
    lengths = np.concatenate([np.full(int(full.sum()), longest, dtype=np.int64), bits[np.nonzero(has)[1]]])
    order = np.argsort(docs, kind="stable")
    docs, lengths = docs[order], lengths[order]
    ends = np.cumsum(lengths)
    doc_starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return docs, ends - lengths - doc_starts[docs], lengths


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of at most ``longest`` tokens (a power of two).

    One row per piece: id_col, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset, and
    bucket (the sequence's length). sequence_id follows the rows' partitions,
    so it is dense within a partition only.
    """
    bounded_batches(df)
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                values, counts = tokenizer.encode(chunk)
                ends = np.cumsum(counts)
                values = np.insert(values, ends, end_id).astype("<u4")
                counts = counts + 1
                docs, starts, lengths = binary_cuts(counts, longest)
                bounds = np.concatenate([[0], np.cumsum(lengths)]) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values.tobytes())])
                key = batch.column(0).slice(chunk.first, chunk.n).take(pa.array(docs))
                yield pa.RecordBatch.from_arrays([key, pa.array(starts), pa.array(lengths), ids, pa.array(counts[docs])], names=[id_col, "start", "length", "ids", "doc_tokens"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # workers are reused by the stages of other operators, which have no use for the table
        try:
            yield from encoded(batches)
        finally:
            forget_tokenizers()

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens"))])
    pieces = df.select(id_col, text_col).mapInArrow(run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes sequences to one folder per bucket, so that batches have one length."""
    packed.write.partitionBy("bucket").parquet(path)
