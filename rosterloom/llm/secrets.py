"""Secret scans: keyword automaton, anchored expressions, checksum validation.

One Aho-Corasick pass over the lower-cased bytes finds the keywords; the
expressions are tried only at those places, anchored, from left to right and
never inside an earlier match of the same kind. Long hexadecimal runs have no
keyword: their candidates come from run lengths found with array operations.
Tokens that embed a checksum (a fixed prefix, a random part in base 62, and the
CRC-32 of that part as six base-62 digits) are reported as ``checksum`` only
when the checksum is right.

Spans are in code points, end exclusive. Null and empty texts have none; a text is
scanned whole, however long. Equal rows give equal results, an empty table an
empty one. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rosterloom.llm.textbuf import LOWER, Chunk, bounded_batches, chunks

#: Kinds in their order within equal starts.
KINDS = ("assign", "access", "hex", "checksum")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MARKED = re.compile(rb"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Keyword and the kind its expression belongs to.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checksum", "gho_": "checksum", "ghu_": "checksum", "ghs_": "checksum", "ghr_": "checksum", "npm_": "checksum",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True


def checksum62(body: bytes) -> bytes:
    """CRC-32 of body as six base-62 digits."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out.encode()


def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def _passes(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= 8
    if kind == "access":
        return found.end() - found.start() >= 16
    return checksum62(found[2]) == found[3]


_EXPRESSIONS = {"assign": _ASSIGN, "access": _ACCESS, "checksum": _MARKED}


class Scanner:
    def __init__(self) -> None:
        self._machine = _automaton()

    def _keyword_spans(self, chunk: Chunk) -> Iterator[tuple[int, int, int]]:
        """Row, kind, start and end, in bytes of the row."""
        lower = LOWER[chunk.data].tobytes().decode("latin-1")
        raw = chunk.data.tobytes()
        hits = [(end + 1 - size, kind) for end, (kind, size) in self._machine.iter(lower)]
        if not hits:
            return
        places = np.array([h[0] for h in hits])
        rows = chunk.row_of(places)
        last: dict[str, int] = {}
        for k in np.argsort(places, kind="stable").tolist():
            start, kind = hits[k]
            if start < last.get(kind, 0):
                continue
            stop = int(chunk.offsets[rows[k] + 1])
            found = _EXPRESSIONS[kind].match(raw, start, stop)
            if found:
                last[kind] = found.end()
                if _passes(kind, found):
                    yield int(rows[k]), KINDS.index(kind), start, found.end()

    def spans(self, chunk: Chunk) -> list[list[tuple[int, int, int]]]:
        """For each row its (start, kind number, end) in code points, in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
        if not len(chunk.data):
            return out
        found = list(self._keyword_spans(chunk))
        starts, ends, rows = chunk.runs(_HEX[chunk.data])
        long = ends - starts >= 32
        found += zip(rows[long].tolist(), [KINDS.index("hex")] * int(long.sum()), starts[long].tolist(), ends[long].tolist(), strict=True)
        if not found:
            return out
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        for row, kind, start, end in found:
            base = points[chunk.offsets[row]]
            out[row].append((int(points[start] - base), kind, int(points[end] - base)))
        for spans in out:
            spans.sort()
        return out


_SCANNER: list[Scanner] = []


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and spans array<struct<kind,start,end>> in order of start, then kind."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in row] for row in _SCANNER[0].spans(chunk)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(spans, type=kind_type)], names=[id_col, "spans"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))])
    return df.select(id_col, text_col).mapInArrow(run, schema)
