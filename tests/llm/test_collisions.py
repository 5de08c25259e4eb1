"""Texts whose polynomial hashes modulo 2**64 would collide: Thue-Morse strings
and their complements, of 1 to 8 kB, through every operator that hashes."""

import collections

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from rosterloom.llm import bpe, packing, quality, repeats, shingle_join, token_counts, toxicity
from rosterloom.llm.pretoken import Lexicon
from rosterloom.llm.scratch import Scratch
from rosterloom.llm.textbuf import LONG_SLICE, chunks, slice_hashes

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
SIZES = [1024, 2048, 4096, 8192]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


PAIRS = [t for n in SIZES for t in (thue_morse(n), thue_morse(n, "b", "a"))]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [8, 16, 64, 128, 256, *SIZES])
def test_slices(n):
    data = np.frombuffer((thue_morse(n) + thue_morse(n, "b", "a") + thue_morse(n)).encode(), dtype=np.uint8)
    h = slice_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]


def test_slices_of_every_length():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3500, 20_000)
    sizes = rng.integers(0, 2 * LONG_SLICE, 20_000)
    h = slice_hashes(data, starts, starts + sizes)
    by_text, by_hash = {}, {}
    for a, n, x in zip(starts, sizes, h, strict=True):
        text = data[a : a + n].tobytes()
        assert by_text.setdefault(text, x) == x and by_hash.setdefault(int(x), text) == text


def test_lexicon_compares_what_it_stores():
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [[len(p), *p] for p in pieces]

    lexicon = Lexicon(encode, slots=4, pool=600)  # every slot is fought over
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(1, 300, 60)]
    for _ in range(20):
        some = [words[i] for i in rng.integers(0, len(words), 40)]
        data = np.frombuffer("".join(some).encode(), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in some])
        values, counts = lexicon.ids(data, ends - [len(w) for w in some], ends)
        assert [v.tolist() for v in np.split(values, np.cumsum(counts)[:-1])] == [[len(w), *w.encode()] for w in some]
    assert len(asked) < 800


def test_tokens(spark):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    docs = frame(spark, PAIRS).coalesce(1)  # one worker sees them all
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {i: tik.encode_ordinary(t) for i, t in enumerate(PAIRS)}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {i: t.encode() for i, t in enumerate(PAIRS)}
    lines = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, RANKS, P.PATTERN).collect() if r.section_no == 0}
    assert lines == {i: len(tik.encode_ordinary(t)) for i, t in enumerate(PAIRS)}
    hf = Tokenizer.from_file(WORDS)
    parts = collections.defaultdict(list)
    for r in packing.pack(docs, WORDS).collect():
        parts[r.doc_id].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
    got = {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()}
    assert got == {i: [*hf.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(PAIRS)}


def test_joins_and_lines(spark):
    found = shingle_join.jaccard_classes(frame(spark, PAIRS), Scratch(spark), n=4, num=85, sketch_bits=12).collect()
    assert all(r.component_id == r.class_id == r.doc_id and r.n_shingles == 1 for r in found)
    assert repeats.find_repeats(frame(spark, PAIRS), Scratch(spark)).count() == 0
    for chunk in chunks(pa.array(["\n".join(PAIRS)])):
        assert quality.base_columns(chunk)["n_dup_lines"].tolist() == [0]
    for chunk in chunks(pa.array([" ".join(PAIRS)])):
        assert len(set(toxicity.word_hashes(chunk)[0].tolist())) == len(PAIRS)
