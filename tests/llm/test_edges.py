"""Very long texts, models against brute force, queries against their SQL."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterloom.llm import bpe, packing, pii, quality, queries, repeats, secrets, shingle_join, spans, token_counts, toxicity
from rosterloom.llm.scratch import Scratch
from rosterloom.llm.textbuf import CHUNK_BYTES, chunks

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
TAIL = " mail zz@y.example.org token=abcdefgh12 deadbeefdeadbeefdeadbeefdeadbeef\nthe end of it all"


def long_text(seed, size=1_600_000):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(size // 6)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, len(words), 12)) + TAIL


@pytest.fixture(scope="module")
def docs(spark):
    texts = [long_text(1), "short\nthe end of it all", long_text(1), long_text(2, 2_500_000)]
    assert len(texts[0]) > CHUNK_BYTES
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def test_long_texts_encode(spark, docs):
    texts, df = docs
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    want = {i: tik.encode_ordinary(t) for i, t in enumerate(texts)}
    encoded = bpe.encode(df, RANKS, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == want
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()} == dict(enumerate(texts))
    counts = token_counts.count_tokens(df, RANKS, P.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("section_no").alias("s")).collect()
    assert {r.doc_id: (r.n, r.s) for r in counts} == {i: (len(want[i]), texts[i].count("\n")) for i in want}
    packed = packing.pack(df, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in packed) and packed[0].n > 100_000 or len(packed) == 4


def test_long_texts_scan(spark, docs):
    texts, df = docs
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(df).collect()}
    assert all([texts[i][a:b] for _, a, b in found[i]] == ["token=abcdefgh12", "deadbeef" * 4] for i in (0, 2, 3)) and found[1] == []
    private = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] for r in pii.find_pii(df, Scratch(spark)).collect()}
    assert all([texts[i][a:b] for _, a, b in private[i]] == ["zz@y.example.org"] for i in (0, 2, 3))
    left = {r.doc_id: re.findall("[a-z0-9]+", r.text) for r in repeats.drop_repeats(df, Scratch(spark)).collect()}
    assert left[2] == [] and left[1] == ["short"] and left[0] == re.findall("[a-z0-9]+", texts[0]) and len(left[3]) > 300_000
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r for r in quality.score_quality(df, labels).collect()}
    assert all(kept[i].n_words == len(texts[i].split()) for i in kept)
    assert toxicity.grade_toxicity(df, toxicity.train(df, labels)).where("kept").count() == 4
    assert {r.doc_id: r.component_id for r in shingle_join.jaccard_classes(df, Scratch(spark), sketch_bits=12).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}


def test_many_entities_in_one_text(spark):
    """Time near linear in matches: 60,000 addresses would take minutes if each copied the list."""
    n = 60_000
    df = spark.createDataFrame([(0, "u@h.org " * n)], "doc_id long, text string")
    row = df.select(F.size(pii.base_spans(F.col("text"))).alias("n"), F.col("text").alias("text"), pii.base_spans(F.col("text")).alias("s"))
    out = row.select("n", pii.rewrite(F.col("text"), F.col("s"), F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("t")).first()
    assert out.n == n and out.t == "[EMAIL] " * n


def test_span_functions(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab𝒳é ") for _ in range(rng.randrange(0, 1200))) for _ in range(40)]
    cuts = []
    for t in texts:
        at, some = 0, []
        while at < len(t):
            a = at + rng.randrange(0, 300)
            b = min(a + rng.randrange(1, 40), len(t))
            if a < b:
                some.append((a, b, "#"))
            at = max(a, b)
        cuts.append(some)
    df = spark.createDataFrame(list(zip(texts, cuts, strict=True)), "t string, s array<struct<start:int,end:int,mark:string>>")
    for r in df.select("t", "s", spans.replaced(F.col("t"), F.col("s")).alias("out"), spans.running(F.transform("s", lambda x: x["end"] - x["start"]), lambda a, b: a + b).alias("sums")).collect():
        want, at = "", 0
        for x in r.s:
            want, at = want + r.t[at : x.start] + x.mark, x.end
        assert r.out == want + r.t[at:] and r.sums == np.cumsum([x.end - x.start for x in r.s]).tolist()


def brute_terms(texts, words=5, reach=100, support=5, generalise=0.8, remove=0.95):
    """The disclosing terms of texts whose entities are single addresses, and whether they are removed."""
    term = re.compile(r"[^\W\d_]{2,}")
    total, n_t, n_tc, docs, n_c = 0, collections.Counter(), collections.Counter(), collections.defaultdict(set), 0
    for i, t in enumerate(texts):
        every = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(t)]
        total += len(every)
        n_t.update(w for _, _, w in every)
        for e in re.finditer(r"[a-z0-9.]+@[a-z.]+[a-z]", t):
            before = [w for a, b, w in every if b <= e.start() and a >= e.start() - reach][-words:]
            after = [w for a, b, w in every if a >= e.end() and b < e.end() + reach][:words]
            for w in before + after:
                n_tc[w] += 1
                docs[w].add(i)
                n_c += 1
    ic = -math.log2(n_c / total) if n_c else 0
    share = {w: math.log2(n_tc[w] * total / (n_t[w] * n_c)) / max(ic, 1e-9) for w in n_tc if len(docs[w]) >= support}
    return {w: s >= remove for w, s in share.items() if s >= generalise}


def test_disclosure_against_brute_force(spark):
    rng = random.Random(21)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(3))
    texts = []
    for i in range(300):
        body = [word() for _ in range(40)]
        if i % 3 == 0:
            name = ["zorban", "quillix", "marvolo"][i % 9 // 3]
            body.insert(20, f"{name} u{i}@host.example.com")
        if i % 7 == 0:
            body.insert(3, "marvolo")
        texts.append(" ".join(body))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pii.disclosing_terms(df, Scratch(spark)).collect():
        got |= r.hits
    want = brute_terms(texts)
    assert got == want and "zorban" in want and want["zorban"]


def test_likelihood_ratio_against_brute_force(spark):
    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(120)]
    texts += [" ".join(f"v{rng.randrange(300)}" for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.score_quality(df, labels, bits=24).collect()}
    half = {r.id: r.h for r in spark.range(120).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    grams = lambda t: (w := t.split()) + list(zip(w, w[1:], strict=False))
    raw, good = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if half.get(i) == 0:
            good.update(grams(t))
    size = 1 << 24
    weight = lambda g: math.log((good[g] + 1) / (good.total() + size)) - math.log((raw[g] + 1) / (raw.total() + size))
    llr = [np.mean([weight(g) for g in grams(t)]) for t in texts]
    assert max(abs(rows[i].llr - x) for i, x in enumerate(llr)) < 0.02  # but for the odd pair of grams in one bucket
    held = sorted(rows[i].llr for i in range(120) if half[i] == 1)
    assert rows[0].threshold == pytest.approx(math.floor(held[0] / quality.STEP) * quality.STEP - 0.05)
    assert all(r.kept == (r.llr >= r.threshold and not r.base_failed) for r in rows.values())


def test_ordinal_model_against_brute_force():
    texts = ["a b c", "vile a", "vile moron scum filth", "", "b vile vile"]
    words = {}
    for chunk in chunks(pa.array(["vile moron scum filth"])):
        words = dict(zip("vile moron scum filth".split(), toxicity.word_hashes(chunk)[0], strict=True))
    order = sorted(words, key=words.get)
    weights = {"vile": 2.0, "moron": 1.5, "scum": 1.0, "filth": 0.5}
    cuts = np.array([1.0, 2.5, 4.0])
    model = toxicity.Model(np.array([words[w] for w in order], dtype=np.uint64), np.array([weights[w] for w in order]), cuts)
    got = np.concatenate([model.severity(c).sum(axis=1) for c in chunks(pa.array(texts))])
    want = [sum(1 / (1 + math.exp(c - sum(weights.get(w, 0) for w in set(t.split())))) for c in cuts) for t in texts]
    assert np.allclose(got, want)


def test_toxicity_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    model = toxicity.train(empty, labels)
    assert toxicity.grade_toxicity(empty, model).count() == 0 and toxicity.keep_clean(empty, model).count() == 0
    twice = spark.createDataFrame([(0, "x"), (0, "x"), (None, "x")], "doc_id long, text string")
    assert toxicity.grade_toxicity(twice, model).count() == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
