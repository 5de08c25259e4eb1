"""The registered queries of this subpackage: thin, each over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import bpe, packing, pii, quality, repeats, secrets, shingle_join, token_counts, toxicity, vector_dups
from rosterloom.llm.scratch import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two sequences."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return vector_dups.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity; kept where it is low."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade_toxicity(docs, model)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, log-likelihood ratio and verdict."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _span_digest(spans: str, kinds: tuple[str, ...]) -> Column:
    """Lowercase hex of kind:start:end, comma-joined, of the spans of some kinds."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.sha2(_span_text(some).cast("binary"), 256)


def _span_text(spans: Column | str) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _span_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and the terms that give it away."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select(
        "doc_id",
        *(_span_count("spans", k).alias(f"n_{k}") for k in pii.BASE),
        _span_digest("spans", pii.BASE).alias("base_sha256"),
        _span_text("spans").alias("spans"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats an earlier one."""
    return repeats.find_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of similar ones."""
    found = shingle_join.jaccard_classes(table(spark, sf_dir, "documents"), Scratch(spark), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    base = ("assign", "access", "hex")
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(_span_count("spans", k).alias(f"n_{k}") for k in base),
        _span_digest("spans", base).alias("base_sha256"),
        _span_text("spans").alias("spans"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_vector_dups": op2_vector_dups,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_repeats": op8_repeats,
    "op9_shingle_join": op9_shingle_join,
    "op10_secrets": op10_secrets,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The other operators have no SQL: they rest on models, tokenizers or offsets of matches.
ORACLE_SQL: dict[str, str] = {
    "op2_vector_dups": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
        r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT node, b FROM r JOIN l ON seen = a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT node AS vec_id, min(seen) AS component_id FROM r GROUP BY node)""",
    "op9_shingle_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        c AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM s),
        g AS (SELECT class_id AS d, len(s) AS n, unnest(s) AS g FROM c WHERE doc_id = class_id),
        p AS (SELECT x.d AS a, y.d AS b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM g x JOIN g y ON x.g = y.g AND x.d <> y.d GROUP BY 1, 2),
        l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
        r AS (SELECT DISTINCT class_id AS node, class_id AS seen FROM c UNION SELECT node, b FROM r JOIN l ON seen = a),
        k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT doc_id, len(s) AS n_shingles, component_id, class_id FROM c JOIN k ON class_id = node""",
}
