"""The operators over the given tables, with production parameters."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm import (
    bpe,
    collocations,
    hard_negatives,
    language_id,
    mixing,
    near_dup,
    quality_rules,
    recompression,
    suffix_dedup,
    token_counts,
    topk,
    toxicity,
    url_filter,
)
from gridseries.llm.oracle import ORACLE_SQL  # noqa: F401

# The public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
END_OF_TEXT = 49407


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every document, by rules learned from the labels."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(documents, _table(spark, sf_dir, "labels"))
    counted = quality_rules.with_counts(documents)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select(
        "doc_id",
        *base,
        failed.alias("base_failed"),
        (~failed & quality_rules.verdict(rules)).alias("kept"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and decoded text of every document, as digests."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(documents, WORD_BPE)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the documents by shingles of four words."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files of the documents."""
    documents = _table(spark, sf_dir, "documents")
    blocks = token_counts.flat_blocks(documents, WORD_BPE, END_OF_TEXT)
    counted = token_counts.count_tokens(blocks, END_OF_TEXT, carried=["doc_ids"])
    return counted.select(
        F.col("doc_ids").alias("doc_id"), "n_tokens", "file", "ordinal", "token_start"
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest inner products of every fiftieth vector with all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed so that a source weighs the root of its size."""
    return mixing.replicate(_table(spark, sf_dir, "documents"), power=0.5)


# The rules on hosts and paths.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.fit(url_filter.labelled_urls())
    judged = url_filter.judge(pages, URL_RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "probability")


def _held_out() -> Column:
    """The fold that no label is learned from; rows without id are learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the fold."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~_held_out())
    scored = toxicity.score(documents, toxicity.learn(documents, labels))
    return scored.select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "offending",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the fold."""
    documents = _table(spark, sf_dir, "documents")
    model = language_id.learn(documents.filter(~_held_out()))
    found = language_id.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 100 bytes met earlier."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(documents)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardest rows of other labels for every fiftieth vector and its positives."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), positives=5, negatives=3)


def op12_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 50 words of earlier ones."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = recompression.remove_repeated_words(documents)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return found.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the documents whose words belong together, by language."""
    documents = _table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(documents, longest=5, least=100, top=2000)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_near_dup": op3_near_dup,
    "op4_token_counts": op4_token_counts,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_recompression": op12_recompression,
    "op13_collocations": op13_collocations,
}
