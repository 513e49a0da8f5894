"""From raw documents to token identifiers, in five stages.

Each stage is a function of the session, the documents that the stage before it
kept, and the folder of the tables; all but the last return the columns of
documents. The tables between the stages are written as Parquet.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm import bpe, language_id, mixing, near_dup, suffix_dedup
from gridseries.llm.queries import WORD_BPE
from gridseries.session import discard, scratch_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or letters go.

    Learned from the documents that name their language. ``lang`` becomes the
    prediction on every row, also where a language was named.
    """
    model = language_id.learn(docs)
    found = language_id.identify(docs, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id.

    Rows of one ``doc_id`` are one document, of which the least text stays; rows
    without ``doc_id`` stay.
    """
    found = near_dup.near_duplicates(docs, words=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return left
    one = (
        left.join(again, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row"))
        .select("doc_id", "row.*")
    )
    return left.join(again, "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur earlier."""
    found = suffix_dedup.remove_repeats(docs)
    return found.withColumns(
        {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    ).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at random so that a source weighs the root of its size."""
    return mixing.replicate(docs, power=0.5).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every document, and what they decode to."""
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), WORD_BPE)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

# The stages learn, hash and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = scratch_path(spark, f"stage{number}")
            docs.write.parquet(path)
            if number > 1:
                # The table before has been read for the last time.
                discard(spark, before)
            before = docs = spark.read.parquet(path)
    return docs
