"""Keys that tell rows of documents apart, and rows that say the same."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.session import scratch_path

LOWEST = -(2**63)


def keyed(documents: DataFrame, doc_id: str, text: str, d: str, x: str) -> tuple[DataFrame, bool]:
    """Add columns ``d`` (the id, NULL as the lowest) and ``x`` that together tell
    different rows apart, and say whether rows repeat.

    One job looks for ids that repeat; where none does, ``x`` is 0 and the texts are
    not read. Else it is a hash of the text of 64 bits, checked by a second one:
    where two texts of one id agree in it, which may never happen, another seed is
    taken. So equal keys mean equal id and text. Only keys met twice are kept.
    """
    spark = documents.sparkSession
    number = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LOWEST).cast("bigint"))
    several = documents.groupBy(number.alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if several.isEmpty():
        # Zero, but no literal: Spark would take that out of the exchange that all
        # readers of the texts share.
        return documents.withColumns({d: number, x: number.bitwiseAND(F.lit(0).cast("bigint"))}), False
    body = F.col(f"`{text}`").cast("binary")
    for seed in range(16):
        out = documents.withColumns(
            {
                d: number,
                x: F.xxhash64(F.lit(seed), body),
            }
        )
        check = F.xxhash64(F.lit(seed + 1000), body)
        met = out.select(F.col(d).alias("d"), F.col(x).alias("x"), check.alias("c"))
        again = met.groupBy("d", "x").agg(
            F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")
        )
        path = scratch_path(spark, "keys")
        again.filter("n > 1").write.parquet(path)
        again = spark.read.schema(again.schema).parquet(path)
        found = again.agg(F.count(F.lit(1)), F.count_if(F.col("low") != F.col("high"))).first()
        if not found[1]:
            return out, found[0] > 0
    raise RuntimeError("no hash tells the texts apart")
