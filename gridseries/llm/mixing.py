"""Mixing sources to target weights by Poisson replication.

A source of target weight w and size s repeats at the mean rate w * total / s.
Each document draws its number of copies from the Poisson distribution of that
mean, by inverting its cumulative probabilities at a number that a seed and the
document's id hash to; a document without id goes by its source and content.
Copies are then put in an order that another hash tells.
Only DataFrame functions are used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import fresh
from gridseries.session import scratch_path

# Copies of one document differ from the mean by this many deviations at most, and
# a few: beyond lies less than one part in 10**15 of the distribution.
DEVIATIONS = 9
SPARE = 12


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that seed and key tell, with 52 bits."""
    hexadecimal = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(hexadecimal, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def target_rates(
    documents: DataFrame,
    targets: DataFrame | None = None,
    *,
    source: str = "source",
    power: float = 0.5,
) -> DataFrame:
    """One row per source: ``source``, ``n_documents``, ``weight``, ``rate``.

    ``targets`` (``source``, ``weight``) gives the share each source shall have
    of the result; weights are brought to a sum of 1 and a source that is not
    listed has weight 0. Without it a source of n documents weighs n ** power.
    The expected size of the result is that of the input. NULL is a source too.
    A table without positive weights has rate 0 throughout.
    """
    sizes = documents.groupBy(F.col(f"`{source}`").cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents")
    )
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n_documents").cast("double"), power))
    else:
        given = targets.select(
            F.col("source").cast("string").alias("_s"), F.col("weight").cast("double").alias("weight")
        )
        given = given.groupBy("_s").agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["_s"]), "left").select(
            "source", "n_documents", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")
        )
    # The sums are scalars of the small table of sources.
    total = weighed.agg(F.sum("n_documents").cast("double").alias("x")).scalar()
    whole = weighed.agg(F.sum("weight").alias("x")).scalar()
    share = F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0))
    return weighed.select(
        "source",
        "n_documents",
        share.alias("weight"),
        (share * total / F.col("n_documents")).alias("rate"),
    )


def cumulative(rates: DataFrame) -> DataFrame:
    """Add ``least`` and ``cdf`` to a table of sources with their ``rate``: the
    Poisson probabilities of at most ``least``, ``least`` + 1, ... copies.

    Numbers of copies more than ``DEVIATIONS`` deviations from the mean are left
    out, below and above it; they have less than one part in 10**15. So there is a
    row for some twenty roots of the rate, and the terms are summed by a window
    over the source's numbers: each by its logarithm against the one before, so
    that no mean is too large, then brought to a sum of 1.
    """
    spread = DEVIATIONS * F.sqrt("rate") + SPARE
    least = F.greatest(F.lit(0), F.floor(F.col("rate") - spread)).cast("bigint")
    most = F.ceil(F.col("rate") + spread).cast("bigint")
    rows = rates.withColumn("least", F.when(F.col("rate") > 0, least).otherwise(F.lit(0).cast("bigint")))
    terms = rows.filter("rate > 0").select("source", "rate", "least", F.explode(F.sequence("least", most)).alias("k"))
    whole = Window.partitionBy("source")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("k") == F.col("least"), 0.0).otherwise(F.ln(F.col("rate") / F.col("k")))
    sized = terms.withColumn("log", F.sum(step).over(upto))
    sized = sized.withColumn("term", F.exp(F.col("log") - F.max("log").over(whole)))
    summed = sized.select("source", "k", (F.sum("term").over(upto) / F.sum("term").over(whole)).alias("c"))
    lists = summed.groupBy(F.col("source").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("k", "c"))).getField("c").alias("cdf")
    )
    found = rows.join(lists, rows["source"].eqNullSafe(lists["_of"]), "left").drop("_of")
    return found.withColumn("cdf", F.coalesce("cdf", F.array(F.lit(1.0))))


def replicate(
    documents: DataFrame,
    targets: DataFrame | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    power: float = 0.5,
    seed: str = "mix",
) -> DataFrame:
    """The documents' copies in random order, with ``copy`` (from 0),
    ``copies`` and ``shuffle_key`` beside their columns.

    See :func:`target_rates` for the targets. Rows of one ``doc_id`` draw the
    same number, so repeated rows have equally many copies each if their source
    is the same. Rows with a NULL id draw by their whole content, so only those
    that are equal in every column draw one number together; the only such row
    of a source draws by the source. An empty table gives an empty one. Where
    there is an id, texts play no part. Columns named like a result are replaced.

    One row per source is joined to the documents, where Spark picks the join by
    its size. Documents without copies are dropped before anything moves; the
    others cross the network once, dealt by their shuffle key, so that a source
    of any size is spread evenly, and each task sorts its share.
    """
    names = {"copy", "copies", "shuffle_key"}
    u = fresh(documents, "_u")
    s, cdf, least, several, key = (
        fresh(documents, c) for c in ("_source", "_cdf", "_least", "_several", "_key")
    )
    rates = cumulative(
        target_rates(documents, targets, source=source, power=power).select("source", "rate")
    ).select(F.col("source").alias(s), F.col("least").alias(least), F.col("cdf").alias(cdf))
    i, of = F.col(f"`{doc_id}`"), F.col(f"`{source}`").cast("string")
    without = (
        documents.filter(i.isNull())
        .groupBy(of.alias("_of"))
        .agg((F.count(F.lit(1)) > 1).alias(several))
    )
    rates = rates.join(without, rates[s].eqNullSafe(without["_of"]), "left").drop("_of")
    # Written, so that Spark sees the table's true size before it plans the join.
    path = scratch_path(documents.sparkSession, "rates")
    rates.write.parquet(path)
    table = documents.sparkSession.read.parquet(path)
    # A NULL has a text of its own, so that its place tells rows apart.
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in documents.columns]
    content = F.md5(F.concat_ws("\x1f", *told))
    own = F.coalesce(F.when(F.col(several), content).otherwise(of), F.lit(""))
    kept = [c for c in documents.columns if c.lower() not in names]
    drawn = (
        documents.join(table, documents[f"`{source}`"].cast("string").eqNullSafe(table[s]))
        .withColumn(key, F.coalesce(i.cast("string"), own))
        .withColumn(u, uniform(F.col(key), seed))
        .withColumn("copies", (F.col(least) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))).cast("int"))
    )
    copies = drawn.filter("copies > 0").select(
        *[F.col(f"`{c}`") for c in kept],
        key,
        "copies",
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
    )
    order = uniform(F.concat_ws(":", F.col(key), F.col("copy").cast("string")), f"{seed}-order")
    return (
        copies.withColumn("shuffle_key", order)
        .drop(key)
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key", F.col(f"`{doc_id}`"), "copy")
        .select(*[F.col(f"`{c}`") for c in kept], "copy", "copies", "shuffle_key")
    )
