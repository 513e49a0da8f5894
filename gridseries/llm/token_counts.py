"""Tokens of each document in flat token files that have no index.

A token file is nothing but identifiers, one after the other, with an
end-of-document identifier behind each document. Files are cut into blocks of
equal size wherever that falls. Each block is searched for the identifier by
itself; a prefix scan over the blocks' totals then says how many tokens of the
first document of a block lie in the blocks before it.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import released, ship, slices, with_results
from gridseries.llm.bpe import encoder_of, read_vocabulary
from gridseries.session import scratch_path

# Tokens of a block.
BLOCK_TOKENS = 1 << 17
# Blocks that one window of the scan's lower level holds at most.
GROUP = 1024


def flat_blocks(
    documents: DataFrame,
    vocabulary: str,
    end_of_document: int,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The documents of each partition as one flat token file, cut into blocks.

    Returns ``file``, ``block``, ``content`` (32-bit identifiers) and
    ``doc_ids``, the documents that end in the block in their order, which names
    the results and plays no part in the counting. A NULL or empty text is an
    end of document and nothing else. Texts of special tokens count as ordinary
    text, so that the identifier occurs at ends of documents only. A task holds
    one block and one slice of texts. The vocabulary is broadcast (64 MB at most).
    """
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([end_of_document], np.int32).tobytes()
    size = 4 * block_tokens

    def row(number: int, content: bytes, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId()], pa.int64()),
                pa.array([number], pa.int64()),
                pa.array([content], pa.binary()),
                pa.array([ids], pa.list_(pa.int64())),
            ],
            ["file", "block", "content", "doc_ids"],
        )

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value, False)
        # The stream not yet given out, and the places in it where documents end.
        held, ends, number = bytearray(), [], 0
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in slices(batch.column(1)):
                for t in part:
                    held += encoder.text(t)[1] if t else b""
                    held += end
                    ends.append((len(held), next(ids)))
                    while len(held) >= size:
                        here = [i for at, i in ends if at <= size]
                        yield row(number, bytes(held[:size]), here)
                        del held[:size]
                        ends = [(at - size, i) for at, i in ends if at > size]
                        number += 1
        if held:
            yield row(number, bytes(held), [i for _, i in ends])

    # Under names that cannot clash, so any two columns of the table will do.
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").cast("string").alias("t")
    )
    return rows.mapInArrow(
        released(flatten), "file bigint, block bigint, content binary, doc_ids array<bigint>"
    )


def read_blocks(
    spark: SparkSession, path: str, *, width: int = 4, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Token files below ``path`` as blocks ``file``, ``block``, ``content``.

    A file can have up to 2 GB, as it is read as one value; it must hold whole
    identifiers of ``width`` bytes.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.col("length") > 0).select(
        F.col("path").alias("file"),
        F.col("content").alias("_content"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("block"),
    ).select(
        "file",
        "block",
        F.substring("_content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("content"),
    )


def _searcher(end_of_document: int, width: int):
    kind = {2: np.uint16, 4: np.int32}[width]

    def search(contents: pa.Array) -> pa.Array:
        sizes, places = [], []
        for content in contents:
            tokens = np.frombuffer(content.as_buffer(), kind)
            sizes.append(len(tokens))
            places.append(np.flatnonzero(tokens == end_of_document).astype(np.int32))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32)
        flat = np.concatenate(places) if places else np.empty(0, np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
            ["n_in_block", "ends"],
        )

    return search


def count_tokens(
    blocks: DataFrame, end_of_document: int, *, width: int = 4, carried: Sequence[str] = ()
) -> DataFrame:
    """Tokens of every document of every file, without its end-of-document.

    Returns ``file``, ``ordinal`` (place of the document in its file, from 0),
    ``token_start`` (place of its first token), ``n_tokens`` and ``terminated``:
    false for tokens that follow the last identifier of a file, which form a
    last document. Each of ``carried`` is an array with an element for each
    document that ends in the block; a document gets its element.

    The scan has two levels, groups of 1,024 blocks and the groups of a file, so
    a window holds 1,024 rows, or a row for each 128 million tokens of a file.
    No blocks, no rows; blocks must be numbered from 0 without gaps.
    """
    found = with_results(
        blocks.select("file", "block", "content", *carried),
        "content",
        _searcher(end_of_document, width),
        "n_in_block bigint, ends array<int>",
    )
    # The search is not repeated for the two levels of the scan.
    path = scratch_path(blocks.sparkSession, "token_blocks")
    found.drop("content").write.parquet(path)
    return _stitched(blocks.sparkSession.read.parquet(path), carried)


def _stitched(found: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Totals before each block, by a scan within groups and one over groups."""
    group = F.floor(F.col("block") / GROUP)
    inner = Window.partitionBy("file", "_group").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    local = found.withColumn("_group", group).withColumn(
        "_start", F.coalesce(F.sum("n_in_block").over(before), zero)
    )
    # Where the last document that ends in a block ends, from the group's start.
    last = F.when(F.size("ends") > 0, F.col("_start") + F.element_at("ends", -1) + 1)
    local = local.withColumn("_last", last).withColumns(
        {
            "_documents": F.coalesce(F.sum(F.size("ends")).over(before), zero),
            "_open": F.max("_last").over(before),
        }
    )
    groups = local.groupBy("file", "_group").agg(
        F.sum("n_in_block").alias("_n"),
        F.sum(F.size("ends")).alias("_d"),
        F.max("_last").alias("_l"),
        F.max("block").alias("_end"),
    )
    over = Window.partitionBy("file").orderBy("_group")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), zero)).select(
        "file",
        "_group",
        "_n0",
        F.coalesce(F.sum("_d").over(earlier), zero).alias("_d0"),
        F.coalesce(F.max(F.col("_n0") + F.col("_l")).over(earlier), zero).alias("_l0"),
        (F.lead("_group").over(over).isNull()).alias("_final"),
        "_end",
    )
    # Ends of documents in the block, as places in the file, and the place after
    # the last end before the block.
    placed = local.join(starts, ["file", "_group"]).select(
        "file",
        *carried,
        F.transform("ends", lambda e: e + F.col("_start") + F.col("_n0")).alias("_ends"),
        F.coalesce(F.col("_open") + F.col("_n0"), "_l0").alias("_from"),
        (F.col("_documents") + F.col("_d0")).alias("_first"),
        (F.col("_start") + F.col("_n0") + F.col("n_in_block")).alias("_stop"),
        (F.col("_final") & (F.col("block") == F.col("_end"))).alias("_is_last"),
    )
    begin = F.concat(F.array("_from"), F.transform("_ends", lambda e: e + 1))
    after = F.element_at("_begin", -1)
    open_end = F.col("_is_last") & (F.col("_stop") > after)
    closed = F.transform(
        "_ends",
        lambda e, i: F.struct(
            F.element_at("_begin", i + 1).alias("token_start"),
            e.alias("stop"),
            F.lit(True).alias("terminated"),
            (F.col("_first") + i).alias("ordinal"),
            *[F.get(F.col(c), i).alias(c) for c in carried],
        ),
    )
    rest = F.array(
        F.struct(
            after.alias("token_start"),
            F.col("_stop").alias("stop"),
            F.lit(False).alias("terminated"),
            (F.col("_first") + F.size("_ends")).alias("ordinal"),
            *[F.lit(None).alias(c) for c in carried],
        )
    )
    documents = F.concat(closed, F.when(open_end, rest).otherwise(F.slice(closed, 1, 0)))
    return (
        placed.withColumn("_begin", begin)
        .select("file", F.explode(documents).alias("_d"))
        .select(
            "file",
            F.col("_d.ordinal").cast("bigint").alias("ordinal"),
            F.col("_d.token_start").alias("token_start"),
            (F.col("_d.stop") - F.col("_d.token_start")).alias("n_tokens"),
            F.col("_d.terminated").alias("terminated"),
            *[F.col("_d")[c].alias(c) for c in carried],
        )
    )
