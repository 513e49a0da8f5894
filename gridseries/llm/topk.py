"""Exact search for the largest inner products, in buckets of similar length.

Vectors are sorted by length into buckets. A first pass scores each query
against the bucket of the longest vectors and so gives it a threshold: its k-th
best score there. In any other bucket a hit must have a cosine of at least
threshold / (query length * longest length of the bucket), the bucket's local
threshold. Where that exceeds one, the bucket is passed over; where only the
bucket's shorter vectors fail it, they are pruned by length; and otherwise, if
it is high enough, by coordinates: a vector's part along the query's largest
coordinates bounds its cosine. What is left is verified by whole products.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import released, ship
from gridseries.session import scratch_path

# Rows of a bucket of vectors, which a task holds, and of a group of queries, which
# pass by it batch by batch: a vector travels once for each group, a query once for
# each bucket that its own threshold leaves.
BLOCK = 8192
QUERIES = 16384
# Coordinates of a query that bound a cosine, and the local threshold from which
# looking at them first is worth it.
FOCUS = 16
STEEP = 0.6
# Whole numbers below this stay exact when 64-bit floats add their products.
EXACT = 2.0**53


def _usable(frame: DataFrame, vector: str, scale: float) -> DataFrame:
    """Rows with a vector of finite numbers, as whole numbers ``floor(scale * x)``."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    odd = F.exists(
        F.col(vector),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return frame.filter(
        F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))
    ).withColumn(vector, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), np.int64)
    largest = np.abs(queries).max() * np.abs(rows).max() * rows.shape[1]
    if largest < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, int(x))), otypes=[np.int64])(exact)


def _best(ids, scores, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= cut)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))][:k]


class _Bucket:
    """The vectors of one bucket, with what every query needs of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.length = np.sqrt((rows**2).sum(1))
        self.longest, self.shortest = self.length.max(), self.length.min()
        self.unit = rows / np.maximum(self.length, 1e-300)[:, None]

    def best(self, q_ids, queries, floors, k: int) -> tuple[list, list, list]:
        """Candidates of each query among the vectors: query, id and score."""
        q_len = np.sqrt((queries**2).sum(1))
        unit_q = queries / np.maximum(q_len, 1e-300)[:, None]
        out_q, out_i, out_s = [], [], []
        for i in range(len(q_ids)):
            floor = floors[i]
            keep = self.ids != q_ids[i]
            if np.isfinite(floor) and floor > 0:
                # A hair less than the bound, as lengths are rounded.
                local = (floor - 0.5) / max(q_len[i] * self.longest, 1e-300)
                if local > 1:
                    continue
                if self.shortest < self.longest:
                    keep &= self.length * q_len[i] >= floor - 0.5
                if local >= STEEP:
                    keep &= self._bound(unit_q[i]) * q_len[i] * self.length >= floor - 0.5
            place = np.flatnonzero(keep)
            if not len(place):
                continue
            scores = _products(queries[i : i + 1], self.rows[place])[0]
            if np.isfinite(floor):
                place, scores = place[scores >= floor], scores[scores >= floor]
            top = _best(self.ids[place], scores, k)
            out_q += [q_ids[i]] * len(top)
            out_i += self.ids[place[top]].tolist()
            out_s += scores[top].tolist()
        return out_q, out_i, out_s

    def _bound(self, unit_q: np.ndarray) -> np.ndarray:
        """Upper bounds of the cosines, from the query's largest coordinates."""
        focus = np.argsort(-np.abs(unit_q))[:FOCUS]
        part = self.unit[:, focus] @ unit_q[focus]
        rest_q = 1 - (unit_q[focus] ** 2).sum()
        rest = 1 - (self.unit[:, focus] ** 2).sum(1)
        return part + np.sqrt(np.maximum(rest_q, 0) * np.maximum(rest, 0))


def _pairs(k: int):
    """Search of batches sorted by bucket and group of queries, vectors first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, bucket = None, [], None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            asks = columns["is_query"].to_numpy(zero_copy_only=False)
            key = np.stack([*(columns[c].to_numpy() for c in ("dims", "bucket", "q_block")), asks], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if tuple(key[a, :3]) != now:
                    now, parts, bucket = tuple(key[a, :3]), [], None
                ids = columns["id"].slice(a, b - a).to_numpy()
                vectors = _matrix(columns["v"].slice(a, b - a))
                if not asks[a]:
                    parts.append((ids, vectors))
                    continue
                if parts:
                    bucket = _Bucket(*(np.concatenate(x) for x in zip(*parts)))
                    parts = []
                if bucket is not None:
                    floors = columns["floor"].slice(a, b - a).to_numpy()
                    found = bucket.best(ids, vectors, floors, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"]
                    )

    return work


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product with each row
    of ``queries``: ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``.

    Components count as ``floor(scale * x)``. Ties go to the smaller id; a row
    does not match a query of its own id. Vectors that are NULL or empty, hold
    NULL or numbers that are not finite, or have no id take no part; a query
    meets the vectors of its own dimension only. Fewer than ``k`` partners give
    fewer rows. Of repeated rows with one id and one vector the first counts
    once; a repeated id with different vectors counts with each, as a query too
    (its ranks are taken over all of them). Scores beyond 64 bits are clipped to
    them. Other columns are ignored. A task holds one bucket of vectors and one
    batch of the queries that pass by it.
    """
    spark = vectors.sparkSession
    ship(spark)

    def prepared(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"))
        rows = _usable(rows.filter("id IS NOT NULL"), "v", scale).dropDuplicates(["id", "v"])
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        return rows.withColumns({"dims": F.size("v"), "length": F.sqrt(square)})

    rows, asked = prepared(vectors), prepared(queries)
    # Longest first; a bucket is a range of lengths with about a block of rows.
    # A bucket is a range of lengths with about a block of rows, the last range
    # the longest. Written down, so that it stays as it is when a task is lost.
    buckets = max(1, -(-rows.count() // BLOCK))
    dealt = rows.repartitionByRange(buckets, "length", "id")
    rows = _written(dealt.withColumn("bucket", F.spark_partition_id()), "buckets")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = _written(asked, "queries")
    of_bucket = rows.groupBy("dims", "bucket").agg(F.max("length").alias("longest"))
    first = of_bucket.groupBy("dims").agg(F.max("bucket").alias("bucket"))
    of_block = asked.groupBy("dims", "q_block").agg(F.count(F.lit(1)).alias("n"))

    def candidates(questions: DataFrame, pairs: DataFrame) -> DataFrame:
        """Best of every query of the blocks in each bucket they are paired with."""
        columns = ["dims", "bucket", "q_block", "is_query", "id", "floor", "v"]
        visited = pairs.select("dims", "bucket", "q_block")
        there = rows.join(visited, ["dims", "bucket"]).withColumns(
            {"is_query": F.lit(False), "floor": F.lit(float("-inf"))}
        )
        here = _visits(questions, pairs).withColumn("is_query", F.lit(True))
        met = there.select(*columns).unionByName(here.select(*columns))
        keys = ["dims", "bucket", "q_block"]
        return (
            met.repartition(*keys)
            .sortWithinPartitions(*keys, "is_query")
            .mapInArrow(released(_pairs(k)), "query_id bigint, vec_id bigint, score bigint")
        )

    start = candidates(
        asked.withColumns({"floor": F.lit(float("-inf")), "threshold": F.lit(float("-inf"))}),
        of_block.join(first, "dims").join(of_bucket, ["dims", "bucket"]),
    )
    start = _written(start, "first_bucket")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = (
        start.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") == k)
        .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    )
    # A query whose id has several vectors keeps no threshold.
    single = asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("id")
    asked = asked.join(floors.join(single, "id"), "id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf")))
    )
    # The least length that a hit of the query has; a group goes by its easiest query.
    asked = asked.withColumn(
        "threshold",
        F.coalesce(F.try_divide(F.col("floor") - 0.5, "length"), F.lit(float("-inf"))),
    )
    of_block = asked.groupBy("dims", "q_block").agg(F.min("threshold").alias("least"))
    last = first.select("dims", F.col("bucket").alias("first"))
    pairs = (
        of_bucket.join(of_block, "dims")
        .join(last, "dims")
        .filter("bucket <> first AND NOT coalesce(least > longest, false)")
    )
    found = start.unionByName(candidates(asked, pairs))
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _visits(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries beside each bucket of their group whose longest vector may be a hit."""
    return questions.join(pairs.select("dims", "bucket", "q_block", "longest"), ["dims", "q_block"]).filter(
        "NOT threshold > longest"
    )


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
