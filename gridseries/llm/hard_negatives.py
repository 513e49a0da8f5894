"""Hard negatives of anchors, by score bounds along a spanning tree of the anchors.

Some anchors, a bounded number, are *pivots*; every other anchor is the child of
the pivot nearest to it, and a minimum spanning tree holds the pivots, so that all
anchors form one tree. The score of a candidate c with a child a of an anchor p is
bounded by that with the parent::

    p . c - |a - p| |c|  <=  a . c  <=  p . c + |a - p| |c|

1. Rows are sorted by label and nearest pivot and cut into stored blocks. Each
   block notes, for every pivot, the least and greatest bound its rows can give a
   child, per unit of edge length: a child need not visit a block whose bounds
   miss its window.
2. First visit: the positives, best rows of the anchor's own label. Within a block
   the rows of the best pivot scores set a floor, and only rows whose upper bound
   reaches it are scored.
3. The positives give each anchor its window of scores. Second visit: rows of other
   labels whose bounds overlap the window are scored, the others are not.

In a block, bounds come down the tree: from the root, which is scored with every
row, to each pivot, which is scored with those rows only that may lie in a child's
window, to the children. Anchors go to the blocks they have to visit.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import released, ship
from gridseries.llm.topk import _products
from gridseries.session import scratch_path

# Bytes of a block of rows, and of all pivots, as 64-bit floats; rows of a block
# and pivots at most. The number of pivots goes by the root of that of anchors.
BLOCK_BYTES = 32 << 20
PIVOT_BYTES = 8 << 20
LEAST_ROWS, MOST_ROWS = 4096, 1 << 16
MOST_PIVOTS = 512
# Different dimensions that anchors may have.
MOST_KINDS = 1024
# A hair of room, as bounds are computed in floating point.
ROOM = 1e-9


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _whole(frame: DataFrame, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """Usable rows with whole numbers ``floor(scale * x)`` for components."""
    rows = frame.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"),
        F.col(f"`{label}`").cast("bigint").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~odd)
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double"))
    return rows.withColumns({"v": whole, "dims": F.size("v")})


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


class Pivots:
    """The pivots of each dimension, and the tree that holds them together."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        found: dict[int, list] = {}
        for _, v in sorted(rows, key=lambda r: r[0]):
            found.setdefault(len(v), []).append(v)
        self.of = {d: np.array(v, float).reshape(len(v), d) for d, v in found.items()}
        self.tree = {d: _spanning_tree(p) for d, p in self.of.items()}

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot of each vector, the nearest but for rounding, and its distance."""
        pivots = self.of[vectors.shape[1]]
        best = np.argmin((pivots**2).sum(1) - 2 * vectors @ pivots.T, axis=1)
        return best, np.sqrt(((vectors - pivots[best]) ** 2).sum(1))


def _spanning_tree(points: np.ndarray):
    """Minimum spanning tree from the first point: parents and edge lengths."""
    n = len(points)
    parent, edge = np.full(n, -1), np.zeros(n)
    near, via = np.full(n, np.inf), np.full(n, -1)
    open_ = np.ones(n, bool)
    now = 0
    for _ in range(n):
        open_[now] = False
        parent[now], edge[now] = via[now], near[now] if via[now] >= 0 else 0.0
        far = np.sqrt(((points - points[now]) ** 2).sum(1))
        closer = open_ & (far < near)
        near[closer], via[closer] = far[closer], now
        if not open_.any():
            break
        now = int(np.flatnonzero(open_)[np.argmin(near[open_])])
    return parent, edge


def _assign(pivots):
    """Rows in; nearest pivot and its distance added."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pivots.value
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            place, edge = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                if int(d) in model.of:
                    v = _matrix(batch.column("v").take(pa.array(mine)), int(d))
                    place[mine], edge[mine] = model.nearest(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place), pa.array(edge)], [*batch.schema.names, "pivot", "edge"]
            )

    return work


def _summaries(pivots):
    """Rows of blocks in; per block, dimension and pivot the least and greatest
    pivot score, and the greatest length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pivots.value
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims, blocks = batch.column("dims").to_numpy(), batch.column("block").to_numpy()
            labels = batch.column("label").to_numpy()
            for d, b in {*zip(dims.tolist(), blocks.tolist())}:
                if d not in model.of:
                    continue
                mine = np.flatnonzero((dims == d) & (blocks == b))
                v = _matrix(batch.column("v").take(pa.array(mine)), d)
                scores = model.of[d] @ v.T
                new = [
                    scores.min(1), scores.max(1), np.sqrt((v**2).sum(1)).max(),
                    labels[mine].min(), labels[mine].max(), len(mine),
                ]
                old = held.get((d, b))
                if old is not None:
                    new = [
                        np.minimum(old[0], new[0]), np.maximum(old[1], new[1]), max(old[2], new[2]),
                        min(old[3], new[3]), max(old[4], new[4]), old[5] + new[5],
                    ]
                held[d, b] = new
        for (d, b), (low, high, length, first, last, _) in held.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, b, np.int32)),
                    pa.array(np.full(n, d, np.int32)),
                    pa.array(np.arange(n)),
                    pa.array(low),
                    pa.array(high),
                    pa.array(np.full(n, length)),
                    pa.array(np.full(n, first)),
                    pa.array(np.full(n, last)),
                ],
                ["block", "dims", "pivot", "low", "high", "length", "first_label", "last_label"],
            )

    return work


SUMMARY = (
    "block int, dims int, pivot bigint, low double, high double, length double, "
    "first_label bigint, last_label bigint"
)


class _Block:
    """The rows of one block and dimension, and what is known of their scores."""

    def __init__(self):
        self.parts = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def ready(self, dims: int, pivots: np.ndarray, tree) -> None:
        table = pa.Table.from_batches(self.parts)
        self.parts = []
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "id", "label"))
        self.v = _matrix(table["v"].combine_chunks(), dims)
        self.length = np.sqrt((self.v**2).sum(1))
        self.pivots, (self.parent, self.edge) = pivots, tree
        self.size = np.sqrt((pivots**2).sum(1))
        self.known: dict[int, tuple] = {}

    def widened(self, low, high, edge: float, size: float):
        """Bounds of a child from those of its parent, with a hair for rounding."""
        reach = self.length * (edge * (1 + ROOM) + ROOM * size)
        return low - reach, high + reach

    def of_pivot(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all rows' scores with a pivot, down the tree from its root."""
        path = [p]
        while path[-1] not in self.known and self.parent[path[-1]] >= 0:
            path.append(int(self.parent[path[-1]]))
        for q in reversed(path):
            if q in self.known:
                continue
            if self.parent[q] < 0:
                exact = self.v @ self.pivots[q]
                self.known[q] = exact, exact
            else:
                self.known[q] = self.widened(*self.known[int(self.parent[q])], self.edge[q], self.size[q])
        return self.known[p]

    def refine(self, p: int, reach: float, mine: np.ndarray, least: float, most: float):
        """Score those of ``mine`` with the pivot that may lie in the window of a
        child at up to ``reach`` from it; the bounds of the others stay."""
        low, high = self.of_pivot(p)
        wide_low, wide_high = self.widened(low, high, reach, self.size[p])
        some = np.flatnonzero(mine & ~(wide_high < least) & ~(wide_low > most))
        low, high = low.copy(), high.copy()
        low[some] = high[some] = self.v[some] @ self.pivots[p]
        self.known[p] = low, high
        return low, high


def _best(scores, ids, rows, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, then the smaller row."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= cut)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((rows[place], ids[place], -scores[place]))][:k]


def _positives(block: _Block, anchor: dict, low, high, k: int):
    """Best rows of the anchor's label: ``(place, score)``."""
    mine = np.flatnonzero((block.label == anchor["label"]) & (block.row != anchor["row"]))
    if not len(mine):
        return mine, mine
    v = np.array(anchor["v"], float)
    if len(mine) > 4 * k:
        # The best bounds set a floor that upper bounds have to reach.
        some = mine[np.argpartition(-low[mine], 2 * k)[: 2 * k]]
        floor = np.sort(_products(v[None], block.v[some])[0])[-k]
        mine = mine[~(high[mine] < floor)]
    scores = _products(v[None], block.v[mine])[0]
    top = _best(scores, block.id[mine], block.row[mine], k)
    return mine[top], scores[top]


def _window(scores: list[int], low: int, high: int) -> tuple[float, float]:
    """Least and greatest score that a negative of any of the positives may have."""
    return min(low * p / 100 for p in scores), max(high * p / 100 for p in scores)


def _negatives(block: _Block, anchor: dict, lows, highs, k: int, low: int, high: int):
    """Per positive score, best rows of other labels within its window:
    ``(positive score, place, score)``."""
    positives = sorted(set(anchor["scores"]))
    least, most = _window(positives, low, high)
    mine = np.flatnonzero((block.label != anchor["label"]) & ~(highs < least) & ~(lows > most))
    if not len(mine):
        return
    scores = _products(np.array(anchor["v"], float)[None], block.v[mine])[0]
    for p in positives:
        inside = np.flatnonzero((scores >= -((-low * p) // 100)) & (scores <= high * p // 100))
        top = inside[_best(scores[inside], block.id[mine[inside]], block.row[mine[inside]], k)]
        for t in top.tolist():
            yield p, mine[t], scores[t]


def _visit(pivots, kind: str, k: int, low: int, high: int):
    """One block and the anchors that visit it, anchors after rows."""
    found_names = ["anchor_row", "anchor_id", "positive_score", "row", "id", "score"]

    def solve(block: _Block, anchors: list[dict]):
        out: list[tuple] = []
        for p in sorted({a["pivot"] for a in anchors}):
            mine = [a for a in anchors if a["pivot"] == p]
            reach = max(a["edge"] for a in mine)
            labels = np.isin(block.label, [a["label"] for a in mine])
            if kind == "positives":
                block.refine(p, reach, labels, -np.inf, np.inf)
            else:
                windows = [_window(a["scores"], low, high) for a in mine]
                others = np.ones(len(labels), bool) if len({a["label"] for a in mine}) > 1 else ~labels
                block.refine(p, reach, others, min(w[0] for w in windows), max(w[1] for w in windows))
            for a in mine:
                bounds = block.widened(*block.known[p], a["edge"], block.size[p] + a["edge"])
                if kind == "positives":
                    place, scores = _positives(block, a, *bounds, k)
                    hits = ((None, t, s) for t, s in zip(place.tolist(), scores.tolist()))
                else:
                    hits = _negatives(block, a, *bounds, k, low, high)
                out += [
                    (a["row"], a["id"], s_p, int(block.row[t]), int(block.id[t]), int(s)) for s_p, t, s in hits
                ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], found_names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, open_ = None, None, False
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "dims", "is_anchor")], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part, mine = batch.slice(a, b - a), tuple(key[a][:2].tolist())
                if not key[a][2]:
                    if mine != now:
                        now, block, open_ = mine, _Block(), True
                    block.add(part.select(["row", "id", "label", "v"]))
                elif mine == now:
                    if open_:
                        block.ready(mine[1], pivots.value.of[mine[1]], pivots.value.tree[mine[1]])
                        open_ = False
                    for i in range(0, len(part), 1024):
                        yield from solve(block, part.slice(i, 1024).to_pylist())

    return work


RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)
FOUND = "anchor_row bigint, anchor_id bigint, positive_score bigint, row bigint, id bigint, score bigint"


def hard_negatives(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors: str = "id % 50 = 0",
    relabel: str = "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
) -> DataFrame:
    """For each anchor and positive its hardest negatives: ``anchor_id``,
    ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and
    ``negative_score``.

    ``anchors`` and ``relabel`` are SQL over ``id`` and ``label``: which rows are
    anchors, and what label counts. Components count as ``floor(scale * x)``, a
    score is the inner product with the anchor, higher first, ties to the smaller
    id. Positives are the first other rows of the anchor's label, negatives the
    first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows without id, label or vector, and those with a component that is NULL or
    not finite, take no part; empty vectors do, with score 0. A row meets rows of
    its own dimension only. Repeated rows are rows of their own, also as anchors:
    each is another row for the other. An empty table gives an empty one; other
    columns are ignored. Scores beyond 64 bits are clipped to them.

    Rows cross the network to be sorted into blocks and for each of the two visits,
    anchors once for each block whose bounds meet their window. A task holds one
    block at a time. Anchors of more than 1,024 different dimensions are refused.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = _whole(vectors, vec_id, vector, label, scale).withColumn("label", F.expr(relabel).cast("bigint"))
    rows = _written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    is_anchor = F.coalesce(F.expr(anchors), F.lit(False))
    size = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("asking"))
    size = size.filter("asking > 0").agg(
        F.max("dims").alias("widest"), F.count(F.lit(1)).alias("kinds"), F.max("asking").alias("asking"),
        F.sum("n").alias("n"),
    ).first()
    if not size["kinds"]:
        return spark.createDataFrame([], RESULT)
    if size["kinds"] > MOST_KINDS:
        raise ValueError(f"anchors have more than {MOST_KINDS} different dimensions")
    wide = 8 * max(size["widest"], 1)
    most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (wide * size["kinds"]), round(size["asking"] ** 0.5)))
    by_hash = Window.partitionBy("dims").orderBy(F.xxhash64("row"), "row")
    drawn = rows.filter(is_anchor).withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= most)
    pivots = spark.sparkContext.broadcast(Pivots([(r["k"], r["v"]) for r in drawn.select("k", "v").collect()]))
    known = sorted(pivots.value.of)
    assigned = _assign(pivots)
    placed = rows.filter(F.col("dims").isin(known)).mapInArrow(
        released(assigned), "id bigint, label bigint, v array<double>, dims int, row bigint, pivot bigint, edge double"
    )
    each = max(1, min(BLOCK_BYTES // wide, MOST_ROWS, max(LEAST_ROWS, size["n"] // 64)))
    blocks = -(-size["n"] // each)
    blocked = placed.repartitionByRange(blocks, "label", "pivot", "row")
    blocked = _written(blocked.withColumn("part", F.spark_partition_id()), "blocks")
    # Neighbouring partitions make up a block, however many there are of them.
    made = blocked.agg(F.max("part")).first()[0] + 1
    block = F.floor(F.col("part") * F.lit(blocks) / F.lit(made)) if made > blocks else F.col("part")
    blocked = blocked.withColumn("block", block.cast("int")).drop("part")
    parts = blocked.select("block", "dims", "label", "v").mapInArrow(released(_summaries(pivots)), SUMMARY)
    summary = parts.groupBy("block", "dims", "pivot").agg(
        *[F.min(c).alias(c) for c in ("low", "first_label")],
        *[F.max(c).alias(c) for c in ("high", "length", "last_label")],
    )
    summary = _written(summary, "bounds")
    asking = _written(
        blocked.filter(is_anchor).select("row", "id", "label", "dims", "v", "pivot", "edge"), "anchors"
    )
    columns = ["block", "dims", "is_anchor", "pivot", "row", "id", "label", "v", "edge", "scores"]

    def visited(guests: DataFrame, kind: str, k: int) -> DataFrame:
        there = blocked.withColumns(
            {"is_anchor": F.lit(0), "scores": F.lit(None).cast("array<bigint>"), "pivot": F.lit(-1).cast("bigint")}
        )
        here = guests.withColumn("is_anchor", F.lit(1))
        met = there.select(*columns).unionByName(here.select(*columns))
        # Rows before anchors, these by pivot, so that pivot scores serve all children.
        met = met.repartition(blocks, "block").sortWithinPartitions("block", "dims", "is_anchor", "pivot")
        return met.mapInArrow(released(_visit(pivots, kind, k, low, high)), FOUND)

    to_block = asking.join(summary, ["dims", "pivot"])
    own = to_block.filter(F.col("label").between(F.col("first_label"), F.col("last_label")))
    own = own.withColumn("scores", F.lit(None).cast("array<bigint>"))
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    first = visited(own, "positives", positives).withColumn("k", F.row_number().over(best))
    first = _written(
        first.filter(F.col("k") <= positives).select(
            "anchor_row", "anchor_id", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ), "positives",
    )
    scores = first.groupBy(F.col("anchor_row").alias("row")).agg(
        F.collect_set("positive_score").alias("scores")
    )
    reach = F.col("edge") * F.col("length") * (1 + 1e-6) + 1
    bounds = {
        "top": F.array_max(F.transform("scores", lambda s: s.cast("double") * high / 100)),
        "bottom": F.array_min(F.transform("scores", lambda s: s.cast("double") * low / 100)),
    }
    others = (
        asking.join(scores, "row")
        .withColumns(bounds)
        .join(summary, ["dims", "pivot"])
        .filter(~((F.col("first_label") == F.col("label")) & (F.col("last_label") == F.col("label"))))
        .filter((F.col("high") + reach >= F.col("bottom")) & (F.col("low") - reach <= F.col("top")))
    )
    ranked = Window.partitionBy("anchor_row", "positive_score").orderBy(F.desc("score"), "id", "row")
    found = visited(others, "negatives", negatives).withColumn("rank", F.row_number().over(ranked))
    found = found.filter(F.col("rank") <= negatives).select(
        "anchor_row", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return first.join(found, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
