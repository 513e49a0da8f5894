"""Near duplicates by a join of inverted signature coordinates.

1. Every document becomes a set of word shingles; of each set a signature of
   ``coordinates`` minima is kept. Documents with equal sets are one class, and
   the document of least id stands for it.
2. A class is posted under each of its coordinate values. Values of one class
   only cannot collide and go. Two classes link only if at least ``matches``
   coordinates collide; so, with m values left, a class may skip its matches - 1
   most frequent values: of the m - matches + 1 rarest of both at least one is
   common. Only these prefixes are merged.
3. Classes that share a prefix value, directly or through others, form a
   cluster. In it the collisions of every pair are counted on the whole
   signatures, and pairs with enough of them are compared by their full sets.
   Large clusters are dealt out as pairs of chunks of bounded size; a task gives
   out the links that join parts, never all pairs.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import released, ship, turn, with_results
from gridseries.llm._components import connected
from gridseries.session import scratch_path

COORDINATES = 64
# A pair at 80 % similarity has fewer collisions than this once in 3 million pairs.
MATCHES = 34
# Shingles that a chunk of a cluster holds, beyond its first document, and documents.
CHUNK_SHINGLES = 1 << 19
CHUNK_DOCUMENTS = 512
REMEMBERED = 200_000

_RNG = np.random.default_rng(3)
_ODD = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_FACTORS = _RNG.integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**64, 1024, dtype=np.uint64)
_WORDS: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known = _WORDS
    found = list(map(known.get, words))
    if None in found:
        if len(known) > REMEMBERED:
            known.clear()
        for i, h in enumerate(found):
            if h is None:
                w = words[i]
                found[i] = h = xxhash.xxh3_64_intdigest(w)
                if len(w) < 64:
                    known[w] = h
    return np.array(found, np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; see :func:`near_duplicates`."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    if len(h) < size:
        size = len(h)
    count = len(h) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = _mixed(total * _ODD[i] + h[i : i + count])
    return np.unique(total)


def _signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Least hash under each of several functions, marked with its coordinate."""
    out = np.empty(coordinates, np.uint64)
    for i in range(coordinates):
        out[i] = (found * _FACTORS[i] + _SHIFTS[i]).min()
    return _mixed(out + np.arange(coordinates, dtype=np.uint64) * _ODD[7])


def _sketch(size: int, coordinates: int):
    def work(texts: pa.Array) -> pa.Array:
        turn("near_dup", _WORDS.clear)
        counts, first, second, keys = [], [], [], []
        for t in texts:
            found = shingles(t.as_buffer().to_pybytes() if t.is_valid else None, size)
            counts.append(len(found))
            if len(found):
                # The set's own identity: two independent sums over its elements.
                first.append(int(_mixed(found + _ODD[8]).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(_mixed(found * _ODD[9]).sum(dtype=np.uint64).view(np.int64)))
                keys.append(_signature(found, coordinates))
            else:
                first.append(0)
                second.append(0)
        ends = np.concatenate([[0], np.cumsum([coordinates * (c > 0) for c in counts])])
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(first, pa.int64()),
                pa.array(second, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
            ],
            ["n_shingles", "h1", "h2", "keys"],
        )

    return work


def _sets(size: int):
    def work(texts: pa.Array) -> pa.Array:
        turn("near_dup", _WORDS.clear)
        found = [
            shingles(t.as_buffer().to_pybytes() if t.is_valid else None, size).tobytes()
            for t in texts
        ]
        return pa.StructArray.from_arrays([pa.array(found, pa.binary())], ["shingles"])

    return work


class _Forest:
    """Union of small integers; remembers the joins that changed anything."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _linked(ids, sizes, keys, sets, first, percent, matches) -> Iterator[tuple[int, int]]:
    """Links that join parts, among pairs of a chunk and another or itself.

    ``first`` tells the rows of the first chunk; pairs within the second one are
    another task's, unless there is one chunk only.
    """
    n = len(ids)
    forest = _Forest(n)
    one = first.all()
    for i in range(n - 1):
        others = np.arange(i + 1, n)
        if not one:
            others = others[first[others] != first[i]]
        # Sizes that are too far apart rule a link out.
        a, b = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[100 * a >= percent * b]
        if not len(others):
            continue
        others = others[(keys[others] == keys[i]).sum(1) >= matches]
        mine = sets[i]
        for j in others.tolist():
            if forest.find(i) == forest.find(j):
                continue
            theirs = sets[j]
            where = np.searchsorted(theirs, mine)
            where[where == len(theirs)] = 0
            common = int((theirs[where] == mine).sum())
            if 100 * common >= percent * (len(mine) + len(theirs) - common):
                forest.join(i, j)
                yield ids[i], ids[j]


def _link_groups(percent: int, matches: int):
    """Sorted rows of clusters' chunk pairs in, links out; one group at a time."""

    def solve(rows):
        ids, sizes, keys, sets, first = zip(*rows)
        order = np.argsort(ids, kind="stable")
        pick = [list(c) for c in (ids, keys, sets)]
        ids, keys, sets = ([c[i] for i in order] for c in pick)
        return list(
            _linked(
                ids,
                np.array(sizes, np.int64)[order],
                np.array(keys),
                sets,
                np.array(first)[order],
                percent,
                matches,
            )
        )

    def out(links):
        a, b = zip(*links)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def work(batches):
        turn("near_dup", _WORDS.clear)
        now, rows = None, []
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            group = list(zip(columns["cluster"].to_pylist(), columns["i"].to_pylist(), columns["j"].to_pylist()))
            chunk = columns["chunk"].to_pylist()
            ids = columns["rep"].to_pylist()
            flat = columns["keys"].flatten().to_numpy()
            width = len(flat) // len(ids) if ids else 0
            for r, key in enumerate(group):
                if key != now:
                    if len(rows) > 1 and (links := solve(rows)):
                        yield out(links)
                    now, rows = key, []
                found = np.frombuffer(columns["shingles"][r].as_py(), np.uint64)
                own = flat[r * width : (r + 1) * width].copy()
                rows.append((ids[r], len(found), own, found, chunk[r] == key[1]))
        if len(rows) > 1 and (links := solve(rows)):
            yield out(links)

    return work


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """Rarest values of each class, all but the ``matches - 1`` most frequent."""
    posted = reps.select("rep", F.explode("keys").alias("key"))
    common = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = posted.join(common, "key").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("values")
    )
    # At most one value for each coordinate, so the lists are short.
    return ranked.filter(F.size("values") >= matches).select(
        "rep",
        F.explode(F.slice("values", F.lit(1), F.size("values") - matches + 1).getField("key")).alias("key"),
    )


def _chunked(members: DataFrame, percent: int) -> DataFrame:
    """Number the chunks of each cluster; a chunk is small enough for one task.

    A cluster that fits is one chunk. The others are dealt by class of size,
    so that only neighbouring classes can link, and within a class by a hash
    into as many parts as its totals ask for. No task sees a whole cluster.
    """
    grade = F.floor(F.ln(F.col("n_shingles").cast("double")) / math.log(100 / percent))
    graded = members.withColumn("grade", grade)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")]
    classes = graded.groupBy("cluster", "grade").agg(*sums)
    whole = classes.groupBy("cluster").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    fits = (F.col("all_n") <= CHUNK_DOCUMENTS) & (F.col("all_s") <= CHUNK_SHINGLES)
    parts = F.ceil(F.greatest(F.col("n") / CHUNK_DOCUMENTS, F.col("s") / CHUNK_SHINGLES))
    plan = classes.join(whole, "cluster").select(
        "cluster", "grade", F.when(~fits, parts).alias("parts")
    )
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    chunk = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("grade") * (1 << 24) + part + 1)
    return graded.join(plan, ["cluster", "grade"]).withColumn("chunk", chunk).drop("grade", "parts")


def near_duplicates(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id``, ``n_shingles``,
    ``component_id`` and ``kept``.

    Words are runs without ASCII white space, with A-Z lowered. The set of a
    document are its distinct shingles of ``words`` words; with fewer words the
    whole sequence is the only one; without words or text the set is empty and
    links with nothing. Documents link if 100 * common >= ``percent`` * union;
    ``component_id`` is the least ``doc_id`` reached over links and ``kept`` says
    whether it is the document's own. Repeated rows have equal sets and so one
    component; rows of one ``doc_id`` with different texts are joined by it. A
    document without ``doc_id`` has no component and is kept. An empty table
    gives an empty one, and other columns are ignored, whatever their names.

    Similarity is decided on the full sets; a linked pair is missed only if
    fewer than ``matches`` of ``coordinates`` values collide (once in three
    million pairs at the threshold for the defaults, less above it).
    """
    ship(documents.sparkSession)
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    sketches = _written(
        with_results(
            rows, "text", _sketch(words, coordinates),
            "n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>",
        ).drop("text"),
        "sketches",
    )
    full = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["h1", "h2", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    # The sketch of the class, from the row of least id; equal rows count once.
    reps = _written(
        full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *same])
        .select(F.col("doc_id").alias("rep"), *same, "keys")
        .dropDuplicates(["rep", *same]),
        "classes",
    )
    prefixes = _written(_prefixes(reps, matches), "prefixes")
    leaders = prefixes.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"))
    stars = prefixes.join(leaders.filter("n > 1"), "key").select("a", F.col("rep").alias("b"))
    clusters = connected(stars).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = _written(
        _chunked(reps.join(clusters, "rep").select("cluster", "rep", *same, "keys"), percent), "members"
    )
    texts = with_results(
        rows.join(
            members.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"),
            "doc_id",
            "left_semi",
        ),
        "text",
        _sets(words),
        "shingles binary",
    ).drop("text").withColumnRenamed("doc_id", "rep")
    # A pair of chunks is worth a task if sizes in them can be near enough.
    spans = members.groupBy("cluster", "chunk").agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")
    )
    left = spans.select("cluster", F.col("chunk").alias("i"), F.col("high").alias("top"))
    right = spans.select("cluster", F.col("chunk").alias("j"), F.col("low").alias("bottom"))
    pairs = left.join(right, "cluster").filter(
        (F.col("i") == F.col("j"))
        | ((F.col("i") < F.col("j")) & (100 * F.col("top") >= percent * F.col("bottom")))
    )
    tasks = pairs.select(
        "cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk")
    )
    loaded = members.join(texts, "rep").filter(
        F.octet_length("shingles") == 8 * F.col("n_shingles")
    )
    dealt = (
        loaded.join(tasks, ["cluster", "chunk"])
        .select("cluster", "i", "j", "chunk", "rep", "keys", "shingles")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j", "rep")
    )
    links = dealt.mapInArrow(released(_link_groups(percent, matches)), "a bigint, b bigint")
    # One id may stand for several texts.
    own = full.join(classes, same).select("doc_id", "rep")
    shared = own.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    split = full.groupBy("doc_id").agg(F.min("h1").alias("l"), F.max("h1").alias("h")).filter("l <> h")
    shared = shared.join(split.select(F.col("doc_id").alias("a")), "a", "left_semi")
    components = connected(links.union(shared))
    component = F.coalesce("component", "rep", "doc_id")
    by_class = classes.join(
        components.withColumnRenamed("node", "rep"), "rep", "left"
    )
    return (
        sketches.join(by_class, same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
