"""Phrases whose words belong together, by set-oriented mining of occurrences.

The occurrences of phrases of k words are a stored relation, sorted by place. A
place tells piece and position: it counts words and leaves a gap after each
piece. One length follows from the one before:

1. Merge join: an occurrence whose neighbour stands one place further on is an
   occurrence of a phrase of k + 1 words. Both sides are the same sorted run.
2. Group and count: every *block* of the relation (the occurrences of one task in
   one language) counts its groups; the counts of all blocks are added up. Most
   groups are rare, so the counts are first added up by a short hash of the group:
   a hash with too few occurrences has no frequent group. The others travel as
   text, one row for each block that has them, so counts are exact and the most
   frequent phrase takes no more rows than there are blocks.
3. Semi-join: the blocks learn which of their groups are frequent; the
   occurrences of the others go before the next length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import released, ship, slices
from gridseries.llm.near_dup import _mixed
from gridseries.session import discard, scratch_path

# Words of a block, beyond its last piece; more texts begin a new one.
BLOCK_WORDS = 1 << 22
# Bits of the hash by which groups are counted first.
HASH_BITS = 40
# Groups in one row of a level's table.
ROW_GROUPS = 1 << 16
UNKNOWN = "und"
_ODD = np.random.default_rng(13).integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)

_BOUNDARY = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
LEVEL = "block bigint, lang string, start int, phrases array<string>, counts array<int>, places binary, groups binary"
LEVEL_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("start", pa.int32()),
        ("phrases", pa.list_(pa.string())),
        ("counts", pa.list_(pa.int32())),
        ("places", pa.binary()),
        ("groups", pa.binary()),
    ]
)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, byte place by byte place, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block(number, lang, phrases: list, counts, places, groups) -> Iterator[pa.RecordBatch]:
    """Rows of one block: its groups in chunks, the occurrences with the first."""
    for start in range(0, max(len(phrases), 1), ROW_GROUPS):
        first = start == 0
        yield pa.RecordBatch.from_pydict(
            {
                "block": [number],
                "lang": [lang],
                "start": [start],
                "phrases": [phrases[start : start + ROW_GROUPS]],
                "counts": [counts[start : start + ROW_GROUPS].tolist()],
                "places": [_packed(np.diff(places, prepend=0)) if first else None],
                "groups": [_packed(groups) if first else None],
            },
            schema=LEVEL_SCHEMA,
        )


class _Words:
    """The word occurrences of one block, as texts are added to it."""

    def __init__(self):
        self.known: dict[bytes, int] = {b".": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        data = ".".join(texts).encode().lower().translate(_BOUNDARY)
        known = self.known
        words = data.replace(b".", b" . ").split()
        ids = [known.setdefault(w, len(known)) for w in words]
        # A boundary after the texts, as others may follow.
        self.parts.append(np.array([*ids, 0], np.uint32))
        self.size += len(ids)

    def rows(self, number: int, lang: str) -> Iterator[pa.RecordBatch]:
        met = np.concatenate(self.parts)
        words = list(self.known)
        # Frequent words have small numbers, which take less room.
        times = np.bincount(met, minlength=len(words)).tolist()
        order = sorted(range(1, len(words)), key=lambda i: (-times[i], words[i]))
        new = np.zeros(len(words), np.uint32)
        new[order] = np.arange(len(order), dtype=np.uint32)
        places = np.flatnonzero(met)
        if not len(places):
            return
        groups = new[met[places]]
        counts = np.bincount(groups, minlength=len(order))
        yield from _block(number, lang, [words[i].decode() for i in order], counts, places, groups)


def _word_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in, blocks of word occurrences out; a block has one language."""
    task, made = TaskContext.get().partitionId(), 0
    open_: dict[str, _Words] = {}
    for batch in batches:
        # Texts of one language together, so that each is searched in few steps.
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine = batch.column("text").filter(pa.compute.equal(langs.indices, i))
            for texts in slices(mine):
                block = open_.setdefault(lang, _Words())
                block.add([t for t in texts if t])
                # However many languages there are, a task holds one block's words.
                if sum(b.size for b in open_.values()) >= BLOCK_WORDS:
                    most = max(open_, key=lambda x: open_[x].size)
                    yield from open_.pop(most).rows((task << 24) + made, most)
                    made += 1
    for lang, block in open_.items():
        yield from block.rows((task << 24) + made, lang)
        made += 1


PAIRS = "block bigint, lang string, places binary, groups binary, phrases array<string>, bucket int, hashes binary, counts binary"
PAIRS_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("places", pa.binary()),
        ("groups", pa.binary()),
        ("phrases", pa.list_(pa.string())),
        ("bucket", pa.int32()),
        ("hashes", pa.binary()),
        ("counts", pa.binary()),
    ]
)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as one holds a whole block."""
    for batch in batches:
        for i in range(len(batch)):
            yield {n: c[i] for n, c in zip(batch.schema.names, batch.columns)}


def _neighbours(lang: str, places, groups, phrases: list[str]):
    """Merge join of a block's occurrences with themselves, one place further on:
    places, pairs of groups, which pair each place has, counts, hashes."""
    import xxhash

    at = np.flatnonzero(np.diff(places) == 1)
    pair = groups[at] * len(phrases) + groups[at + 1]
    met, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
    own = np.array([xxhash.xxh3_64_intdigest(f"{lang} {t}") for t in phrases], np.uint64)
    left, right = met // max(len(phrases), 1), met % max(len(phrases), 1)
    hashes = _mixed(own[left] * _ODD[0] + _mixed(own[right] * _ODD[1])) >> np.uint64(64 - HASH_BITS)
    return places[at], left, right, inverse, counts, hashes


def _paired(buckets: int):
    """Blocks with their frequent groups in; out come the occurrences of these, and
    how often each hash of a pair of neighbours is met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            block, lang = row["block"].as_py(), row["lang"].as_py()
            places = np.cumsum(_unpacked(row["places"].as_py()).astype(np.int64))
            groups = _unpacked(row["groups"].as_py()).astype(np.int64)
            found = row["frequent"].values.flatten()
            order = np.argsort(found[0].to_numpy())
            kept = np.full(int(groups.max()) + 1, -1, np.int64)
            kept[found[0].to_numpy()[order]] = np.arange(len(order))
            phrases = found[1].take(pa.array(order)).to_pylist()
            # Semi-join with the frequent groups; those without a neighbour go too.
            groups = kept[groups]
            stay = groups >= 0
            places, groups = places[stay], groups[stay]
            beside = np.zeros(len(places), bool)
            beside[1:] = np.diff(places) == 1
            beside[:-1] |= beside[1:]
            places, groups = places[beside], groups[beside]
            if not len(places):
                continue
            _, _, _, _, counts, hashes = _neighbours(lang, places, groups, phrases)
            rows = [(block, lang, _packed(np.diff(places, prepend=0)), _packed(groups), phrases, -1, None, None)]
            hashes, of = np.unique(hashes, return_inverse=True)
            counts = np.bincount(of, weights=counts).astype(np.int64)
            bucket = ((hashes * np.uint64(buckets)) >> np.uint64(HASH_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
                rows.append(
                    (block, None, None, None, None, int(bucket[lo]), _packed_hashes(hashes[lo:hi]), _packed(counts[lo:hi]))
                )
            for lo in range(0, len(rows), 256):
                columns = zip(*rows[lo : lo + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, PAIRS_SCHEMA)], schema=PAIRS_SCHEMA
                )

    return work


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their differences, in two halves."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    low = _packed(steps & np.uint64(0xFFFFFFFF))
    return len(low).to_bytes(8, "little") + low + _packed(steps >> np.uint64(32))


def _unpacked_hashes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    low, high = _unpacked(data[8 : 8 + size]), _unpacked(data[8 + size :])
    return np.cumsum(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def _enough(least: int):
    """Hashes of blocks and their counts in; out, for each block, those that all
    blocks together have often enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, parts, counts = [], [], []
        for row in _rows_of(batches):
            blocks.append(row["block"].as_py())
            parts.append(_unpacked_hashes(row["hashes"].as_py()))
            counts.append(_unpacked(row["counts"].as_py()))
        if not parts:
            return
        met, of = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.bincount(of, weights=np.concatenate(counts)) >= least
        ends = np.cumsum([len(p) for p in parts])
        for block, part, end in zip(blocks, parts, ends):
            some = part[often[of[end - len(part) : end]]]
            if len(some):
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "often": [_packed_hashes(some)]},
                    schema=pa.schema([("block", pa.int64()), ("often", pa.binary())]),
                )

    return work


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the hashes that are met often in; blocks of the next length out."""
    for row in _rows_of(batches):
        lang, phrases = row["lang"].as_py(), row["phrases"].as_py()
        places = np.cumsum(_unpacked(row["places"].as_py()).astype(np.int64))
        groups = _unpacked(row["groups"].as_py()).astype(np.int64)
        often = np.concatenate([_unpacked_hashes(x) for x in row["often"].as_py()])
        places, left, right, inverse, counts, hashes = _neighbours(lang, places, groups, phrases)
        kept = np.isin(hashes, often)
        order = np.flatnonzero(kept)
        order = order[np.argsort(-counts[order], kind="stable")]
        new = np.zeros(len(kept), np.int64)
        new[order] = np.arange(len(order))
        stay = kept[inverse]
        last = [t.rsplit(" ", 1)[-1] for t in phrases]
        texts = [f"{phrases[i]} {last[j]}" for i, j in zip(left[order].tolist(), right[order].tolist())]
        yield from _block(row["block"].as_py(), lang, texts, counts[order], places[stay], new[inverse[stay]])


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _counted(level: DataFrame, least: int) -> DataFrame:
    """Frequent groups with their count, a row for each block that has them."""
    group = F.posexplode(F.arrays_zip("phrases", "counts"))
    posted = level.select("block", "lang", "start", group.alias("i", "x")).select(
        "block", "lang", (F.col("start") + F.col("i")).alias("group"), "x.phrases", "x.counts"
    )
    same = Window.partitionBy("lang", "phrase")
    posted = posted.withColumnsRenamed({"phrases": "phrase", "counts": "c"})
    return (
        posted.withColumns({"f": F.sum("c").over(same), "lead": F.min("block").over(same)})
        .filter(F.col("f") >= least)
        .select("lang", "phrase", "f", "block", "group", (F.col("block") == F.col("lead")).alias("lead"))
    )


def frequent_phrases(
    documents: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    longest: int = 5,
    least: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words met at least ``least`` times, and totals.

    The first table has ``lang``, ``words`` (how many), ``phrase`` (joined by one
    space) and ``f``; single words are among them. The second has ``lang`` and
    ``n``, all word occurrences. See :func:`collocations` for what words are. Both
    are read from the scratch folder.
    """
    ship(documents.sparkSession)
    rows = documents.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = _written(rows.mapInArrow(released(_word_occurrences), LEVEL), "occurrences1")
    totals = level.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("c"))
    totals = _written(totals.groupBy("lang").agg(F.sum("c").alias("n")), "words")
    found = None
    for words in range(1, longest + 1):
        frequent = _written(_counted(level, least), f"frequent{words}")
        once = frequent.filter("lead").select("lang", F.lit(words).alias("words"), "phrase", "f")
        found = once if found is None else found.unionByName(once)
        if words == longest:
            break
        # Bounded by the groups of one block.
        of_block = frequent.groupBy("block").agg(
            F.collect_list(F.struct("group", "phrase")).alias("frequent")
        )
        met = level.filter("places IS NOT NULL").select("block", "lang", "places", "groups")
        pairs = _written(met.join(of_block, "block").mapInArrow(released(_paired(n)), PAIRS), f"pairs{words}")
        discard(spark, level)
        posted = pairs.filter("bucket >= 0").select("bucket", "block", "hashes", "counts")
        often = posted.repartition(n, "bucket").mapInArrow(released(_enough(least)), "block bigint, often binary")
        often = often.groupBy("block").agg(F.collect_list("often").alias("often"))
        met = pairs.filter("places IS NOT NULL").drop("bucket", "hashes", "counts")
        level = _written(met.join(often, "block").mapInArrow(released(_longer), LEVEL), f"occurrences{words + 1}")
        discard(spark, pairs)
    discard(spark, level)
    return found, totals


def exact_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """``floor(1000 * a * b / (c * d))`` of positive numbers, whose products may
    pass 64 bits."""
    wide = "decimal(19,0)"
    top = (F.lit(1000) * a).cast(wide) * b.cast(wide)
    return F.call_function("div", top, c.cast(wide) * d.cast(wide))


def collocations(
    documents: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    longest: int = 5,
    least: int = 100,
    top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank`` from 1,
    ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Texts are cut at ``. , ; : ! ?`` and line ends into pieces, these at spaces
    and tabs into words, with A-Z lowered. ``a`` counts the places of a phrase of
    2 to ``longest`` words within pieces, ``n`` all words of the language, ``l``
    and ``r`` the two parts of the cut at which ``floor(1000 * a * n / (l * r))``
    is least (of equal ones the first cut). Phrases met fewer than ``least`` times
    are left out, then those within a longer one that is as frequent. Order is by
    score, ``a``, both descending, then by the phrase's bytes.

    NULL or empty texts have no words, a NULL language counts as ``und``, and
    repeated rows count each. An empty table gives an empty one. Other columns
    are ignored, whatever their names. Memory of a task grows with the longest
    text, beyond a block of some four million words.
    """
    found, totals = frequent_phrases(documents, text=text, lang=lang, longest=longest, least=least)
    return score_phrases(found, totals, top=top)


def score_phrases(found: DataFrame, totals: DataFrame, *, top: int = 2000) -> DataFrame:
    """Score, thin out and rank what :func:`frequent_phrases` has found."""
    # Parts of a frequent phrase are frequent, so both are in the table.
    several = found.filter("words > 1")
    cuts = several.select(
        "lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    cuts = cuts.withColumns(
        {
            "first": F.expr("substring_index(phrase, ' ', k)"),
            "rest": F.expr("substring_index(phrase, ' ', k - words)"),
        }
    )
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", exact_ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # A phrase within a longer one that is as frequent lies within one of one word
    # more that is so: those between are as frequent too.
    longer = found.filter("words > 2")
    shorter = F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")
    )
    within = longer.select("lang", F.explode(shorter).alias("phrase"), F.col("f").alias("a"))
    left_over = best.join(within, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = left_over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score"
    )
