"""Removal of word strings that occur in earlier documents, by recompression.

Rounds rewrite every document. A round names runs of one symbol, then pairs of
neighbours of which the first belongs to the left half of the symbols and the
second to the right half (a hash of the symbol tells). A name is made from its
parts alone, so that it is the same in all documents and on all executors, and
no table of names is needed. What a symbol depends on is a stretch of words
around it, its *context*: where the words of a context occur again, so does the
symbol. Equal strings therefore get equal symbols wherever a context fits in.

* Every window of ``width`` words takes the symbol of the highest round whose
  context lies in it, of several the one of least hash, as its *anchor*. Equal
  windows have equal anchors at equal places. Neighbouring windows mostly share
  one; such a *run* travels as one record.
* Records meet by anchor. An anchor of one document alone says that its windows
  repeat in no other. Equal runs, by a hash of all their words, are settled at
  once: those of a later document go. Runs that differ, of an anchor that several
  documents share, are verified window by window, by two hashes of 64 bits of
  the whole window.
* Equal runs and windows are merged in each slice of text before they travel, so
  that a passage of many copies sends one record for each slice.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import fresh, released, ship, turn
from gridseries.llm._keys import keyed
from gridseries.llm.near_dup import _WORDS, _mixed, _word_hashes
from gridseries.llm.suffix_dedup import (
    _RUN,
    _WINDOW,
    REMOVED,
    ROWS,
    SPREAD,
    _blocks,
    _codes,
    _gathered,
    _least,
    _records,
    _text_rows,
)
from gridseries.session import stored

ROUNDS = 9
# Words of a context at most, as a share of the window.
CONTEXT = 0.5
# Words of text that a task works on at once; places in them need 20 bits.
SLICE_WORDS = 1 << 18
PLACE_BITS = 20
# Different runs of one anchor within a slice from which it counts as frequent.
FREQUENT = 32

_RNG = np.random.default_rng(12)
_ODD = _RNG.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
_BASES = [int(x) | 1 for x in _RNG.integers(2**62, 2**63, 2)]
_FAR = np.int64(1 << 40)


def symbols(words: np.ndarray, ends: np.ndarray, rounds: int, most: int):
    """Named symbols of documents that lie one after the other: (name, round,
    first word of the context, its length), for contexts of up to ``most`` words.

    Words are those of round 0. Nothing is named across the end of a document,
    and what depends on where a document ends has no context.
    """
    # A border before, between and after the documents; its context is endless.
    n = len(words) + len(ends) + 1
    border = np.zeros(n, bool)
    border[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])] = True
    name = np.zeros(n, np.uint64)
    name[~border] = words
    low = np.cumsum(~border) - 1
    high = low + 1
    low, high = np.where(border, -_FAR, low), np.where(border, _FAR, high)
    inner = ~border
    out = [(name[inner], np.zeros(len(words), np.int64), low[inner], np.ones(len(words), np.int64))]
    for r in range(1, rounds + 1):
        # Runs of one symbol. That one ends is known by its neighbours.
        first = np.ones(len(name), bool)
        first[1:] = (name[1:] != name[:-1]) | border[1:] | border[:-1]
        at = np.flatnonzero(first)
        stop = np.append(at[1:], len(name))
        length = stop - at
        before, after = np.maximum(at - 1, 0), np.minimum(stop, len(name) - 1)
        run_low = np.minimum(np.minimum.reduceat(low, at), np.minimum(low[before], low[after]))
        run_high = np.maximum(np.maximum.reduceat(high, at), np.maximum(high[before], high[after]))
        made = length > 1
        name = np.where(made, _mixed(name[at] * _ODD[0] + length.astype(np.uint64) * _ODD[1]), name[at])
        border, low, high = border[at], run_low, run_high
        out.append(_named(name, low, high, made, r, most))
        # Pairs of a left and a right symbol, which never overlap.
        left = (_mixed(name + _ODD[2:3] * np.uint64(r)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~border[:-1] & ~border[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # A pair needs both symbols; one alone, the neighbour it did not pair with.
        place = np.arange(len(name))
        other = np.clip(np.where(left, place + 1, place - 1), 0, len(name) - 1)
        low, high = np.minimum(low, low[other]), np.maximum(high, high[other])
        parts = np.flatnonzero(pair)
        name[parts] = _mixed(_mixed(name[parts] * _ODD[3]) + name[parts + 1] * _ODD[4])
        stay = ~second
        name, border, low, high, pair = (v[stay] for v in (name, border, low, high, pair))
        out.append(_named(name, low, high, pair, r, most))
    return [np.concatenate(c) for c in zip(*out)]


def _named(name, low, high, made, r, most):
    some = np.flatnonzero(made & (high - low <= most))
    return name[some], np.full(len(some), r, np.int64), low[some], high[some] - low[some]


def _hash_sums(words: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any part follows, and inverse powers."""
    base = _BASES[which]
    powers = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(len(words) + 1, b, np.uint64)
        steps[0] = 1
        powers.append(np.multiply.accumulate(steps))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(_mixed(words + _ODD[5 + which]) * powers[0][:-1], out=sums[1:])
    return sums, powers[1]


def _hash(sums, start, stop):
    total, inverse = sums
    return _mixed((total[stop] - total[start]) * inverse[start])


def _runs(words: np.ndarray, ends: np.ndarray, width: int):
    """Runs of windows with one anchor: (document, start, windows, anchor, words)."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    most = max(1, int(width * CONTEXT))
    if len(words) < width:
        return none
    name, level, low, _ = symbols(words, ends, ROUNDS, most)
    # The best symbol whose context begins at each word: high round, small hash.
    hashed = _mixed(name + level.astype(np.uint64) * _ODD[2])
    bits = np.uint64(64 - 4 - PLACE_BITS)
    key = ((np.uint64(15) - level.astype(np.uint64)) << np.uint64(60)) | (
        (hashed & ((np.uint64(1) << bits) - np.uint64(1))) << np.uint64(PLACE_BITS)
    )
    order = np.lexsort((key, low))
    head = order[np.flatnonzero(np.diff(low[order], prepend=-1))]
    # Every word is a symbol, so each place has one.
    best = key[head] | np.arange(len(words), dtype=np.uint64)
    least = _least(best, width - most + 1)
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    starts = np.arange(len(words) - width + 1)
    starts = starts[starts + width <= ends[document[starts]]]
    if not len(starts):
        return none
    anchor = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    start = starts[new]
    count = np.diff(new, append=len(starts))
    of_run = _hash(_hash_sums(words, 0), start, start + count - 1 + width)
    return document[start], start, count, hashed[head[anchor[new]]], of_run


def _slices(rows: Iterator[tuple], width: int):
    """Rows ``(.., bytes)`` in slices: rows, first word of each in its text, word
    hashes, ends. A long text is cut with an overlap of one window, so that every
    window lies whole in one slice."""
    held, firsts, parts, size = [], [], [], 0
    for row in rows:
        words = _word_hashes(bytes(row[-1]).split()) if len(row[-1]) else np.empty(0, np.uint64)
        for at in range(0, max(len(words) - width + 1, 0), SLICE_WORDS):
            part = words[at : at + SLICE_WORDS + width - 1]
            if held and size + len(part) > SLICE_WORDS + width:
                yield held, np.array(firsts), np.concatenate(parts), np.cumsum([len(p) for p in parts])
                held, firsts, parts, size = [], [], [], 0
            held.append(row)
            firsts.append(at)
            parts.append(part)
            size += len(part)
    if held:
        yield held, np.array(firsts), np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _groups(keys: list[np.ndarray], d: np.ndarray):
    """Order by the keys and the document; in it: is it the first of its group, and
    does it belong to a later document than its group's first."""
    order = np.lexsort([d, *keys[::-1]])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    group = np.cumsum(new) - 1
    first = d[order][np.flatnonzero(new)][group]
    return order, new, d[order] > first


def _post(width: int, buckets: int, columns: list[str]):
    """Texts in; runs out, packed by anchor."""

    def work(batches):
        turn("recompression", _WORDS.clear)
        for rows, firsts, words, ends in _slices(_text_rows(batches, columns), width):
            began = np.concatenate([[0], ends[:-1]])
            doc, start, count, g, r = _runs(words, ends, width)
            if not len(doc):
                continue
            a = start - began[doc] + firsts[doc]
            d = np.array([row[0] for row in rows], np.int64)[doc]
            x = np.array([row[1] for row in rows], np.int64)[doc]
            order, _, late = _groups([g, r, count], d)
            gone = order[late]
            if len(gone):
                yield _codes(d[gone], x[gone], a[gone], count[gone], REMOVED)
            left = order[~late]
            records = np.empty(len(left), _RUN)
            for field, column in zip("grdxan", (g, r, d, x, a, count)):
                records[field] = column[left]
            # How many different runs each anchor has here.
            heads = np.flatnonzero(np.diff(records["g"], prepend=~records["g"][:1]))
            sizes = np.diff(heads, append=len(records))
            often = sizes >= FREQUENT
            if often.any():
                marks = records[heads[often]].copy()
                marks["n"] = 0
                hot = np.repeat(often, sizes)
                h = records[hot]
                yield _codes(h["d"], h["x"], h["a"], h["n"], SPREAD)
                records = np.concatenate([records[~hot], marks])
            yield from _blocks(records, buckets)

    return work


def _meet(batches):
    """Runs of an anchor meet: equal ones of later documents go; different ones of
    an anchor that documents share are asked for window by window."""
    passed: list = []
    held = _gathered(batches, passed)
    yield from passed
    if not held:
        return
    rec = np.concatenate([_records(b, _RUN) for b in held])
    order, _, late = _groups([rec["g"], rec["r"], rec["n"]], rec["d"])
    rec = rec[order]
    mark = rec["n"] == 0
    gone = rec[late & ~mark]
    if len(gone):
        yield _codes(gone["d"], gone["x"], gone["a"], gone["n"], REMOVED)
    g = rec["g"]
    group = np.cumsum(np.diff(g, prepend=~g[:1]) != 0) - 1
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    shared = np.minimum.reduceat(rec["d"], heads) < np.maximum.reduceat(rec["d"], heads)
    frequent = np.maximum.reduceat(mark, heads)
    differ = np.minimum.reduceat(rec["r"], heads) != np.maximum.reduceat(rec["r"], heads)
    differ |= np.minimum.reduceat(rec["n"], heads) != np.maximum.reduceat(rec["n"], heads)
    ask = rec[~late & ~mark & ((shared & differ) | frequent)[group]]
    if len(ask):
        yield _codes(ask["d"], ask["x"], ask["a"], ask["n"], SPREAD)


def _verify(width: int, buckets: int, columns: list[str]):
    """Texts with the runs asked for in; their windows out, packed by hash."""

    def work(batches):
        turn("recompression", _WORDS.clear)
        for rows, firsts, words, ends in _slices(_text_rows(batches, columns), width):
            began = np.concatenate([[0], ends[:-1]])
            places, whose = [], []
            for i, row in enumerate(rows):
                code = np.asarray(row[2], np.int64)
                code = code[code & 3 == SPREAD]
                a, n = (code >> 9) - firsts[i], (code >> 2) & 127
                # Runs that begin in this part of the text; the next one has the others.
                mine = (a >= 0) & (a < SLICE_WORDS)
                a, n = a[mine], n[mine]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places.append(began[i] + np.repeat(a, n) + step)
                whose.append(np.full(len(step), i))
            place, which = np.concatenate(places), np.concatenate(whose)
            if not len(place):
                continue
            keys = [_hash(_hash_sums(words, k), place, place + width) for k in (0, 1)]
            d = np.array([row[0] for row in rows], np.int64)[which]
            x = np.array([row[1] for row in rows], np.int64)[which]
            a = place - began[which] + firsts[which]
            order, _, late = _groups(keys, d)
            gone = order[late]
            if len(gone):
                yield _codes(d[gone], x[gone], a[gone], np.ones(len(gone)), REMOVED)
            left = order[~late]
            records = np.empty(len(left), _WINDOW)
            for field, column in zip("grdxa", (*keys, d, x, a)):
                records[field] = column[left]
            yield from _blocks(records, buckets)

    return work


def _settle(batches):
    """Windows meet: those of later documents go."""
    passed: list = []
    held = _gathered(batches, passed)
    yield from passed
    if not held:
        return
    rec = np.concatenate([_records(b, _WINDOW) for b in held])
    order, _, late = _groups([rec["g"], rec["r"]], rec["d"])
    gone = rec[order[late]]
    if len(gone):
        yield _codes(gone["d"], gone["x"], gone["a"], np.ones(len(gone)), REMOVED)


def _kept(width: int):
    """Texts and removed windows in; number of words, removed spans, what is left."""

    def work(texts: pa.Array, codes: pa.Array) -> pa.Array:
        counts, spans, kept = [], [], []
        for t, c in zip(texts, codes):
            words = t.as_buffer().to_pybytes().split() if t.is_valid else []
            counts.append(len(words))
            found = []
            if c.is_valid:
                code = c.values.to_numpy()
                code = code[code & 3 == REMOVED]
                order = np.argsort(code >> 9, kind="stable")
                low = (code >> 9)[order]
                high = np.maximum.accumulate(low + ((code >> 2) & 127)[order] - 1 + width)
                new = np.ones(len(low), bool)
                new[1:] = low[1:] > high[:-1]
                at = np.flatnonzero(new)
                stop = high[np.append(at[1:], len(low)) - 1] if len(low) else low
                found = list(zip(low[at].tolist(), stop.tolist()))
            edges = [0, *(e for s in found for e in s), len(words)]
            left = [w for b, e in zip(edges[::2], edges[1::2]) for w in words[b:e]]
            spans.append([{"start": b, "stop": e} for b, e in found])
            kept.append(b" ".join(left).decode())
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())],
            ["n_words", "spans", "kept_text"],
        )

    return work


def remove_repeated_words(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 50,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``n_words``, ``spans`` (removed ranges of words, array of ``start``,
    ``stop``) and ``kept_text`` (the other words, joined by one space): each word
    goes that lies in a string of ``width`` words which also starts in a document
    of smaller id.

    Words are runs of bytes other than space, tab and line ends, unchanged. What a
    document repeats of itself stays. A NULL or empty text has no words, and
    ``kept_text`` is then empty; one shorter than ``width`` words loses nothing. A
    NULL ``doc_id`` comes before all others. Rows of one ``doc_id`` are one document
    of several texts, so repeated rows lose nothing to each other. Columns named
    like a result are replaced, all others are kept. An empty table gives an
    empty one. ``width`` lies between 2 and 250.

    The texts cross the network once, by document; records of runs follow, then
    windows of those runs only that share an anchor without being equal. A task
    holds its share of the records, which ``partitions`` divides (default
    ``spark.sql.shuffle.partitions``). Rows of one id and one text go through the
    steps once, and their result is joined back to each of them.
    """
    if not 2 <= width <= 250:
        raise ValueError("width must lie between 2 and 250")
    ship(documents.sparkSession)
    # Under numbers while the rows pass through Python, as names may be odd.
    original = documents.columns
    places = {c.lower(): f"c{i}" for i, c in enumerate(original)}
    documents = documents.toDF(*places.values())
    doc_id, text = places[doc_id.lower()], places[text.lower()]
    n = partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d, x = fresh(documents, "_d"), fresh(documents, "_x")
    rows, repeated = keyed(documents, doc_id, text, d, x)
    if repeated:
        single = rows.groupBy(d, x).agg(F.any_value(text).alias(text))
        found = rows.join(stored(_removed(single, d, x, text, width, n).drop(text), "removed"), [d, x])
    else:
        found = _removed(rows, d, x, text, width, n)
    names = {"n_words", "spans", "kept_text"}
    return found.select(
        *[F.col(c).alias(o) for o, c in zip(original, documents.columns) if o.lower() not in names],
        *["n_words", "spans", "kept_text"],
    )


def _removed(documents: DataFrame, d: str, x: str, text: str, width: int, n: int) -> DataFrame:
    """Rows that ``d`` and ``x`` tell apart, with their results."""
    codes, late = fresh(documents, "_codes"), fresh(documents, "_late")
    dealt_rows = documents.repartition(n, d, x)
    bucket = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("d", "x"), F.lit(n)))

    def met(rows: DataFrame, work) -> DataFrame:
        return rows.repartition(n, bucket).mapInArrow(released(work), ROWS)

    def by_document(rows: DataFrame, name: str) -> DataFrame:
        found = rows.filter("d IS NOT NULL").groupBy(F.col("d").alias(d), F.col("x").alias(x))
        return found.agg(F.collect_list("code").alias(name)).hint("shuffle_hash")

    # All readers of the texts take the same columns, so that they share one exchange.
    runs = met(dealt_rows.mapInArrow(released(_post(width, n, [d, x, text])), ROWS), _meet)
    settled = by_document(runs, codes)
    asked = dealt_rows.join(settled, [d, x])
    windows = met(asked.mapInArrow(released(_verify(width, n, [d, x, codes, text])), ROWS), _settle)
    found = dealt_rows.join(settled, [d, x], "left").join(by_document(windows, late), [d, x], "left")
    none = F.array().cast("array<bigint>")
    every = F.when(
        F.col(codes).isNotNull(), F.concat(F.col(codes), F.coalesce(F.col(late), none))
    )
    result = F.arrow_udf(
        _kept(width), "struct<n_words: bigint, spans: array<struct<start: bigint, stop: bigint>>, kept_text: string>"
    )(F.col(text).cast("binary"), every)
    out = fresh(documents, "_out")
    return found.withColumn(out, result).select(
        *documents.columns, *[F.col(out)[c].alias(c) for c in ("n_words", "spans", "kept_text")]
    )
