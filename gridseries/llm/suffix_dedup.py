"""Removal of byte strings that occur earlier, by a depth-limited radix sort.

A suffix matters only through its first ``width`` bytes, its window. Suffixes
are sorted by digits, most significant first, and leave as soon as no other
shares their digits; those that are left after the last digit, in groups, are
exactly the repeated windows.

* First digit: the window's *anchor*, the 24-byte gram of least hash in it, and
  the place of the anchor in the window. Neighbouring windows mostly have one
  anchor, so a *run* of them travels as one record, about 1 for 39 bytes of text.
* Second digit: the bytes of the whole run. Equal runs are equal in all their
  windows; all but the earliest are removed. An anchor with one run only leaves.
* Remaining digits: runs with a common anchor but different bytes. The bytes of
  their windows are compared 8 at a time, most significant first.

An anchor met very often with different runs (the border of a passage that many
documents share), within one slice or over all of them, does not gather in one
place: its windows travel one by one, keyed by the whole window, after equal ones
within the slice have been merged.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import fresh, released, ship, turn
from gridseries.llm._keys import keyed
from gridseries.session import stored

GRAM = 24
# Bytes of text that a task works on at once; places in them need 24 bits.
SLICE = 3 << 19
PLACE_BITS = 24
# Different runs of one anchor within a slice from which it counts as frequent.
FREQUENT = 32
# Different runs of one anchor over all slices up to which one task compares them.
COMPARED = 4096
REMOVED, COMPARE, SPREAD = 1, 2, 3

_RNG = np.random.default_rng(20)
_LETTERS = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = _RNG.integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)
_POWERS: list = [None, None]


def _forget() -> None:
    _POWERS[:] = [None, None]


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    turn("suffix", _forget)
    if _POWERS[which] is None or len(_POWERS[which][0]) < n:
        size = max(n, SLICE + (1 << 16))
        out = []
        for base in (int(_BASE[which]), pow(int(_BASE[which]), -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[which] = tuple(out)
    return _POWERS[which]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which the hash of any part of the data follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[which][data] * _powers(len(data), which)[0][: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    return _mixed((sums[stop] - sums[start]) * _powers(len(sums), which)[1][start])


def _least(values: np.ndarray, m: int) -> np.ndarray:
    """Least of every ``m`` neighbours."""
    out, have = values, 1
    while 2 * have <= m:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - m + 1], out[m - have :]) if m > have else out


def _runs(data: np.ndarray, ends: np.ndarray, width: int):
    """Runs of windows with one anchor: (document, start, windows, anchor, bytes).

    ``data`` holds documents one after the other, which end at ``ends``.
    """
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < width:
        return none
    sums = _sums(data, 0)
    n = len(data) - GRAM + 1
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _powers(len(sums), 0)[1][:n])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((grams & ~low) | np.arange(n, dtype=np.uint64), width - GRAM + 1)
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + width <= ends[document])
    if not len(starts):
        return none
    anchor = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    start = starts[new]
    count = np.diff(new, append=len(starts))
    of_run = _hashes(sums, start, start + count - 1 + width, 0)
    return document[start], start, count, grams[anchor[new]], of_run


def _slices(rows: Iterator[tuple]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows ``(.., bytes)`` in slices: rows, data, ends. A text longer than a
    slice is a slice of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > SLICE:
            yield _joined(held)
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield _joined(held)


def _joined(rows):
    data = np.frombuffer(b"".join([r[-1] for r in rows]), np.uint8)
    return rows, data, np.cumsum([len(r[-1]) for r in rows])


def _cut(rows, data, ends, width):
    """Slices whose places fit their bits; a long text is cut with an overlap
    of one window, so every window lies whole in one part."""
    if len(data) <= SLICE:
        yield rows, data, ends, 0
        return
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + width - 1]
        yield rows, part, np.array([len(part)]), at


_RUN = np.dtype([("g", "<u8"), ("r", "<u8"), ("d", "<i8"), ("x", "<i8"), ("a", "<u4"), ("n", "u1")])
_WINDOW = np.dtype([("g", "<u8"), ("r", "<u8"), ("d", "<i8"), ("x", "<i8"), ("a", "<u4")])


def _earliest(order_keys, same_keys):
    """Sorted order, and which of the sorted rows start a group of equal rows."""
    order = np.lexsort(order_keys[::-1])
    new = np.zeros(len(order), bool)
    for key in same_keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    if len(new):
        new[0] = True
    return order, new


def _not_first(order, new, d, a):
    """Rows of a group that start later than its first; equal places all stay."""
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    d, a = d[order], a[order]
    late = (d != d[first]) | (a != a[first])
    return order[late]


def _codes(d, x, a, n, kind) -> pa.RecordBatch:
    code = (a.astype(np.int64) * 128 + n.astype(np.int64)) * 4 + kind
    return _rows(np.full(len(d), -1, np.int32), d.astype(np.int64), x.astype(np.int64), code, None)


def _rows(bucket, d, x, code, data) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()),
            pa.array(d, pa.int64()) if d is not None else pa.nulls(n, pa.int64()),
            pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64()),
            pa.array(code, pa.int64()) if code is not None else pa.nulls(n, pa.int64()),
            pa.array(data, pa.binary()) if data is not None else pa.nulls(n, pa.binary()),
        ],
        ["bucket", "d", "x", "code", "data"],
    )


ROWS = "bucket int, d bigint, x bigint, code bigint, data binary"


def _blocks(records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Records packed by the bucket of their first digit."""
    if not len(records):
        return
    bucket = (records["g"] >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    parts = np.split(records[order], at[1:])
    yield _rows(bucket[at].astype(np.int32), None, None, None, [_planes(p) for p in parts])


def _planes(records: np.ndarray) -> bytes:
    """Records byte place by byte place, so that the shuffle can compress them."""
    return records.view(np.uint8).reshape(len(records), -1).T.tobytes()


def _records(data: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _text_rows(batches, columns):
    """Rows of the named columns, the last of them as bytes."""
    for batch in batches:
        *cols, texts = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        cols = [c.to_pylist() for c in cols]
        for i, t in enumerate(texts):
            yield *(c[i] for c in cols), t.as_buffer() if t.is_valid else b""


def _first_digits(width: int, buckets: int, columns: list[str]):
    """Texts in; runs out, packed by anchor."""

    def work(batches):
        for rows, data, ends in _slices(_text_rows(batches, columns)):
            ids = np.array([r[0] for r in rows], np.int64)
            sums = np.array([r[1] for r in rows], np.int64)
            began = np.concatenate([[0], ends[:-1]])
            for _, part, part_ends, shift in _cut(rows, data, ends, width):
                doc, start, count, g, r = _runs(part, part_ends, width)
                if not len(doc):
                    continue
                a = start - began[doc] + shift
                d, x = ids[doc], sums[doc]
                order, new = _earliest([g, r, d, a], [g, r, count])
                late = _not_first(order, new, d, a)
                if len(late):
                    yield _codes(d[late], x[late], a[late], count[late], REMOVED)
                left = order[~np.isin(order, late)]
                records = np.empty(len(left), _RUN)
                for name, column in zip("grdxan", (g, r, d, x, a, count)):
                    records[name] = column[left]
                # Sorted by anchor: how many different runs each has here.
                heads = np.flatnonzero(np.diff(records["g"], prepend=~records["g"][:1]))
                often = np.diff(heads, append=len(records)) >= FREQUENT
                if often.any():
                    marks = records[heads[often]].copy()
                    marks["n"] = 0
                    hot = np.repeat(often, np.diff(heads, append=len(records)))
                    h = records[hot]
                    yield _codes(h["d"], h["x"], h["a"], h["n"], SPREAD)
                    records = np.concatenate([records[~hot], marks])
                yield from _blocks(records, buckets)

    return work


def _gathered(batches, other):
    """Blocks of this task as one array; rows that are no blocks are passed on."""
    held = []
    for batch in batches:
        is_block = batch.column(0).to_numpy() >= 0
        if not is_block.all():
            other.append(batch.filter(pa.array(~is_block)))
        held += [x.as_py() for x in batch.filter(pa.array(is_block)).column(4)]
    return held


def _second_digit(batches):
    """Runs of an anchor meet: later equal ones go, different ones are compared, or
    spread if they are too many for one task. A slice sends fewer than ``FREQUENT``
    records of an anchor here, so these stay below one part in 2,000 of the text."""
    passed: list = []
    held = _gathered(batches, passed)
    yield from passed
    if not held:
        return
    rec = np.concatenate([_records(b, _RUN) for b in held])
    order, new = _earliest([rec["g"], rec["r"], rec["d"], rec["a"]], [rec["g"], rec["r"], rec["n"]])
    mark = rec["n"] == 0
    late = _not_first(order, new, rec["d"], rec["a"])
    late = late[~mark[late]]
    if len(late):
        x = rec[late]
        yield _codes(x["d"], x["x"], x["a"], x["n"], REMOVED)
    is_late = np.zeros(len(rec), bool)
    is_late[late] = True
    g = rec["g"][order]
    head = np.diff(g, prepend=~g[:1]) != 0
    group = np.cumsum(head) - 1
    runs = np.bincount(group, weights=new)
    different = runs > 1
    frequent = (np.bincount(group, weights=mark[order]) > 0) | (runs > COMPARED)
    rest = ~is_late[order] & ~mark[order]
    for chosen, kind in ((frequent, SPREAD), (different & ~frequent, COMPARE)):
        x = rec[order[rest & chosen[group]]]
        if len(x):
            yield _codes(x["d"], x["x"], x["a"], x["n"], kind)


def _bytes_of_runs(width: int, buckets: int, columns: list[str]):
    """Texts with their requests in; bytes of the runs out, packed by anchor."""

    def work(batches):
        for rows, data, ends in _slices(_text_rows(batches, columns)):
            began = np.concatenate([[0], ends[:-1]])
            codes = [np.array(r[2], np.int64) for r in rows]
            which = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
            code = np.concatenate(codes)
            d = np.array([r[0] for r in rows], np.int64)[which]
            x = np.array([r[1] for r in rows], np.int64)[which]
            kind, n, a = code & 3, (code >> 2) & 127, code >> 9
            at = began[which] + a
            todo = np.flatnonzero(kind == COMPARE)
            if len(todo):
                yield from _packed_bytes(data, at[todo], n[todo], d[todo], x[todo], a[todo], width, buckets)
            todo = np.flatnonzero(kind == SPREAD)
            for i in range(0, len(todo), 1 << 14):
                some = todo[i : i + (1 << 14)]
                yield from _spread(data, at[some], n[some], d[some], x[some], a[some], width, buckets)

    return work


def _anchors(data, at, n, width):
    """Anchor of each run that starts at ``at``, found again in its first window."""
    out = np.empty(len(at), np.uint64)
    place = np.empty(len(at), np.int64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    m = width - GRAM + 1
    for i in range(0, len(at), 4096):
        some = at[i : i + 4096]
        windows = data[some[:, None] + np.arange(width)]
        flat = windows.ravel()
        sums = _sums(flat, 0)
        starts = (np.arange(len(some)) * width)[:, None] + np.arange(m)
        grams = _mixed((sums[starts + GRAM] - sums[starts]) * _powers(len(sums), 0)[1][starts])
        best = np.argmin((grams & ~low) | np.arange(m, dtype=np.uint64), axis=1)
        out[i : i + 4096] = grams[np.arange(len(some)), best]
        place[i : i + 4096] = best
    return out, place


def _packed_bytes(data, at, n, d, x, a, width, buckets):
    g, place = _anchors(data, at, n, width)
    bucket = ((g >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    blocks = []
    for part in np.split(order, cuts[1:]):
        head = np.empty(len(part), _HEAD)
        for name, column in zip(("g", "d", "x", "a", "n", "p"), (g, d, x, a, n, place)):
            head[name] = column[part]
        texts = b"".join(
            [data[s : s + c - 1 + width].tobytes() for s, c in zip(at[part].tolist(), n[part].tolist())]
        )
        blocks.append(b"R" + len(part).to_bytes(4, "little") + _planes(head) + texts)
    yield _rows(bucket[order][cuts], None, None, None, blocks)


_HEAD = np.dtype([("g", "<u8"), ("d", "<i8"), ("x", "<i8"), ("a", "<u4"), ("n", "u1"), ("p", "u1")])


def _spread(data, at, n, d, x, a, width, buckets):
    """Every window of the runs by itself, equal ones of this slice merged."""
    which = np.repeat(np.arange(len(at)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    place = at[which] + step
    keys = []
    for i in (0, 1):
        sums = _sums(data, i)
        keys.append(_hashes(sums, place, place + width, i))
    d, x, a = d[which], x[which], a[which] + step
    order, new = _earliest([keys[0], keys[1], d, a], keys)
    late = _not_first(order, new, d, a)
    if len(late):
        yield _codes(d[late], x[late], a[late], np.ones(len(late)), REMOVED)
    left = order[~np.isin(order, late)]
    records = np.empty(len(left), _WINDOW)
    for name, column in zip("grdxa", (*keys, d, x, a)):
        records[name] = column[left]
    for batch in _blocks(records, buckets):
        yield _rows(batch.column(0), None, None, None, [b"W" + v.as_py() for v in batch.column(4)])


def _radix(windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort windows within their groups by digits of 8 bytes, most significant
    first. After each pass those alone in their group leave. Returns the rows
    that are left and their groups: windows of one group are equal."""
    width = windows.shape[1]
    rows = np.arange(len(group))
    for at in range(0, width, 8):
        part = windows[rows, at : at + 8]
        if part.shape[1] < 8:
            part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
        digit = np.ascontiguousarray(part).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        s_group, s_digit = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (s_group[1:] != s_group[:-1]) | (s_digit[1:] != s_digit[:-1])
        ids = np.cumsum(new) - 1
        keep = np.bincount(ids)[ids] > 1
        rows, group = rows[order[keep]], ids[keep]
        if not len(rows):
            break
    return rows, group


def _last_digits(width: int):
    """Bytes of runs in; windows that occur earlier out."""

    def compare(blocks):
        heads, texts = [], []
        for b in blocks:
            count = int.from_bytes(b[1:5], "little")
            stop = 5 + count * _HEAD.itemsize
            heads.append(_records(b[5:stop], _HEAD))
            texts.append(b[stop:])
        head = np.concatenate(heads)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = head["n"].astype(np.int64)
        began = np.cumsum(n - 1 + width) - (n - 1 + width)
        # Whole anchors together, about a million windows at a time.
        order = np.argsort(head["g"], kind="stable")
        g = head["g"][order]
        edges = np.flatnonzero(np.diff(g, prepend=~g[:1]))
        total = np.concatenate([[0], np.cumsum(n[order])])
        chunk = np.searchsorted(total[edges], np.arange(0, total[-1] + 1, 1 << 19))
        cuts = np.unique(np.append(edges[np.minimum(chunk, len(edges) - 1)], len(order)))
        for lo, hi in zip(np.concatenate([[0], cuts[:-1]]), cuts):
            some = order[lo:hi]
            if len(some):
                yield from windows_of(head[some], data, began[some], n[some])

    def windows_of(head, data, began, n):
        which = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        windows = np.lib.stride_tricks.sliding_window_view(data, width)[began[which] + step]
        offset = head["p"][which].astype(np.int64) - step
        _, anchor = np.unique(head["g"], return_inverse=True)
        rows, group = _radix(windows, anchor[which] * 1024 + offset + 128)
        if not len(rows):
            return
        w = which[rows]
        d, a = head["d"][w], head["a"][w].astype(np.int64) + step[rows]
        order, new = _earliest([group, d, a], [group])
        late = _not_first(order, new, d, a)
        if not len(late):
            return
        # Neighbouring windows of one run as one range.
        late = late[np.lexsort((a[late], w[late]))]
        w, a = w[late], a[late]
        first = np.ones(len(late), bool)
        first[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1] + 1)
        at = np.flatnonzero(first)
        yield _codes(
            head["d"][w[at]], head["x"][w[at]], a[at], np.diff(at, append=len(late)), REMOVED
        )

    def work(batches):
        passed: list = []
        held = _gathered(batches, passed)
        yield from passed
        if runs := [b for b in held if b[:1] == b"R"]:
            yield from compare(runs)
        if single := [b[1:] for b in held if b[:1] == b"W"]:
            rec = np.concatenate([_records(b, _WINDOW) for b in single])
            order, new = _earliest([rec["g"], rec["r"], rec["d"], rec["a"]], [rec["g"], rec["r"]])
            x = rec[_not_first(order, new, rec["d"], rec["a"])]
            if len(x):
                yield _codes(x["d"], x["x"], x["a"], np.ones(len(x)), REMOVED)

    return work


def _kept(width: int):
    """Texts and ranges of removed windows in; removed spans and kept bytes out."""

    def work(texts: pa.Array, codes: pa.Array) -> pa.Array:
        spans, kept, left = [], [], []
        for t, c in zip(texts, codes):
            if not c.is_valid or not t.is_valid:
                spans.append(None)
                kept.append(None)
                left.append(None)
                continue
            data = t.as_buffer().to_pybytes()
            code = c.values.to_numpy()
            code = code[code & 3 == REMOVED]
            lo = np.sort(code >> 9)
            order = np.argsort(code >> 9, kind="stable")
            hi = np.maximum.accumulate((lo + ((code >> 2) & 127)[order]) - 1 + width)
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > hi[:-1]
            at = np.flatnonzero(new)
            begin, stop = lo[at], hi[np.append(at[1:], len(lo)) - 1] if len(lo) else lo
            spans.append([{"start": int(b), "stop": int(e)} for b, e in zip(begin, stop)])
            edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(data)]
            parts = [data[b:e] for b, e in zip(edges[::2], edges[1::2])]
            kept.append(b"".join(parts))
            left.append("".join([p.decode("utf-8", "ignore") for p in parts]))
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return pa.StructArray.from_arrays(
            [pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary()), pa.array(left, pa.string())],
            ["spans", "kept", "kept_text"],
        )

    return work


def remove_repeats(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 100,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``spans`` (removed byte ranges, array of ``start``, ``stop``), ``kept``
    (the remaining bytes) and ``kept_text`` (the same as text, without the parts
    of characters that a range has cut): each byte goes that lies in a string of
    ``width`` bytes which also starts earlier, in a document of smaller id or
    before in the same document.

    A NULL or empty text, and one shorter than ``width``, loses nothing; a NULL
    text has no bytes, and its ``kept_text`` is NULL. A NULL ``doc_id`` comes before all others. Rows of one
    ``doc_id`` are one document of several texts: of two equal strings at the
    same place in them neither is the earlier, so repeated rows give equal
    results. Columns named like a result are replaced, all others are kept. An
    empty table gives an empty one. ``width`` lies between 48 and 150.

    The texts cross the network once, by document. Records of runs follow, then
    the bytes of those runs only that share an anchor without being equal. A
    task holds its share of the records, which ``partitions`` divides; it had
    better be ``spark.sql.shuffle.partitions``, the default, as the texts are
    then dealt out once for all steps. Rows of one id and one text go through the
    steps once, and their result is joined back to each of them.
    """
    if not 48 <= width <= 150:
        raise ValueError("width must lie between 48 and 150")
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
        found = stored(_removed(single, d, x, text, width, n).drop(text), "removed")
        found = rows.join(found, [d, x])
    else:
        found = _removed(rows, d, x, text, width, n)
    names = {"spans", "kept", "kept_text"}
    return found.select(
        *[F.col(c).alias(o) for o, c in zip(original, documents.columns) if o.lower() not in names],
        *["spans", "kept", "kept_text"],
    )


def _removed(documents: DataFrame, d: str, x: str, text: str, width: int, n: int) -> DataFrame:
    """Rows that ``d`` and ``x`` tell apart, with ``spans``, ``kept``, ``kept_text``."""
    codes, late = fresh(documents, "_codes"), fresh(documents, "_late")
    body = F.col(text).cast("binary")
    dealt_rows = documents.repartition(n, d, x)

    def by_document(rows: DataFrame, name: str) -> DataFrame:
        return (
            rows.filter("d IS NOT NULL")
            .groupBy(F.col("d").alias(d), F.col("x").alias(x))
            .agg(F.collect_list("code").alias(name))
        )

    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.hash("d", "x"), F.lit(n)))

    def dealt_out(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, dealt)

    # All three readers of the texts take the same columns, so that they share
    # one exchange.
    runs = dealt_out(dealt_rows.mapInArrow(released(_first_digits(width, n, [d, x, text])), ROWS))
    runs = runs.mapInArrow(released(_second_digit), ROWS)
    # Read for the bytes of the runs to compare, and for what is removed already.
    settled = by_document(runs, codes).hint("shuffle_hash")
    asked = dealt_rows.join(settled, [d, x])
    last = dealt_out(asked.mapInArrow(released(_bytes_of_runs(width, n, [d, x, codes, text])), ROWS))
    last = by_document(last.mapInArrow(released(_last_digits(width)), ROWS), late).hint("shuffle_hash")
    found = dealt_rows.join(settled, [d, x], "left").join(last, [d, x], "left")
    none = F.array().cast("array<bigint>")
    found = found.withColumn(
        codes, F.when(F.col(codes).isNotNull(), F.concat(codes, F.coalesce(late, none)))
    )
    out = fresh(found, "_out")
    result = F.arrow_udf(
        _kept(width),
        "struct<spans: array<struct<start: bigint, stop: bigint>>, kept: binary, kept_text: string>",
    )(F.when(F.col(codes).isNotNull(), body), F.col(codes))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return found.withColumn(out, result).select(
        *documents.columns,
        F.coalesce(F.col(out).spans, none).alias("spans"),
        F.coalesce(F.col(out).kept, body, F.lit(b"")).alias("kept"),
        F.coalesce(F.col(out).kept_text, F.col(text)).alias("kept_text"),
    )
