"""Suffix-array dedup of repeated rows, recompression, phrases, hard negatives."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.llm import _keys, collocations, hard_negatives, queries, recompression, suffix_dedup

ODD = "doc_id bigint, text string, spans string, _d int, `N_words` int, c0 string"


def lowest(i):
    return _keys.LOWEST if i is None else i


# --- 10 --------------------------------------------------------------------------


def removed(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return [(r["doc_id"], r["text"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame).collect()]


def test_texts_of_one_id_are_told_apart(spark, monkeypatch):
    """Two texts without id, of equal hash under the first seeds: another seed is
    taken, and neither loses what it alone has."""
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefgh ", k=300))
    one, two = ("".join(rng.choices("ijklmnop ", k=400)) for _ in range(2))
    rows = [(None, shared + one), (None, two + shared), (1, shared)]
    real, seeds = F.xxhash64, []

    def poor(seed, body):
        seeds.append(seed)
        return real(F.lit(7)) if len(seeds) <= 4 and len(seeds) % 2 else real(seed, body)

    monkeypatch.setattr(_keys.F, "xxhash64", poor)
    out = {t: k for _, t, k in removed(spark, rows)}
    assert len(seeds) == 6
    # The same string starts later in the second text, so it goes there, and only it.
    assert out[shared + one] == (shared + one).encode() and out[two + shared] == two.encode()
    assert out[shared] == b""


def test_many_equal_rows_take_time_in_proportion(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    earlier = text[:1500] + "".join(rng.choices("qrstuvwxyz ", k=500))
    taken = []
    for n in (500, 20_000):
        copies = spark.range(n).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
        frame = copies.union(spark.createDataFrame([(1, earlier), (None, "short")], "doc_id bigint, text string"))
        start = time.time()
        out = suffix_dedup.remove_repeats(frame).groupBy("doc_id", F.length("kept").alias("left")).count().collect()
        taken.append(time.time() - start)
        assert {tuple(r) for r in out} == {(7, 1500, n), (1, 2000, 1), (None, 5, 1)}
    assert taken[1] < 8 * taken[0] + 10


# --- 12 --------------------------------------------------------------------------


def without_earlier(rows, width=50):
    """``(doc_id, text, words, kept text)`` by a table of all windows."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, 2**70), lowest(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < lowest(i):
                gone[k : k + width] = [True] * width
        out.append((i, t, len(w), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r))


def repeated_texts(seed, kinds, documents):
    """Texts with parts of others, NULLs, repeated rows, several texts of one id."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(kinds)]
    base = [rng.choices(words, k=rng.randint(0, 200)) for _ in range(documents)]
    rows = []
    for i in range(documents):
        w = list(base[i])
        for _ in range(rng.randint(0, 3)):
            other = base[rng.randrange(documents)]
            a, p = rng.randint(0, len(other)), rng.randint(0, len(w))
            w[p:p] = other[a : a + rng.randint(0, 90)]
        rows.append((i if rng.random() > 0.1 else None, "\x0b \t".join(w) if rng.random() > 0.03 else None))
    return [*rows, *rows[:10], (5, rows[3][1]), (5, "")]


@pytest.mark.parametrize("width, kinds, documents", [(50, 300, 120), (8, 2, 40), (20, 1, 30)])
def test_words_met_in_earlier_documents_go(spark, width, kinds, documents):
    rows = repeated_texts(width, kinds, documents)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = recompression.remove_repeated_words(frame, width=width)
    found = out.select("doc_id", "text", "n_words", "kept_text").collect()
    assert ordered(map(tuple, found)) == ordered(without_earlier(rows, width))
    for r in out.collect():
        left = (r["text"] or "").encode().split()
        gone = {k for s in r["spans"] for k in range(s["start"], s["stop"])}
        assert b" ".join(w for k, w in enumerate(left) if k not in gone).decode() == r["kept_text"]


def test_long_texts_are_cut_with_an_overlap(spark, monkeypatch):
    monkeypatch.setattr(recompression, "SLICE_WORDS", 64)
    rng = random.Random(9)
    long = " ".join(rng.choices("abcdefg", k=3000))
    rows = [(1, long), (2, "x " + long[500:2500]), (3, long), (4, None), (5, ""), (6, "a b c")]
    work = recompression._slices(iter([(i, 0, (t or "").encode()) for i, t in rows]), 50)
    assert max(len(w) for _, _, w, _ in work) <= 64 + 2 * 50
    monkeypatch.undo()
    monkeypatch.setattr(recompression, "FREQUENT", 1)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = recompression.remove_repeated_words(frame)
    found = out.select("doc_id", "text", "n_words", "kept_text").collect()
    assert ordered(map(tuple, found)) == ordered(without_earlier(rows))


def test_symbols_depend_on_their_context_alone():
    """Equal contexts hold equal symbols, whatever stands around them."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 40, 300).astype(np.uint64)
    common[100:110] = 7
    found = []
    for ahead in (0, 13):
        words = np.concatenate([rng.integers(50, 90, ahead).astype(np.uint64), common, rng.integers(50, 90, 20).astype(np.uint64)])
        name, level, low, size = recompression.symbols(words, np.array([len(words)]), 6, 25)
        inside = (low >= ahead) & (low + size <= ahead + 300)
        found.append({x for x in zip(name[inside], level[inside], low[inside] - ahead, size[inside])})
    assert found[0] == found[1] and max(x[1] for x in found[0]) >= 3


def test_recompression_keeps_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "s", 1, 2, "c"), (2, text, None, None, None, None)]
    for some in (rows, [*rows, rows[1]], []):
        out = recompression.remove_repeated_words(spark.createDataFrame(some, ODD))
        assert out.columns == ["doc_id", "text", "_d", "c0", "n_words", "spans", "kept_text"]
        assert sorted((r["doc_id"], r["c0"], len(r["kept_text"])) for r in out.collect() if r["doc_id"] == 1) == (
            [(1, "c", len(text))] if some else []
        )
        assert all(r["kept_text"] == "" for r in out.collect() if r["doc_id"] == 2)
    for width in (1, 251):
        with pytest.raises(ValueError):
            recompression.remove_repeated_words(spark.createDataFrame(rows, ODD), width=width)


# --- 13 --------------------------------------------------------------------------


def plain_phrases(rows, least, top, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    met = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    within = {
        (lang, p[i:j])
        for (lang, p), a in met.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
        if j - i < len(p) and 100 * a >= 100 * f[lang, p[i:j]]
    }
    ranked = defaultdict(list)
    for (lang, p), a in met.items():
        if (lang, p) not in within:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in ranked.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def test_phrases_equal_a_plain_count(spark, monkeypatch):
    rng = random.Random(13)
    words = ["The", "the", "cat", "Ünd", "ünd", "a.b", "x\x1cy", "n b", "e", "f"]
    marks = [" ", "  ", "\t", ". ", "\n", "\x0b", ",", "!?"]
    rows = []
    for i in range(300):
        text = "".join(w + m for w, m in zip(rng.choices(words, k=40), rng.choices(marks, [40, 5, 5, 3, 3, 1, 2, 1], k=40)))
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", "en"), (" . ", "fr"), ("one two", "fr"), *rows[:20]]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, block int")
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 500)
    monkeypatch.setattr(collocations, "ROW_GROUPS", 7)
    for least, top in ((1, 50), (10, 2000)):
        out = collocations.collocations(frame.repartition(5), least=least, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == plain_phrases(rows, least, top)


def test_phrases_are_mined_where_hashes_collide(spark, monkeypatch):
    rows = [(" ".join(random.Random(i).choices("abcdef", k=30)), "en") for i in range(40)]
    monkeypatch.setattr(collocations, "_mixed", lambda x: x & np.uint64(0xF000000000000000))
    frame = spark.createDataFrame(rows, "text string, lang string")
    blocks = frame.coalesce(1).mapInArrow(collocations._word_occurrences, collocations.LEVEL)
    assert blocks.count() == 1
    assert sorted(map(tuple, collocations.collocations(frame, least=15).collect())) == plain_phrases(rows, 15, 2000)


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("one two three", "en")]):
        frame = spark.createDataFrame(rows, "text string, lang string")
        assert collocations.collocations(frame, least=2).collect() == []


def test_scores_pass_64_bits(spark):
    found = [("en", 1, "x", 10**13 + 1), ("en", 1, "y", 10**13 + 3), ("en", 2, "x y", 10**13)]
    frame = spark.createDataFrame(found, "lang string, words int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 10**15 + 7)], "lang string, n bigint")
    row = collocations.score_phrases(frame, totals).first()
    assert row["score"] == 1000 * 10**13 * (10**15 + 7) // ((10**13 + 1) * (10**13 + 3))


# --- 11 --------------------------------------------------------------------------


def plain_negatives(rows):
    usable = []
    for n, (i, v, label) in enumerate(rows):
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((n, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, i, v, label in usable:
        if i % 50:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, m, k) for m, j, w, k in usable if m != n and len(w) == len(v)
        )
        for s, j, _, _ in [x for x in scored if x[3] == label][:5]:
            inside = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<double>, label int, score string, row int"


@pytest.mark.parametrize("least_rows", [4096, 150])
def test_hard_negatives_equal_a_plain_search(spark, monkeypatch, least_rows):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", least_rows)
    rng = random.Random(11)
    rows = [
        (i, [rng.gauss(0, 0.3) + (1 if k == i % 12 else 0.3) for k in range(12)], rng.randrange(10)) for i in range(1200)
    ]
    rows += [
        (50, rows[50][1], 3), (51, rows[51][1], 1), (None, [1.0] * 12, 1), (100, None, 1), (150, [math.nan] * 12, 1),
        (1600, [None] * 12, 1), (1650, [1.0, 2.0], 1), (1651, [1.0, 2.0], 1), (1652, [0.7, 1.3], 2), (1700, [], 1),
        (1701, [], 1), (1702, [], 2), (1750, [math.inf] * 12, 1), (1753, [1.0] * 12, None),
    ]
    # Many equal vectors of one label, and anchors all alike.
    rows += [(2000 + i, rows[3][1], 4) for i in range(300)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    out = hard_negatives.hard_negatives(frame)
    assert sorted(map(tuple, out.collect())) == plain_negatives(rows)


def test_hard_negatives_of_little(spark):
    some = [(0, [1.0], 1, None, None), (1, [1.0], 1, None, None)]
    for rows in ([], some[1:], some[:1], some):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_bounds_hold_down_the_tree(spark):
    """No row whose exact score lies in the window is left out by bounds."""
    rng = np.random.default_rng(7)
    points = np.floor(rng.normal(0, 100, (40, 8)))
    parent, edge = hard_negatives._spanning_tree(points)
    assert parent[0] == -1 and sorted(parent[1:] >= 0) == [True] * 39
    for i in range(1, 40):
        assert math.isclose(edge[i], np.linalg.norm(points[i] - points[parent[i]]))
    block = hard_negatives._Block()
    rows = np.floor(rng.normal(0, 100, (200, 8)))
    import pyarrow as pa

    table = {"row": range(200), "id": range(200), "label": [1] * 200, "v": rows.tolist()}
    block.add(pa.RecordBatch.from_pydict(table))
    block.ready(8, points, (parent, edge))
    exact = rows @ points.T
    for p in rng.permutation(40):
        low, high = block.of_pivot(int(p))
        assert (low <= exact[:, p] + 1e-6).all() and (exact[:, p] <= high + 1e-6).all()
        low, high = block.refine(int(p), 10.0, np.ones(200, bool), 5000.0, 9000.0)
        assert (low <= exact[:, p] + 1e-6).all() and (exact[:, p] <= high + 1e-6).all()



@pytest.mark.parametrize("name", ["op10_suffix_dedup", "op12_recompression"])
def test_texts_are_read_and_dealt_out_once(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 2
