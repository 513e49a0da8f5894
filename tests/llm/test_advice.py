"""Cases that a review found to be cut short."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from gridseries.llm import language_id, mixing, suffix_dedup, toxicity
from tests.llm import helpers as H

SMALL = "/root/testdata/sf0.001"

# --- 6 -----------------------------------------------------------------------


def test_rows_without_id_draw_each_by_its_content(spark):
    """Sources without ids keep their share; their copies lie in many tasks."""
    rows = [(None, f"text {i}", "with" if i % 2 else None) for i in range(4000)]
    rows += [(i, f"text {i}", "ids") for i in range(4000)]
    rows += [(None, "alone", f"rare{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = [("with", 1000.0), (None, 1000.0), ("ids", 2000.0), *((f"rare{i}", 1.0) for i in range(200))]
    targets = spark.createDataFrame(targets, "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.target_rates(frame, targets).collect()}
    out = mixing.replicate(frame, targets).collect()
    found = Counter(r["source"] for r in out)
    for s, n in (("with", 2000), (None, 2000), ("ids", 4000)):
        assert abs(found[s] - n * rates[s]) < 5 * (n * rates[s]) ** 0.5
    rare = sum(n for s, n in found.items() if (s or "").startswith("rare"))
    assert abs(rare - 200 * rates["rare0"]) < 5 * (200 * rates["rare0"]) ** 0.5
    keys = [r["shuffle_key"] for r in out]
    assert len(set(keys)) == len(keys)
    assert [c for c in mixing.replicate(frame).columns if c.startswith("_")] == []


# --- 8 -----------------------------------------------------------------------


def test_many_plain_sentences_do_not_make_a_text_toxic(spark):
    clean = "the cat sat on the mat. " * 20_000
    frame = spark.createDataFrame([(0, clean), (1, clean + "you vile.")], "doc_id bigint, text string")
    model = toxicity.Model({"vile": 12.0}, -9.0)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert 0 < out[0] < 0.001 and out[1] > 0.9


def test_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]

    def text(toxic):
        more = ["vileness"] if toxic else []
        return " ".join(" ".join([*rng.choices(words, k=8), *more]) + "." for _ in range(800))

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    assert min(len(t) for _, t, _ in rows) > 32_000
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert "vileness" in model.weights
    for r in toxicity.score(frame, model).collect():
        assert (r["score"] >= 0.3) == bool(r["toxic"])


# --- pipeline ----------------------------------------------------------------


def test_the_prediction_sets_the_language_of_every_row(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = corpus_pipeline.F.when(documents["doc_id"].isin(1, 3), "fr").otherwise(documents["lang"])
    named = documents.withColumn("lang", named)
    found = language_id.identify(named, language_id.learn(named))
    out = corpus_pipeline.identify_languages(spark, named, SMALL).collect()
    assert {r["doc_id"]: r["lang"] for r in out} == {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert {r["lang"] for r in out if r["doc_id"] in (1, 3)} == {"en"}


# --- 10 ----------------------------------------------------------------------


def test_an_anchor_with_few_runs_in_each_of_many_slices_is_spread(monkeypatch):
    """One line in many documents, seldom within a slice, goes to no task as a whole."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 4096)
    rng = random.Random(10)
    letters = "abcdefghijklmnop "

    def own(n):
        return "".join(rng.choices(letters, k=n))

    # A phrase of so small a hash that it is the anchor of all windows around it.
    pool = np.frombuffer("".join(rng.choices("QRSTUVWXYZ0123456789", k=300_000)).encode(), np.uint8)
    sums = suffix_dedup._sums(pool, 0)
    starts = np.arange(len(pool) - 24)
    least = int(np.argmin(suffix_dedup._hashes(sums, starts, starts + 24, 0)))
    line = pool[least : least + 24].tobytes().decode()
    texts = [own(90) + line + own(90) for _ in range(4500)]
    texts += [own(5) + texts[i][20:180] + own(5) for i in range(0, 4500, 300)]
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows)), pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array(texts)],
        ["d", "x", "t"],
    )
    first = list(suffix_dedup._first_digits(100, 3, ["d", "x", "t"])(iter([batch])))
    assert not any(c & 3 == suffix_dedup.SPREAD for b in first for c in b.column(3).to_pylist() if c)
    codes = {i: [] for i, _ in rows}
    for b in suffix_dedup._second_digit(iter(first)):
        for d, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            codes[d].append(c)
    data = [t.encode() for t in texts]
    compared = Counter()
    for d, cs in codes.items():
        for c in cs:
            if c & 3 == suffix_dedup.COMPARE:
                at, n = c >> 9, (c >> 2) & 127
                whole = np.frombuffer(data[d], np.uint8)
                g, _ = suffix_dedup._anchors(whole, np.array([at]), None, 100)
                compared[int(g[0])] += 1
    assert max(compared.values(), default=0) <= 4096
    asked = [d for d in codes if codes[d]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(asked, pa.int64()), pa.array([0] * len(asked), pa.int64()),
         pa.array([codes[d] for d in asked]), pa.array([texts[d] for d in asked])],
        ["d", "x", "c", "t"],
    )
    third = list(suffix_dedup._bytes_of_runs(100, 3, ["d", "x", "c", "t"])(iter([batch])))
    for b in suffix_dedup._last_digits(100)(iter(third)):
        for d, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            codes[d].append(c)
    expected = H.without_repeats(rows)
    for i, b in rows:
        covered = bytearray(len(b))
        for c in codes[i]:
            if c & 3 == suffix_dedup.REMOVED:
                a, n = c >> 9, (c >> 2) & 127
                covered[a : a + n + 99] = b"\1" * (n + 99)
        assert bytes(c for c, f in zip(b, covered) if not f) == expected[i][1]
