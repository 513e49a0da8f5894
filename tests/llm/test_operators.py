"""The operators on small tables: against plain versions, and at the edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridseries.llm import (
    bpe,
    language_id,
    mixing,
    near_dup,
    quality_rules,
    suffix_dedup,
    token_counts,
    topk,
    toxicity,
    url_filter,
)
from gridseries.llm import _components
from tests.llm import helpers as H

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that results or helpers also have, and an odd one.
CLASHING = (
    "doc_id bigint, text string, ids string, score string, kept int, d int, x int, t int, "
    "spans string, copies string, host string, n_words string, _results int, `a.b` int, lang string, "
    "source string, url string"
)


def odd_texts(rng):
    letters = "aAzZéÉçßİΣς\u0338\u0301\u00a0\u3000\u2003\x00\x1c\x85'sS'tre'LL<|>0٣½한🎉👩‍👧ﬁ²_-— \n\t"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return [*out, *(t + "<|endoftext|>" + t for t in out[:50]), "x<|startoftext|>'s", "", " ", "\n"]


def documents(spark, texts, schema="doc_id bigint, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def clashing(spark, texts):
    """Rows with a NULL in every other column, and one of NULLs only."""
    rows = [(i, t, *[None] * 15) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None,) * 17], CLASHING)


# --- 1 -----------------------------------------------------------------------


def test_counts_equal_a_plain_count():
    word = re.compile("[^\x20\x09-\x0d]+")
    rng = random.Random(1)
    texts = odd_texts(rng) + [
        " ".join(rng.choice(["a", "b", "c", "d|", "#e"]) for _ in range(rng.randint(0, 40)))
        + rng.choice(["", "\n", "\n \n\n"]) * rng.randint(0, 3) + "a b\na b\n" * rng.randint(0, 2)
        for _ in range(200)
    ]
    for t in texts:
        w = word.findall(t)
        times = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) for k in range(3) if times[tuple(w[j : j + 3])] > 1}
        lines = [x for x in t.split("\n") if word.search(x)]
        expected = (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
            len(lines) - len(set(lines)), len(covered),
        )
        assert quality_rules.text_counts(t.encode())[:5] == expected, repr(t)


def test_many_distinct_words_do_not_overflow():
    words = [str(i) for i in range(1_200_000)]
    text = " ".join([*words, *words[:3]]).encode()
    assert quality_rules.text_counts(text)[4] == 6


def test_rules_find_thresholds_and_are_an_expression(spark):
    rng = np.random.default_rng(2)
    rows = {n: rng.random(3000) for n in quality_rules.statistics()}
    bad = ((rows["symbols_per_word"] > 0.6) & (rows["n_words"] < 0.5)) | (rows["upper_share"] > 0.9)
    rules = quality_rules.fit(rows, (~bad).astype(int))
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= rule.covers(rows)
    assert (found == bad).mean() > 0.97 and len(rules) >= 2
    counted = quality_rules.with_counts(documents(spark, ["##### " * 60, "plain words here"]))
    rule = quality_rules.Rule((("symbols_per_word", True, 1.0), ("n_words", True, 50.0)))
    assert [r[0] for r in counted.select(quality_rules.verdict([rule])).collect()] == [False, True]
    assert "WHEN" in str(quality_rules.verdict([rule]))
    assert quality_rules.fit(rows, np.ones(3000, int)) == []


def test_quality_edges(spark):
    frame = clashing(spark, ["a b c", "", "x" * 200_000])
    out = {r["doc_id"]: r["n_words"] for r in quality_rules.with_counts(frame).collect()}
    assert out == {0: 3, 1: 0, 2: 1, None: 0}
    empty = quality_rules.with_counts(frame.limit(0))
    assert empty.count() == 0 and "a.b" in empty.columns
    labels = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id bigint, quality int")
    assert quality_rules.learn(frame, labels) == []
    assert quality_rules.learn(frame.limit(0), labels.limit(0)) == []


# --- 2 and 4 -----------------------------------------------------------------


def test_encoding_equals_the_library():
    content = bpe.read_vocabulary(H.VOCABULARY)
    encoder, library = bpe.WordEncoder(content), Tokenizer.from_str(content.decode())
    for t in [*odd_texts(random.Random(3)), "a" * 5000 + "thereof" * 500, "qxzj" * 50, "don't!'s we'll"]:
        ids = library.encode(t, add_special_tokens=False).ids
        n, found, decoded = encoder.text(t)
        assert (n, np.frombuffer(found, np.int32).tolist()) == (len(ids), ids), repr(t)
        assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_cut():
    encoder = bpe.WordEncoder(bpe.read_vocabulary(H.VOCABULARY))
    letters = "abcdefghijklmnopqrstuvwxyz"
    apart = [a + b for a in letters for b in letters if a + b not in encoder.inside]
    assert apart and encoder.cuts(apart[0] + "the") == [1] and not encoder.cuts("the")
    for word in (f"the{apart[0]}tion", *(f"in{p}g{p}" for p in apart[:40])):
        bounds = [0, *encoder.cuts(word), len(word)]
        parts = [encoder._closing if b == len(word) else encoder._inner for b in bounds[1:]]
        ids = [t.id for m, a, b in zip(parts, bounds, bounds[1:]) for t in m.tokenize(word[a:b])]
        assert ids == [t.id for t in encoder._closing.tokenize(word)]


def test_encoding_edges(spark, monkeypatch):
    frame = clashing(spark, ["The cat", "", "The cat", "word " * 50_000])
    out = {r["doc_id"]: r for r in bpe.encode_texts(frame, H.VOCABULARY).collect()}
    assert out[0]["ids"] == out[2]["ids"] and out[0]["n_tokens"] == 2
    assert out[1]["ids"] == [] and out[None]["decoded"] == "" and out[3]["n_tokens"] == 50_000
    assert bpe.encode_texts(frame.limit(0), H.VOCABULARY).count() == 0
    again = bpe.decode_ids(bpe.encode_texts(frame, H.VOCABULARY).drop("decoded"), H.VOCABULARY)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {i: r["decoded"] for i, r in out.items()}


@pytest.mark.parametrize("block", [1, 3, 64])
def test_token_counts_across_blocks(spark, block, monkeypatch):
    texts = ["the cat sat", "", None, "one two three four five six seven", "<|endoftext|> x", ""]
    frame = documents(spark, texts).coalesce(1)
    blocks = token_counts.flat_blocks(frame, H.VOCABULARY, 49407, block_tokens=block)
    rows = token_counts.count_tokens(blocks, 49407, carried=["doc_ids"]).orderBy("ordinal").collect()
    encoder = bpe.WordEncoder(bpe.read_vocabulary(H.VOCABULARY), special=False)
    expected = [encoder.text(t or "")[0] for t in texts]
    assert [r["n_tokens"] for r in rows] == expected
    assert [r["doc_ids"] for r in rows] == list(range(6))
    starts = np.concatenate([[0], np.cumsum(np.array(expected) + 1)])[:-1]
    assert [r["token_start"] for r in rows] == starts.tolist() and all(r["terminated"] for r in rows)


def test_token_files_and_groups_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 2)
    rng = np.random.default_rng(4)
    expected = {}
    for name in ("a", "b", "c"):
        tokens = rng.integers(0, 4, 5000 if name != "c" else 3).astype(np.uint16)
        tokens[-1] = 0 if name == "a" else 1
        (tmp_path / name).write_bytes(tokens.tobytes())
        ends = np.flatnonzero(tokens == 0)
        lengths = np.diff(ends, prepend=-1) - 1
        rest = len(tokens) - (ends[-1] + 1 if len(ends) else 0)
        expected[name] = lengths.tolist() + ([int(rest)] if rest else [])
    (tmp_path / "empty").write_bytes(b"")
    blocks = token_counts.read_blocks(spark, str(tmp_path), width=2, block_tokens=7)
    found = {}
    for r in token_counts.count_tokens(blocks, 0, width=2).orderBy("file", "ordinal").collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["n_tokens"], r["terminated"]))
    assert {k: [n for n, _ in v] for k, v in found.items()} == expected
    assert found["a"][-1][1] and not found["b"][-1][1]
    assert token_counts.count_tokens(blocks.limit(0), 0, width=2).count() == 0


# --- 3 -----------------------------------------------------------------------


def near_texts(rng):
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    out = []
    for _ in range(60):
        w = list(base[: rng.choice([80, 80, 75, 50])])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = str(rng.random())
        out.append(" ".join(w))
    out += [" ".join(rng.choice(base) for _ in range(20)) for _ in range(20)]
    return [*out, None, "", " \n", "a b", "A  b", "a", "a b c", *[out[3]] * 5, "w " * 3000]


@pytest.mark.parametrize("most", [3, 512])
def test_near_duplicates_equal_all_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_DOCUMENTS", most)
    texts = near_texts(random.Random(most))
    out = near_dup.near_duplicates(documents(spark, texts), words=4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert found == H.near_duplicates(enumerate(texts))


def test_near_duplicate_edges(spark):
    frame = clashing(spark, ["a b c d e f g", "a b c d e f g", "", "other words stand here today"])
    rows = near_dup.near_duplicates(frame.union(frame)).collect()
    assert len(rows) == 10
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {
        (0, 0, True), (1, 0, False), (2, 2, True), (3, 3, True), (None, None, True),
    }
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0
    two = spark.createDataFrame([(5, "p q r s t"), (5, "u v w x y"), (7, "u v w x y")], "doc_id int, text string")
    assert {r["component_id"] for r in near_dup.near_duplicates(two).collect()} == {5}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = _components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r["node"], r["component"]) for r in found} == {
        *((i, 0) for i in range(301)), (1000, 1000), (1001, 1000),
    }


# --- 5 -----------------------------------------------------------------------


@pytest.mark.parametrize("block,dims,spread", [(4096, 8, 1), (16, 8, 1), (16, 64, 6)])
def test_search_equals_all_products(spark, block, dims, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(block + dims)
    v = rng.normal(size=(150, dims)) * np.exp(rng.uniform(0, spread, 150))[:, None] / 8
    v[20:30] = v[10:20]
    rows = [(i * 5, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1050, []), (1100, [float("nan")] * dims), (1150, [None] * dims), (None, rows[0][1])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>")
    out = topk.top_products(frame, frame.filter("vec_id % 50 = 0"), k=5)
    whole = np.floor(256 * v).astype(int)
    expected = set()
    for q in range(0, 150, 10):
        scores = whole @ whole[q]
        best = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:5]
        expected |= {(q * 5, r + 1, i * 5, int(scores[i])) for r, i in enumerate(best)}
    assert {tuple(r) for r in out.collect()} == expected


def test_search_edges(spark):
    schema = "score int, vec_id bigint, embedding array<float>, id string, v int, bucket int"
    rows = [(None, i, [1.0, float(i)], None, None, None) for i in (0, 1, 2)]
    frame = spark.createDataFrame([*rows, (1, 50, [3.0], "x", 1, 1)], schema)
    out = topk.top_products(frame.union(frame), frame.filter("vec_id % 50 = 0"))
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert topk.top_products(frame.limit(0), frame.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [0.0, 0.001]) for i in range(0, 140, 10)], "vec_id int, embedding array<double>")
    out = topk.top_products(flat, flat.filter("vec_id % 50 = 0"))
    assert {(r["rank"], r["score"]) for r in out.collect()} == {(r, 0) for r in range(1, 6)}
    large = spark.createDataFrame([(0, [1e15]), (50, [1e15])], "vec_id int, embedding array<double>")
    assert {r["score"] for r in topk.top_products(large, large).collect()} == {2**63 - 1}


def test_queries_visit_the_buckets_that_their_own_threshold_leaves(spark):
    asked = spark.createDataFrame(
        [(1, 2, 0, float("-inf")), (2, 2, 0, 5.0), (3, 2, 0, 7.5), (4, 2, 1, 7.5), (5, 3, 0, 1.0)],
        "id bigint, dims int, q_block int, threshold double",
    )
    pairs = spark.createDataFrame(
        [(2, b, q, longest) for b, longest in enumerate([2.0, 5.0, 7.0, 9.0]) for q in (0, 1)],
        "dims int, bucket int, q_block int, longest double",
    )
    visits = {(r["id"], r["bucket"]) for r in topk._visits(asked, pairs).collect()}
    assert visits == {*((1, b) for b in range(4)), (2, 1), (2, 2), (2, 3), (3, 3), (4, 3)}


def test_a_bucket_is_searched_by_queries_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(3)
        v = rng.integers(-3, 4, (300, 4))
        rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        out = topk.top_products(frame, frame.filter("vec_id % 3 = 0"), k=4, scale=1.0)
        expected = set()
        for q in range(0, 300, 3):
            scores = v @ v[q]
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:4]
            expected |= {(q, r + 1, i, int(scores[i])) for r, i in enumerate(best)}
        assert {tuple(r) for r in out.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- 6 -----------------------------------------------------------------------


def test_copies_equal_the_inverted_distribution(spark):
    rng = random.Random(6)
    sources = [rng.choice("aaaaab") if i % 3 else None for i in range(900)]
    frame = spark.createDataFrame(list(zip(range(900), sources)), "doc_id bigint, source string")
    found = Counter(r["doc_id"] for r in mixing.replicate(frame).collect())
    rates = H.root_rates(sources)
    assert found == +Counter({i: H.copies(i, rates[s]) for i, s in enumerate(sources)})


def test_mixing_reaches_targets_in_random_order(spark):
    frame = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "hot").otherwise("cold").alias("source")
    )
    targets = spark.createDataFrame([("hot", 1.0), ("cold", 3.0)], "source string, weight double")
    out = mixing.replicate(frame, targets).coalesce(1).collect()
    share = sum(r["source"] == "cold" for r in out) / len(out)
    assert abs(share - 0.75) < 0.02 and abs(len(out) - 20_000) < 700
    ids = [r["doc_id"] for r in out]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.05
    rates = {r["source"]: r["rate"] for r in mixing.target_rates(frame, targets).collect()}
    assert math.isclose(rates["cold"], 3.0) and math.isclose(rates["hot"], 1 / 3)


def test_mixing_edges(spark):
    frame = clashing(spark, ["a", "b", "c"])
    out = mixing.replicate(frame.union(frame))
    assert {"a.b", "copies", "copy"} <= set(out.columns)
    assert {(r["doc_id"], r["copies"]) for r in out.collect()} == {
        (i, n) for i in (0, 1, 2, None) if (n := H.copies(i, 1.0))
    }
    assert mixing.replicate(frame.limit(0)).count() == 0
    none = spark.createDataFrame([("q", 1.0)], "source string, weight double")
    assert mixing.replicate(frame, none).count() == 0
    plan = mixing.replicate(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 7 -----------------------------------------------------------------------


def test_urls(spark):
    rules = [
        ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
        ("block", "net/es/"), ("block", "net/fr/"),
    ]
    urls = {
        "http://A.Example.COM/en/1?x=/": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/a#b": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://www.example.com/EN/": ("www.example.com", "/EN/", "com/", "allow"),
        "http://a.net/fr/1": ("a.net", "/fr/1", "net/fr/", "block"),
        "http://net/es/": ("net", "/es/", "net/es/", "block"),
        "http://anet/es/": ("anet", "/es/", None, None),
        "http://big-casino.org/poker": ("big-casino.org", "/poker", None, "block"),
        "http://city-library.org/maps": ("city-library.org", "/maps", None, "allow"),
        "http://a.com?x": ("a.com", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no url": ("", "", None, "allow"),
        "x://\ny/z\nw": ("\ny", "/z\nw", None, None),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÀB.com/É": ("Àb.com", "/É", "com/", "allow"),
    }
    frame = spark.createDataFrame([(u, "clash", "clash") for u in urls], "url string, host string, rule string")
    model = url_filter.fit(url_filter.labelled_urls())
    for r in url_filter.judge(frame, rules, model).collect():
        host, path, rule, verdict = urls[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert verdict in (None, r["verdict"]), r
    assert url_filter.judge(frame.limit(0), rules, model).count() == 0
    assert url_filter.judge(frame, [], url_filter.fit([])).count() == len(urls)
    held = url_filter.fit(url_filter.labelled_urls()[::2])
    other = url_filter.labelled_urls()[1::2]
    p = held.log_odds(["".join(url_filter._parts(u)) for u, _ in other])
    assert np.mean((p > 0) == np.array([y for _, y in other])) > 0.95


# --- 8 -----------------------------------------------------------------------


def test_toxic_sentences_are_found(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]

    def text(toxic):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(rng.randint(1, 12))]
        if toxic:
            s = rng.randrange(len(sentences))
            sentences[s] = "you " + rng.choice(["vileness", "vilest", "foul"]) + " one " + sentences[s]
        return " ".join(sentences)

    labels = [int(rng.random() < 0.2) for _ in range(600)]
    texts = [text(y) for y in labels]
    model = toxicity.fit(texts[:400], labels[:400])
    frame = documents(spark, texts[400:])
    rows = toxicity.score(frame, model).orderBy("doc_id").collect()
    right = [(r["score"] >= 0.3) == bool(y) for r, y in zip(rows, labels[400:])]
    assert np.mean(right) > 0.97
    for r, y in zip(rows, labels[400:]):
        for s in r["offending"]:
            assert not y or " one " in r["text"][s["start"] : s["stop"]]


def test_toxicity_edges(spark):
    frame = clashing(spark, ["Fine. words", "", "... 12 !!", "x" * 100_000])
    model = toxicity.Model({"fine": 20.0}, -8.0)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert out[0] > 0.99 and out[1] == out[2] == out[None] == 0 and 0 < out[3] < 0.01
    assert toxicity.score(frame.limit(0), model).count() == 0
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.learn(frame, labels).weights == {}
    assert toxicity.fit(["a", "b"], [1, 1]).weights == {}


# --- 9 -----------------------------------------------------------------------


def test_languages_of_code_switched_words(spark):
    rng = random.Random(9)
    stems = {"xx": ["kar", "tok", "wip"], "yy": ["éla", "oui", "sée"], "zz": ["ßen", "ung", "kei"]}
    word = {k: lambda v=v: "".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for k, v in stems.items()}
    passages = [(k, " ".join(word[k]() for _ in range(60))) for k in stems for _ in range(20)]
    model = language_id.fit(passages)
    mixed = " ".join([word["xx"]() for _ in range(40)] + [word["yy"]() for _ in range(30)])
    frame = clashing(spark, [mixed, "...", "", passages[-1][1], "karkar " * 5000])
    out = {r["doc_id"]: r for r in language_id.identify(frame, model, spans=True).collect()}
    assert out[0]["lang_pred"] == "xx" and 0.5 < out[0]["score"] < 0.65
    assert [(s["lang"], s["first"], s["stop"]) for s in out[0]["spans"]] == [("xx", 0, 40), ("yy", 40, 70)]
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, None)] == ["und", "und", "zz", "xx", "und"]
    assert out[1]["score"] == 0 and language_id.identify(frame.limit(0), model).count() == 0
    nothing = language_id.learn(frame)
    assert {r["lang_pred"] for r in language_id.identify(frame, nothing).collect()} == {"und"}


def test_forward_backward_equals_a_plain_chain():
    rng = np.random.default_rng(9)
    model = language_id.Model(["a", "b", "c"], np.zeros((1 << language_id.TABLE_BITS, 3), np.float32), rng.normal(size=(3, 3)))
    labeller = language_id._Labeller(model)
    labeller.table = np.exp(rng.normal(size=(50, 3)))
    counts = np.array([0, 1, 33, 200, 0, 32, 64, 5])
    rows = rng.integers(0, 50, counts.sum())
    found = labeller._chain(rows, counts)
    t, at = np.exp(model.transitions), 0
    for n in counts:
        e = labeller.table[rows[at : at + n]]
        # A text of one word or more starts from languages that are equally likely.
        f, b = [], [np.ones(3)]
        for i in range(n):
            f.append((np.full(3, 1 / 3) @ t if not i else f[-1] @ t) * e[i])
            f[-1] /= f[-1].sum()
        for i in range(n - 1, 0, -1):
            b.append((b[-1] * e[i]) @ t.T)
            b[-1] /= b[-1].sum()
        if n:
            p = np.array(f) * np.array(b[::-1])
            assert np.allclose(found[at : at + n], p / p.sum(1, keepdims=True))
        at += n


# --- 10 ----------------------------------------------------------------------


def passages(rng, n=60):
    shared = [bytes(rng.choice(b"abcde ") for _ in range(rng.choice([100, 140, 400]))) for _ in range(3)]
    rows = []
    for i in range(n):
        own = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 150))) for _ in range(3)]
        parts = [own[0], rng.choice([*shared, b"", b"z" * 230, "éü".encode() * 80]), own[1]]
        if rng.random() < 0.3:
            parts += [shared[0], own[2], parts[0]]
        rows.append((i, b"".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, b""), (n + 3, b"q" * 99), (n + 4, b"q" * 100)]
    return rows


def check_repeats(frame, rows, width=100, **options):
    expected = H.without_repeats(rows, width)
    for r in suffix_dedup.remove_repeats(frame, width=width, **options).collect():
        spans = [(s["start"], s["stop"]) for s in r["spans"]]
        assert (spans, bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]
        data = dict(rows)[r["doc_id"]]
        edges = [0, *(e for s in spans for e in s), len(data)]
        parts = [data[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2])]
        assert r["kept_text"] == "".join(parts)


@pytest.mark.parametrize("width,seed", [(100, 1), (64, 2), (101, 3)])
def test_repeats_equal_a_table_of_windows(spark, width, seed):
    rows = passages(random.Random(seed))
    frame = spark.createDataFrame([(i, b.decode("utf-8", "replace")) for i, b in rows], "doc_id bigint, text string")
    check_repeats(frame, [(i, b.decode("utf-8", "replace").encode()) for i, b in rows], width, partitions=5)


def test_frequent_anchors_and_long_texts(spark, monkeypatch):
    """Borders of a shared passage in more documents than one slice lets meet."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(300))
    texts = ["".join(rng.choice("ghijkl ") for _ in range(80)) + passage + str(i) * 60 for i in range(90)]
    texts.append("".join(rng.choice("mnopq ") for _ in range(5000)) * 2)
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    frame = documents(spark, texts)
    assert suffix_dedup.FREQUENT < 90
    check_repeats(frame.coalesce(1), rows)
    # In one process, with slices much smaller than the texts.
    monkeypatch.setattr(suffix_dedup, "SLICE", 512)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 2)
    import pyarrow as pa

    columns = ["d", "x", "t"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()),
         pa.array(texts)], columns
    )
    first = list(suffix_dedup._first_digits(100, 3, columns)(iter([batch])))
    second = list(suffix_dedup._second_digit(iter(first)))
    codes = {}
    for b in second:
        for d, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            codes.setdefault(d, []).append(c)
    asked = pa.RecordBatch.from_arrays(
        [pa.array(list(codes), pa.int64()), pa.array([0] * len(codes), pa.int64()),
         pa.array(list(codes.values())), pa.array([texts[d] for d in codes])],
        ["d", "x", "c", "t"],
    )
    third = list(suffix_dedup._bytes_of_runs(100, 3, ["d", "x", "c", "t"])(iter([asked])))
    for b in suffix_dedup._last_digits(100)(iter(third)):
        for d, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
            codes[d].append(c)
    covered = {i: bytearray(len(b)) for i, b in rows}
    for d, c in ((d, c) for d, cs in codes.items() for c in cs if c & 3 == suffix_dedup.REMOVED):
        a, n = c >> 9, (c >> 2) & 127
        covered[d][a : a + n + 99] = b"\1" * (n + 99)
    expected = H.without_repeats(rows)
    for i, b in rows:
        assert bytes(c for c, f in zip(b, covered[i]) if not f) == expected[i][1]


def test_repeat_edges(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    frame = clashing(spark, [text, "", "x" * 50, text])
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert bytes(out[0]["kept"]).decode() == text and bytes(out[3]["kept"]) == b""
    assert out[None]["spans"] == [] and out[None]["kept_text"] is None and "a.b" in frame.columns
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0
    # Rows of one id are one document: equal places do not remove each other.
    again = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id int, text string")
    kept = sorted((r["doc_id"] or 0, len(r["kept"])) for r in suffix_dedup.remove_repeats(again).collect())
    assert kept == [(0, 300), (1, 0), (1, 0)]
    same = suffix_dedup.remove_repeats(again.filter("doc_id = 1"))
    assert [len(r["kept"]) for r in same.collect()] == [300, 300]
    cut = spark.createDataFrame([(0, "a" + "é" * 60), (1, "é" * 60)], "doc_id int, text string")
    rows = [(0, ("a" + "é" * 60).encode()), (1, ("é" * 60).encode())]
    check_repeats(cut, rows)
