"""Beyond the limits that operators once had."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridseries.llm import language_id, mixing, toxicity, url_filter
from tests.compare import TABLES, differences

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# --- 6 -----------------------------------------------------------------------


@pytest.mark.parametrize("rate", [0.3, 7.0, 800.0, 1e5, 3e6])
def test_large_rates(spark, rate):
    """The distribution around the mean, summed to one; quick for any mean."""
    start = time.time()
    row = mixing.cumulative(spark.createDataFrame([("s", rate), (None, 0.0)], "source string, rate double")).filter("rate > 0").first()
    assert time.time() - start < 20
    assert len(row["cdf"]) < 20 * math.sqrt(rate) + 40
    total, term = 0.0, -rate + row["least"] * math.log(rate) - math.lgamma(row["least"] + 1)
    for k, c in enumerate(row["cdf"], row["least"]):
        total += math.exp(term)
        assert abs(c - total) < 1e-7
        term += math.log(rate / (k + 1))


def test_a_rare_source_in_a_large_corpus(spark):
    big = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"))
    frame = big.union(spark.createDataFrame([(-1, "rare"), (-2, "rare")], big.schema))
    targets = spark.createDataFrame([("big", 0.2), ("rare", 0.8)], "source string, weight double")
    rate = {r["source"]: r["rate"] for r in mixing.target_rates(frame, targets).collect()}["rare"]
    found = Counter(r["doc_id"] for r in mixing.replicate(frame, targets).filter("source = 'rare'").select("doc_id").collect())
    assert rate > 20_000
    for i in (-1, -2):
        assert abs(found[i] - rate) < 6 * math.sqrt(rate)


def test_mixing_equals_sql_without_ids(spark, tmp_path):
    """Rows without id, NULLs in any column, a source of a large rate."""
    rng = random.Random(6)
    rows = [(i if rng.random() < 0.7 else None, rng.choice([None, "", f"t{i}"]), rng.choice([None, "en"]),
             rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1])) for i in range(3000)]
    rows += [(None, "x", None, "a", 5), (None, None, "x", "a", 5), (None, "alone", "en", "rare", 1)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    assert "documents" in TABLES
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, db, str(tmp_path), "op6_mixing")[:3] == []
    frame = spark.createDataFrame(rows[-3:-1], DOCUMENTS)
    keys = [r["shuffle_key"] for r in mixing.replicate(frame.withColumn("source", F.lit("a")), power=1.0).collect()]
    assert len(set(keys)) == len(keys)


# --- 8 -----------------------------------------------------------------------


def test_a_long_text_is_learned_from_whole(spark):
    """Of long toxic texts one sentence offends; no plain word gets a weight for it."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]

    def text(toxic):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(900)]
        if toxic:
            sentences[rng.randrange(900)] += " vileness"
        return ". ".join(sentences) + "."

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    assert min(len(t) for _, t, _ in rows) > 40_000
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert max(model.weights, key=model.weights.get).strip("^") in "vileness"
    for r in toxicity.score(frame, model).collect():
        assert (r["score"] >= 0.3) == bool(r["toxic"])


def test_the_sample_of_texts_has_a_size(spark):
    rows = [(i, "x " * 500 + ("vile. " if i % 2 else "fine. "), i % 2) for i in range(40)]
    rows += [(100, "y " * 10_000, 1), (None, "z", 1), (101, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    documents, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    for most in (5000, 1, 10**6):
        model = toxicity.learn(documents, labels, most_bytes=most)
        assert ("vile" in model.weights) == (most > 10**5)


def test_noisy_or(spark):
    model = toxicity.Model({"vile": 3.0}, -4.0)
    p, plain = 1 / (1 + math.exp(1.0)), 1 / (1 + math.exp(4.0))
    frame = spark.createDataFrame([("You vile. The cat. The dog! Vile one.",), ("The cat.",), ("You vile",)], "text string")
    out = [r["score"] for r in toxicity.score(frame, model).collect()]
    assert out == pytest.approx([1 - (1 - p) ** 2 * (1 - plain), plain, p])


# --- 9 -----------------------------------------------------------------------


def test_more_languages_than_a_model_has(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = ["".join(rng.sample(letters, 6)) for _ in range(230)]

    def text(k):
        return " ".join("".join(rng.choices(own[k], k=5)) for _ in range(40))

    rows = [(k * 100 + i, text(k), f"l{k:03d}") for k in range(230) for i in range(1 + (k < 12) * 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(frame, languages=12)
    assert model.languages == [f"l{k:03d}" for k in range(12)]
    assert len(model.left_out) == 218 and model.left_out[:2] == ("l012", "l013")
    out = language_id.identify(frame, model).collect()
    assert len(out) == len(rows)
    right = [r["lang_pred"] == r["lang"] for r in out if r["lang"] < "l012"]
    assert sum(right) > 0.8 * len(right)
    whole = language_id.learn(frame, passages=8)
    assert len(whole.languages) == language_id.LANGUAGES and len(whole.left_out) == 230 - language_id.LANGUAGES
    assert whole.weights.size <= language_id.WEIGHTS
    assert language_id.identify(frame, whole).count() == len(rows)


def test_tables_fit_their_bound():
    assert language_id.table_bits(4) == language_id.TABLE_BITS
    for k in (1, 16, 17, 64, 1000):
        assert k << language_id.table_bits(k) <= language_id.WEIGHTS


# --- 7 -----------------------------------------------------------------------


def test_rules_of_any_number(spark):
    """A table of rules gives what a plain search over all of them gives."""
    rng = random.Random(7)
    parts = ["a", "b", "com", "net", "x-y", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/é", "/.*"]

    def host():
        return ".".join(rng.choices(parts, k=rng.randint(1, 4)))

    rules = [(rng.choice(["allow", "block"]), host() + rng.choice(paths)) for _ in range(3000)]
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = [f"http://{host()}{rng.choice(paths)}{rng.choice(['', '2', '?q', '/en/'])}" for _ in range(400)]
    frame = spark.createDataFrame([(u, i) for i, u in enumerate([*urls, None, "none", *urls[:30]])], "url string, _match int")
    table = spark.createDataFrame([*rules, (None, "a"), ("block", None)], "verdict string, rule string")
    model = url_filter.fit([])
    out = url_filter.judge(frame, table, model)
    assert out.columns == url_filter.judge(frame, rules[:3], model).columns
    found = out.collect()
    assert len(found) == frame.count()
    for r in found:
        fits = []
        for verdict, rule in rules:
            domain, slash, rest = rule.partition("/")
            if ("." + r["host"]).endswith("." + domain) and r["path"].startswith(slash + rest):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=None)
        if best is None:
            assert r["rule"] is None and r["verdict"] == "block"
        else:
            assert (len(r["rule"]), r["verdict"]) == (best[0], {f[2] for f in fits if f[1] == r["rule"]}.pop())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_url_words_held_out():
    """Beginnings that the table does not have, with endings that it has: the four
    parts in turn. The given hosts share no word with the table."""
    caught, clean = [], []
    for k in range(4):
        known = [[w for i, w in enumerate(ws) if i % 4 != k] for ws in (url_filter.BLOCKED, url_filter.ALLOWED)]
        model = url_filter.fit(url_filter.labelled_urls(*known))
        for urls, into in (((url_filter.BLOCKED[k::4], []), caught), (([], url_filter.ALLOWED[k::4]), clean)):
            texts = ["".join(url_filter._parts(u)) for u, _ in url_filter.labelled_urls(*urls)]
            into += (model.log_odds(texts) >= 0).tolist()
    assert sum(caught) > 0.75 * len(caught) and sum(clean) < 0.02 * len(clean)
    given = "casino win free bets cheap pills ads track spam farm adult".split()
    assert not set(given) & {w for ws in (url_filter.BLOCKED, url_filter.ALLOWED) for w in ws}
