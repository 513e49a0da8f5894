"""The registered queries over the given tables, and the pipeline stage by stage."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from gridseries.llm import language_id, queries
from tests.compare import connect, differences
from tests.llm import helpers as H

SMALL, MEDIUM, LARGE = (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1"))


def rows(spark, name, sf_dir):
    return contract.queries()[name](spark, sf_dir).collect()


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SMALL), SMALL, name)[:3] == []


def test_quality_query(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    found = rows(spark, "op1_quality_rules", MEDIUM)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in labels and not r["base_failed"]]
    times = Counter(judged)
    assert times[1, False] <= 0.02 * (times[1, True] + times[1, False])
    assert times[0, False] >= 0.6 * (times[0, True] + times[0, False])


def test_encoding_query(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = texts_of(spark, SMALL)
    counted = {r["doc_id"]: r["n_tokens"] for r in rows(spark, "op4_token_counts", SMALL)}
    found = rows(spark, "op2_bpe", SMALL)
    assert len(found) == len(counted) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == counted[r["doc_id"]] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_url_query(spark):
    for r in rows(spark, "op7_url_filter", MEDIUM):
        best = None
        for verdict, rule in queries.URL_RULES:
            host, _, path = rule.partition("/")
            if ("." + r["host"]).endswith("." + host) and r["path"].startswith("/" + path):
                best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
        if best:
            assert (r["rule"], r["verdict"]) == best
        else:
            assert r["rule"] is None and r["verdict"] == ("block" if r["probability"] >= 0.5 else "allow")
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    for r in rows(spark, "op7_url_filter", MEDIUM):
        host, path = re.match(r"^.*?://([^/?#]*)([^?#]*)", urls[r["page_id"]]).groups()
        assert (r["host"], r["path"]) == (host.lower(), path)


def test_toxicity_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    times = Counter()
    for r in rows(spark, "op8_toxicity", LARGE):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in labels:
            times[labels[r["doc_id"]], r["predicted"]] += 1
    assert times[1, 1] >= 0.85 * (times[1, 0] + times[1, 1])
    assert times[0, 1] <= 0.03 * (times[0, 0] + times[0, 1])


def test_languages_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    found = rows(spark, "op9_language_id", MEDIUM)
    assert len(found) == len(langs)
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(right) >= 0.98 * len(right)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage on what the one before it wrote, beside a plain version."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(
        [(10_000, None, "en", "src0", 0), (10_001, "123 ...", None, "src1", 7), (10_002, "", "de", None, 0),
         (None, "the of and to in that is", None, None, None)],
        documents.schema,
    )
    docs, columns = documents.union(odd), documents.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = str(tmp_path / str(len(kept)))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = before, docs.collect()
        if len(kept) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    languages, near, suffix, mixed, coded = kept.values()

    letters = {r["doc_id"] for r in languages[0] if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in languages[1]} == letters and None in letters
    assert all(r["lang"] for r in languages[1])

    groups = H.near_duplicates([(r["doc_id"], r["text"]) for r in near[0] if r["doc_id"] is not None], 5)
    assert sorted((r["doc_id"] for r in near[1] if r["doc_id"] is not None)) == sorted(
        i for i, (_, component) in groups.items() if i == component
    )

    expected = H.without_repeats([(r["doc_id"], r["text"].encode()) for r in suffix[0]])
    for r in suffix[1]:
        spans, _ = expected[r["doc_id"]]
        data = next(x["text"] for x in suffix[0] if x["doc_id"] == r["doc_id"]).encode()
        edges = [0, *(e for s in spans for e in s), len(data)]
        left = "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
        assert r["text"] == left and r["n_chars"] == len(left)

    rates = H.root_rates(r["source"] for r in mixed[0])
    times = +Counter({r["doc_id"]: H.copies(r["doc_id"], rates[r["source"]]) for r in mixed[0]})
    assert Counter(r["doc_id"] for r in mixed[1]) == times

    library = Tokenizer.from_file(queries.WORD_BPE)
    texts = {r["doc_id"]: r["text"] for r in coded[0]}
    assert len(coded[1]) == len(coded[0])
    for r in coded[1]:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_pipeline_of_nothing_and_of_repeated_rows(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").limit(12)
    docs = documents.union(documents)
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SMALL)
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and ids
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_a_mixed_language_document_is_kept(spark):
    assert language_id.UNKNOWN == "und"
    texts = texts_of(spark, SMALL)
    mixed = " ".join(texts[i][:300] for i in sorted(texts)[:8])
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = spark.createDataFrame([(1, mixed, None, "s", 1)], documents.schema)
    assert corpus_pipeline.identify_languages(spark, documents.union(one), SMALL).count() == len(texts) + 1
