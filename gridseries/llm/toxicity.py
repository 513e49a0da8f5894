"""Toxicity of texts by multiple-instance learning.

A text is a bag of sentences of which only the bag's label is known. A sentence
is toxic with a probability that its words decide, and a text is toxic if at
least one of its sentences is (noisy-or). Weights of words and of their
beginnings are learned from the labels of texts; the sentence probabilities then
say where the offence is.
"""

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.llm._columns import turn, with_results

# Bounds of the training sample: labelled texts, and bytes of all of them.
TEXTS = 4000
SAMPLE_BYTES = 48 << 20
# Texts of the sample that must have a word for it to get a weight.
LEAST_TEXTS = 3
REMEMBERED = 200_000
# Log odds between the labels, and standard errors, from which a word counts.
LEAST_ODDS = 1.5
CLEAR = 4.0
# A sentence from this probability on is offending.
OFFENDING = 0.3

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def _softplus(z):
    return np.logaddexp(0, z)


def _features(word: str) -> list[str]:
    """A word and its beginnings, which stand for words of one stem."""
    return [word, *("^" + word[:n] for n in range(4, 9) if len(word) > n)]


class _Weights(dict):
    """Weight of every word met, as the sum over its features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        found = math.fsum(self.weights.get(f, 0.0) for f in _features(word))
        if len(word) < 64:
            self[word] = found
        return found


def _candidates(bags: list[list[set]], y: np.ndarray) -> dict[str, float]:
    """Features met clearly more often in texts of label 1, with their log odds."""
    times: dict[str, list[int]] = {}
    for bag, label in zip(bags, y):
        for f in {f for w in set().union(*bag) for f in _features(w)}:
            times.setdefault(f, [0, 0])[int(label)] += 1
    n1, n0 = int(y.sum()), int((~y).sum())
    found = {}
    for w, (without, having) in times.items():
        if without + having < LEAST_TEXTS:
            continue
        p = (without + having) / (n0 + n1)
        gap = having / n1 - without / n0
        odds = math.log((having + 0.5) / (n1 + 1)) - math.log((without + 0.5) / (n0 + 1))
        if odds > LEAST_ODDS and gap > CLEAR * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)):
            found[w] = odds
    return found


def fit(texts: list[str], labels: list[int], *, rounds: int = 150, pull: float = 1e-3) -> Model:
    """Learn weights by gradient steps on the likelihood of the labels.

    Only features that tell the labels apart on their own get a weight; it starts
    at half its log odds, which also draw it back a little (``pull``). Without both
    labels the model gives every sentence the share of label 1.
    """
    y = np.array(labels, bool)
    share = float(y.mean()) if len(y) else 0.0
    bags = [[set(_WORD.findall(s.lower())) for s in _SENTENCE.findall(t)] for t in texts]
    odds = _candidates(bags, y) if y.any() and not y.all() else {}
    if not odds:
        return Model({}, math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    names = sorted(odds)
    index = {w: i for i, w in enumerate(names)}
    rows, columns, owner, s = [], [], [], 0
    for b, bag in enumerate(bags):
        blank = False
        for sentence in bag:
            found = [index[f] for w in sentence for f in _features(w) if f in index]
            # As in a score, sentences without any weighted word count as one.
            if not sentence or (blank and not found):
                continue
            blank = blank or not found
            columns += found
            rows += [s] * len(found)
            owner.append(b)
            s += 1
    rows, columns, owner = np.array(rows), np.array(columns), np.array(owner)
    start = np.array([odds[w] for w in names]) / 2
    value = np.append(start, -5.0)
    m, v = np.zeros(len(value)), np.zeros(len(value))
    for step in range(1, rounds + 1):
        z = value[-1] + np.bincount(rows, value[columns], s)
        total = np.bincount(owner, _softplus(z), len(y))
        slope = np.where(y, -1 / np.expm1(np.clip(total, 1e-6, 700)), 1.0) / len(y)
        by_sentence = slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(columns, by_sentence[rows], len(names)), by_sentence.sum())
        grad[:-1] += pull * (value[:-1] - start)
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(names, value[:-1].tolist())), float(value[-1]))


def learn(
    documents: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    texts: int = TEXTS,
    most_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit a model on at most ``texts`` labelled rows, drawn by a hash of
    ``doc_id``, and as many of them in the order of the hash as have ``most_bytes``
    of text together; each is learned from whole. Rows without text or label, or
    with more text than that alone, take no part; of several labels of one id the
    highest counts."""
    drawn = (
        labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y"))
        .filter("i IS NOT NULL AND y IN (0, 1)")
        .groupBy("i")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("i"))
        .orderBy("h", "i")
        .limit(texts)
    )
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")
    ).filter("t IS NOT NULL")
    # The drawn rows are bounded by the parameter, so they may be broadcast.
    found = rows.join(F.broadcast(drawn.select("i", "y", "h")), "i")
    # Sizes first: texts are fetched only if they fit.
    order = Window.orderBy("h", "i", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = found.select("h", "i", F.xxhash64("t").alias("x"), F.octet_length("t").alias("n"))
    sizes = sizes.filter(F.col("n") <= most_bytes).orderBy("h", "i", "x").limit(texts)
    kept = sizes.withColumn("all", F.sum("n").over(order)).filter(F.col("all") <= most_bytes)
    kept = {(r["h"], r["x"]) for r in kept.collect()}
    fits = found.filter(F.octet_length("t") <= most_bytes).withColumn("x", F.xxhash64("t"))
    last = max(kept, default=None)
    if last is None:
        return fit([], [])
    fits = fits.filter(F.col("h") <= last[0]).orderBy("h", "i", "x").limit(len(kept))
    sample = [r for r in fits.select("h", "x", "t", "y").collect() if (r["h"], r["x"]) in kept]
    return fit([r["t"] for r in sample], [r["y"] for r in sample])


def score(
    documents: DataFrame, model: Model, *, text: str = "text", offending: float = OFFENDING
) -> DataFrame:
    """Add ``score`` and ``offending``.

    ``score`` is the probability that some sentence of the whole text is toxic,
    where those without any weighted word count as one, however many they are;
    ``offending`` lists the sentences whose own probability is at least
    ``offending`` (``start``, ``stop`` in characters, ``score``). A NULL, empty
    or wordless text has no sentence that could be toxic: score 0. Rows are
    independent, so repeated rows have equal results; columns named like a
    result are replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> pa.Array:
        turn("toxicity", lambda: None)
        weights, bias = _Weights(sent.value.weights), sent.value.bias
        plain = float(_softplus(bias))
        scores, where = [], []
        for t in texts.to_pylist():
            total, found, blank = 0.0, [], 0.0
            for m in _SENTENCE.finditer(t or ""):
                words = set(_WORD.findall(m[0].lower()))
                if not words:
                    continue
                own = math.fsum(map(weights.__getitem__, words))
                if not own:
                    blank = plain
                    continue
                z = bias + own
                total += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                p = 1 / (1 + math.exp(-z)) if z > -500 else 0.0
                if p >= offending:
                    found.append({"start": m.start(), "stop": m.end(), "score": p})
            scores.append(-math.expm1(-total - blank))
            where.append(found)
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(where, pa.list_(kind))], ["score", "offending"]
        )

    return with_results(
        documents, text, work,
        "score double, offending array<struct<start: int, stop: int, score: double>>",
    )
