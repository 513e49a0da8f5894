"""Language of every word and text by a linear-chain conditional random field.

A word's features are its byte n-grams of two to four, with marks at both ends
so that affixes are features of their own, and the word itself if the training
passages had it often (the lexicon). Weights of features and of transitions
between the languages of neighbouring words are learned together from sequences
spliced of passages in different languages. Texts are labelled by the
forward-backward algorithm over all their words.
"""

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import turn, with_results

UNKNOWN = "und"
# Bounds of the training sample: passages of a language, characters of a passage, languages.
PASSAGES = 300
PASSAGE_CHARS = 1500
LANGUAGES = 64
# Names of languages left out that a model tells.
NAMED = 1000
# Times a word must occur in the training passages to be in the lexicon.
LEXICON = 5
# Feature weights are kept under their hash, in a table for each language. All
# tables together have WEIGHTS at most, so many languages have smaller ones.
TABLE_BITS = 18
WEIGHTS = 1 << 22
SEQUENCE = 64
# States of all training sequences together: words times languages.
STATES = 1 << 23
BLOCK = 32
REMEMBERED = 150_000
# The words of a slice take some thirty times its size, and more with the square of
# the number of languages.
SLICE_BYTES = 1 << 20
FEW_LANGUAGES = 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (size of a table, languages)
    transitions: np.ndarray  # (languages, languages), logarithms
    left_out: tuple[str, ...] = ()  # less frequent languages it has not learned


def table_bits(languages: int) -> int:
    """Bits of a feature's place in the table of each of so many languages."""
    return min(TABLE_BITS, (WEIGHTS // max(languages, 1)).bit_length() - 1)


def _nothing(left_out=()) -> Model:
    return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), left_out)


def _core(word: str) -> str:
    return word if word.isalpha() else "".join([c for c in word if c.isalpha()])


def _features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word after the other, and their counts."""
    data = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode(), np.uint8)
    first = np.flatnonzero(data == 2)
    size = np.diff(first, append=len(data))
    word = np.repeat(np.arange(len(words)), size)
    end = (first + size)[word]
    values = data.astype(np.uint64) + np.uint64(1)
    at = np.arange(len(data))
    found, owner = [], []
    gram = values
    for n in (2, 3, 4):
        gram = gram[:-1] * np.uint64(257) + values[n - 1 :]
        ok = at[: len(gram)] + n <= end[: len(gram)]
        found.append(gram[ok] * _MULTIPLIER)
        owner.append(word[: len(gram)][ok])
    # The whole word: its bytes weighted by their place.
    place = (at - first[word]).astype(np.uint64)
    mixed = (values + place * np.uint64(1009)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed * _MULTIPLIER, first)
    found.append((whole ^ (whole >> np.uint64(31))) * _MULTIPLIER)
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    hashed = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    return hashed[order], np.bincount(owner, minlength=len(words))


def _emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    features, counts = _features(words, len(weights).bit_length() - 1)
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(weights[features], starts, axis=0)


def fit(passages: list[tuple[str, str]], *, rounds: int = 60, seed: int = 9) -> Model:
    """Learn from ``(language, text)`` passages by maximum likelihood."""
    languages = sorted({lang for lang, _ in passages})
    k = len(languages)
    by_language = [
        [c for lang, t in passages if lang == one for c in map(_core, t.lower().split()) if c]
        for one in languages
    ]
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in by_language]
    total = sum(map(len, coded))
    sequences = max(1, min(4000, total // SEQUENCE, STATES // (SEQUENCE * k)))
    words = np.zeros((sequences, SEQUENCE), np.int64)
    truth = np.zeros((sequences, SEQUENCE), np.int64)
    for s in range(sequences):
        at, lang = 0, int(rng.integers(k))
        while at < SEQUENCE:
            n = min(int(rng.integers(8, SEQUENCE + 1)), SEQUENCE - at)
            source = coded[lang]
            start = int(rng.integers(max(1, len(source) - n + 1)))
            words[s, at : at + n] = np.resize(source[start : start + n], n)
            truth[s, at : at + n] = lang
            at, lang = at + n, int(rng.integers(k))
    names = list(vocabulary)
    bits = table_bits(k)
    features, counts = _features(names, bits)
    often = np.bincount(words.ravel(), minlength=len(names)) >= LEXICON
    # The last feature of a word is the word itself; only the lexicon keeps it.
    last = np.cumsum(counts) - 1
    keep = np.ones(len(features), bool)
    keep[last[~often]] = False
    owner = np.repeat(np.arange(len(names), dtype=np.int32), counts)[keep]
    features = features[keep].astype(np.int32)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    weights = np.zeros((1 << bits, k))
    transitions = np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((k, k)), np.zeros((k, k))]
    one_hot = np.eye(k)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    n_words = words.size
    for step in range(1, rounds + 1):
        scores = np.stack(
            [np.add.reduceat(weights[:, c][features], starts) for c in range(k)], 1
        )
        e = scores[words]
        e = np.exp(e - e.max(2, keepdims=True))
        t = np.exp(transitions)
        forward = np.empty_like(e)
        backward = np.empty_like(e)
        forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, SEQUENCE):
            f = forward[:, i - 1] @ t * e[:, i]
            forward[:, i] = f / f.sum(1, keepdims=True)
        backward[:, -1] = 1
        expected = np.zeros((k, k))
        for i in range(SEQUENCE - 2, -1, -1):
            after = backward[:, i + 1] * e[:, i + 1]
            b = after @ t.T
            backward[:, i] = b / b.sum(1, keepdims=True)
            both = (forward[:, i] @ t * after).sum(1, keepdims=True)
            expected += t * ((forward[:, i] / both).T @ after)
        posterior = forward * backward
        posterior /= posterior.sum(2, keepdims=True)
        slope = (posterior - one_hot[truth]).reshape(-1, k)
        by_word = np.stack(
            [np.bincount(words.ravel(), slope[:, c], len(names)) for c in range(k)], 1
        )
        gradient = np.stack(
            [np.bincount(features, by_word[:, c][owner], 1 << bits) for c in range(k)], 1
        ) / n_words
        gradient += 1e-6 * weights
        moves = (expected - pairs) / n_words + 1e-5 * transitions
        for value, grad, m, v in ((weights, gradient, *moments[:2]), (transitions, moves, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            scale = np.sqrt(v / (1 - 0.99**step)) + 1e-9
            value -= 0.1 * (m / (1 - 0.9**step)) / scale
    return Model(languages, weights.astype(np.float32), transitions)


class _Labeller:
    """Applies a model; remembers the emissions of the words met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.k = len(model.languages)
        self._reset()

    def _reset(self):
        # Row 0 stands for words without letters.
        self.rows: dict[str, int] = {}
        self.table = np.ones((1 << 12, self.k))
        self.letters = np.zeros(1 << 12, bool)
        self.used = 1

    def _learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(words))
        cores = list(map(_core, new))
        self.rows.update((w, 0) for w, c in zip(new, cores) if not c)
        pairs = [(w, c) for w, c in zip(new, cores) if c]
        if not pairs:
            return
        e = _emissions(self.model.weights, [c for _, c in pairs]).astype(np.float64)
        e = np.exp(np.maximum(e - e.max(1, keepdims=True), -30))
        stop = self.used + len(pairs)
        while stop > len(self.table):
            self.table = np.concatenate([self.table, np.ones_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.table[self.used : stop] = e
        self.letters[self.used : stop] = True
        self.rows.update((w, self.used + i) for i, (w, _) in enumerate(pairs))
        self.used = stop

    def posteriors(self, texts: list[str | None]):
        """Probabilities of each word's language, whether it has letters, and
        the number of words of each text."""
        words, counts = [], []
        for t in texts:
            found = t.lower().split() if t else []
            words += found
            counts.append(len(found))
        if len(self.rows) > REMEMBERED:
            self._reset()
        rows = list(map(self.rows.get, words))
        if None in rows:
            self._learn([w for w, r in zip(words, rows) if r is None])
            rows = [self.rows[w] if r is None else r for w, r in zip(words, rows)]
        rows = np.array(rows, np.int64)
        return self._chain(rows, np.array(counts, np.int64)), self.letters[rows], counts

    def _chain(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Forward-backward over all texts at once.

        Texts are cut into blocks of equal length. The product of a block's
        matrices carries the chain over it; what enters each block from both
        sides follows block by block, for all texts side by side, and the words
        inside all blocks at once.
        """
        k, t = self.k, np.exp(self.model.transitions)
        if not len(rows):
            return np.empty((0, k))
        blocks = -(-counts // BLOCK)
        total = int(blocks.sum())
        text = np.repeat(np.arange(len(counts)), counts)
        began = np.cumsum(counts) - counts
        inside = np.arange(len(rows)) - began[text]
        first_block = np.cumsum(blocks) - blocks
        place = (first_block[text] + inside // BLOCK) * BLOCK + inside % BLOCK
        e = np.ones((total * BLOCK, k))
        e[place] = self.table[rows]
        e = e.reshape(total, BLOCK, k)
        real = np.zeros(total * BLOCK, bool)
        real[place] = True
        real = real.reshape(total, BLOCK)
        # Products of the blocks: rows are the language before the block.
        product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for i in range(BLOCK):
            moved = (product.reshape(-1, k) @ t).reshape(total, k, k) * e[:, i][:, None, :]
            moved /= moved.max((1, 2), keepdims=True)
            product = np.where(real[:, i][:, None, None], moved, product)
        enter = np.full((total, k), 1.0 / k)
        leave = np.full((total, k), 1.0)
        # Texts by number of blocks, so that those still going stand in front.
        order = np.argsort(-blocks, kind="stable")
        many = blocks[order]
        for j in range(1, int(many[0]) if len(many) else 0):
            now = first_block[order[: np.searchsorted(-many, -j, "left")]] + j
            v = np.einsum("nk,nkl->nl", enter[now - 1], product[now - 1])
            enter[now] = v / v.sum(1, keepdims=True)
        for j in range(1, int(many[0]) if len(many) else 0):
            some = order[: np.searchsorted(-many, -j, "left")]
            now = first_block[some] + blocks[some] - 1 - j
            v = np.einsum("nkl,nl->nk", product[now + 1], leave[now + 1])
            leave[now] = v / v.sum(1, keepdims=True)
        forward = np.empty_like(e)
        v = enter
        for i in range(BLOCK):
            moved = v @ t * e[:, i]
            moved /= moved.sum(1, keepdims=True)
            v = np.where(real[:, i][:, None], moved, v)
            forward[:, i] = v
        v = leave
        for i in range(BLOCK - 1, -1, -1):
            forward[:, i] *= v
            moved = (v * e[:, i]) @ t.T
            moved /= moved.sum(1, keepdims=True)
            v = np.where(real[:, i][:, None], moved, v)
        out = forward.reshape(-1, k)[place]
        return out / out.sum(1, keepdims=True)


_LABELLERS: dict[str, _Labeller] = {}


def _labeller(sent) -> _Labeller:
    turn("language", _LABELLERS.clear)
    if sent.id not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[sent.id] = _Labeller(sent.value)
    return _LABELLERS[sent.id]


class _Sent:
    """A broadcast model with a name by which a worker knows it again."""

    def __init__(self, spark, model):
        self.id = uuid.uuid4().hex
        self._broadcast = spark.sparkContext.broadcast(model)

    @property
    def value(self):
        return self._broadcast.value


def learn(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    passages: int = PASSAGES,
    languages: int = LANGUAGES,
) -> Model:
    """Fit a model on a bounded sample of the rows that have text and ``lang``.

    At most about ``passages`` rows of each language are drawn, by a hash of
    ``doc_id``, and of each row one passage of 1,500 characters at a place that
    the hash tells. Where there are more than ``languages`` values of ``lang``, the
    most frequent ones are learned (of equally frequent ones those that sort first),
    and the model's ``left_out`` names up to 1,000 of the others, the most frequent
    first; texts in these get the likeliest learned language. Without any such row
    the model knows no language.
    """
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"),
        F.col(f"`{lang}`").cast("string").alias("l"),
    ).filter("t IS NOT NULL AND l IS NOT NULL")
    # The most frequent languages, and the names of some that are not among them.
    counted = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l")
    counted = [(r["l"], r["n"]) for r in counted.limit(languages + NAMED).collect()]
    counts, left_out = dict(counted[:languages]), tuple(name for name, _ in counted[languages:])
    if not counts:
        return _nothing()
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("l") == name, passages / n).otherwise(share)
    drawn = rows.withColumn("h", F.xxhash64("i"))
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length("t") - PASSAGE_CHARS + 1)) + 1
    passage = F.substring("t", start.cast("int"), F.lit(PASSAGE_CHARS)).alias("p")
    # The same bound for a table whose ids are all alike.
    found = drawn.select("h", "l", passage).orderBy("h", "l", "p").limit(2 * passages * len(counts))
    sample = sorted((r["l"], r["p"]) for r in found.collect())
    known = [(a, b) for a, b in sample if any(map(_core, b.lower().split()))]
    if not known:
        return _nothing(left_out)
    return replace(fit(known), left_out=left_out)


def identify(documents: DataFrame, model: Model, *, text: str = "text", spans: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score``; with ``spans`` also ``spans``.

    ``lang_pred`` is the language with the largest mean probability over the
    words that have letters, and ``score`` that mean; ties go to the language
    that sorts first. A NULL or empty text, one without letters, and any text
    under a model without languages is ``und`` with score 0. ``spans`` lists the
    runs of words of one language (``lang``, ``first``, ``stop``: places of
    words). Texts are labelled whole; rows are independent, so repeated rows
    have equal results; columns named like a result are replaced.
    """
    sent = _Sent(documents.sparkSession, model)
    names = np.array([*model.languages, UNKNOWN])

    def work(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        n, k = len(values), len(model_languages)
        if not k:
            empty = [pa.array([UNKNOWN] * n), pa.array(np.zeros(n))]
            return _struct(empty, [[] for _ in values] if spans else None)
        p, letters, counts = _labeller(sent).posteriors(values)
        text = np.repeat(np.arange(n), counts)
        sums = np.stack([np.bincount(text[letters], p[letters, c], n) for c in range(k)], 1)
        with_letters = np.bincount(text[letters], minlength=n)
        best = np.where(with_letters > 0, sums.argmax(1), k)
        score = np.where(with_letters > 0, sums.max(1) / np.maximum(with_letters, 1), 0.0)
        found = None
        if spans:
            found, at = [], 0
            for c in counts:
                label = p[at : at + c].argmax(1)
                edges = np.flatnonzero(np.diff(label, prepend=-1))
                found.append(
                    [
                        {"lang": model_languages[label[a]], "first": int(a), "stop": int(b)}
                        for a, b in zip(edges, [*edges[1:], c])
                    ]
                )
                at += c
        return _struct([pa.array(names[best].tolist()), pa.array(np.minimum(score, 1.0))], found)

    model_languages = model.languages
    schema = "lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<lang: string, first: int, stop: int>>"
    share = min(1.0, (FEW_LANGUAGES / max(len(model_languages), 1)) ** 2)
    return with_results(documents, text, work, schema, int(SLICE_BYTES * share))


def _struct(columns, spans) -> pa.Array:
    names = ["lang_pred", "score"]
    if spans is not None:
        kind = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("stop", pa.int32())])
        columns, names = [*columns, pa.array(spans, pa.list_(kind))], [*names, "spans"]
    return pa.StructArray.from_arrays(columns, names)
