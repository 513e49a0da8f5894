"""Quality rules: a decision list learned from labelled statistics.

Each text gets a row of statistics. Sequential covering learns, from rows with
a quality label, an ordered list of rules that reject: a rule is a conjunction
of thresholds, grown for the largest information gain on two thirds of the rows
and pruned on the rest. The list is an ordered Spark expression, one WHEN for
each rule, which can be read and edited.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import turn, with_results

# Labelled rows that rules are learned from at most.
LABELLED = 20_000
# Thresholds tried for a statistic, conditions of a rule, rules of a list.
THRESHOLDS = 48
CONDITIONS = 4
RULES = 20
# A rule must be right this often on rows it was not grown on, and reject as many.
PRECISION = 0.9
LEAST_ROWS = 4

COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_upper bigint, n_letters bigint, "
    "n_digits bigint, n_distinct bigint"
)
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = [9, 10, 11, 12, 13, 32]


def _repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three which occurs at least twice."""
    n = len(codes)
    if n < 4:
        return 0
    pair = codes[:-1] * distinct + codes[1:]
    if distinct >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    windows = pair[:-1] * distinct + codes[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def text_counts(data: bytes) -> tuple[int, ...]:
    """The counts of one text in UTF-8, in the order of ``COUNTS``."""
    words = data.split()
    n = len(words)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(histogram[0x80:0xC0].sum())
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = int(histogram[65:91].sum())
    return (
        n,
        points - int(histogram[_SPACE].sum()),
        int(histogram[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        _repeated_words(codes, len(known)),
        len(lines),
        upper,
        upper + int(histogram[97:123].sum()),
        int(histogram[48:58].sum()),
        len(known),
    )


def with_counts(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the counts of every whole text: words (runs without ASCII white
    space), their code points, symbols, repeated lines that have a word, words
    in repeated windows of three, lines with a word, ASCII capitals and letters,
    digits, and distinct words. All are 0 for a NULL or empty text. Rows are
    independent; columns named like a count are replaced."""

    def work(texts: pa.Array) -> pa.Array:
        turn("quality", lambda: None)
        rows = [text_counts(t.as_buffer().to_pybytes()) if t.is_valid else (0,) * 10 for t in texts]
        columns = np.array(rows, np.int64).reshape(-1, 10).T
        return pa.StructArray.from_arrays(
            [pa.array(c) for c in columns], [p.split()[0] for p in COUNTS.split(", ")]
        )

    return with_results(documents, text, work, COUNTS)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def statistics() -> dict[str, Column]:
    """What rules may test, as expressions over the counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_word_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "n_letters"),
        "digits_per_word": _share("n_digits", "n_words"),
        "distinct_share": _share("n_distinct", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions ``(statistic, is_at_least, threshold)``, all of which hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        found = np.ones(len(next(iter(rows.values()))), bool)
        for name, at_least, edge in self.conditions:
            found &= rows[name] >= edge if at_least else rows[name] <= edge
        return found

    def column(self) -> Column:
        found = F.lit(True)
        for name, at_least, edge in self.conditions:
            value = statistics()[name]
            found = found & (value >= edge if at_least else value <= edge)
        return found

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<='} {t:g}" for n, a, t in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0


def _grown(rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule, inside = Rule(()), np.ones(len(bad), bool)
    while len(rule.conditions) < CONDITIONS and (~bad[inside]).any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best = (1e-9, None)
        for name, values in rows.items():
            own = values[inside]
            for edge in np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS), method="nearest")):
                for at_least in (True, False):
                    hit = own >= edge if at_least else own <= edge
                    p = int(bad[inside][hit].sum())
                    gain = _gain(p, int(hit.sum()) - p, p0, n0)
                    if gain > best[0]:
                        best = gain, (name, at_least, float(edge))
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        inside = rule.covers(rows)
    return rule


def _pruned(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> tuple[float, int]:
        hit = r.covers(rows)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        return ((p - n) / (p + n) if p + n else -1.0), -len(r.conditions)

    shorter = [Rule(rule.conditions[:i]) for i in range(1, len(rule.conditions) + 1)]
    return max(shorter, key=worth)


def fit(rows: dict[str, np.ndarray], quality: np.ndarray) -> list[Rule]:
    """Rules that reject rows of quality 0, most reliable first as learned.

    Every third row is kept for pruning. A list ends when a rule is right on
    less than 90 % of the pruning rows or rejects fewer than four rows.
    """
    bad = quality == 0
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < RULES and bad[left & ~held].any():
        grow, prune = left & ~held, left & held
        rule = _grown({n: v[grow] for n, v in rows.items()}, bad[grow])
        if not rule.conditions:
            break
        rule = _pruned(rule, {n: v[prune] for n, v in rows.items()}, bad[prune])
        hit = rule.covers(rows) & left
        new = hit & held
        right = bad[new].mean() if new.any() else bad[hit].mean()
        if hit.sum() < LEAST_ROWS or right < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(
    documents: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    labelled: int = LABELLED,
) -> list[Rule]:
    """Rules from at most ``labelled`` labelled rows, drawn by a hash of
    ``doc_id``. Rows without label or document take no part, of several labels
    of one id the lowest counts; without rejected rows the list is empty."""
    drawn = (
        labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y"))
        .filter("i IS NOT NULL AND y IN (0, 1)")
        .groupBy("i")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(labelled)
    )
    texts = documents.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    # The drawn rows are bounded by the parameter, so they may be broadcast.
    found = with_counts(texts.join(F.broadcast(drawn), "i"), text="t")
    names = statistics()
    rows = found.select("i", "y", *[c.alias(n) for n, c in names.items()]).orderBy(
        F.xxhash64("i"), "i", "n_words"
    )
    table = rows.limit(labelled).toPandas()
    if not len(table):
        return []
    return fit({n: table[n].to_numpy() for n in names}, table["y"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The list as an expression over the counts: false where a rule rejects."""
    if not rules:
        return F.lit(True)
    listed = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        listed = listed.when(rule.column(), F.lit(False))
    return listed.otherwise(F.lit(True))
