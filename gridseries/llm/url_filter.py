"""Verdicts on URLs: rules for hosts and paths, else a logistic regression.

The regression works on hashed character n-grams of host and path and is
trained from a small table of labelled URLs.
"""

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import fresh, with_results

# Labelled URLs that are trained on at most.
LABELLED = 10_000
TABLE = 1 << 16
GRAMS = (4, 5, 6)

# The table of labelled URLs is made by rule: beginnings of host names to block and
# to allow, each with every ending of its kind.
BLOCKED = (
    "gambl wager roulette blackjack baccarat jackpot lotto slot poker bookie bingo "
    "viagra cialis tramadol steroid tablet dosage porn erotic nude sexy escort hookup "
    "webcam fetish advert popup banner clickbait affiliate redirect warez keygen crack "
    "torrent phish malware spyware trojan payday loan credit riches prize gift bonus "
    "promo discount replica bitcoin forex"
).split()
BLOCKED_ENDINGS = " s -online -24 247 -best -club -deals -now -zone -shop s4u -vip".split(" ")
ALLOWED = (
    "news weather library museum school university research science history culture "
    "cooking recipe garden travel music film sport health medicine docs developer "
    "manual forum community blog encyclopedia dictionary maps council parliament court "
    "statistics astronomy biology chemistry physics math language river mountain forest "
    "harbor bridge station market kitchen window painter writer teacher doctor engineer "
    "farmer sailor baker nurse theatre orchestra festival workshop lecture winter summer "
    "anderson martin thomson rivera moreno fischer schneider dubois laurent"
).split()
ALLOWED_ENDINGS = " s -guide -archive -city -notes -review -society -today 2020 -project".split(" ")
SHAPES = (
    "https://www.{}.example.com/en/1",
    "http://{}.example.net/de/22.html",
    "http://pages.example.net/{}",
    "https://m.{}.example.org/fr/305/",
)


def labelled_urls(
    blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED
) -> list[tuple[str, int]]:
    """URLs with label 1 where they are to be blocked."""
    words = [(w + e, 1) for w in blocked for e in BLOCKED_ENDINGS]
    words += [(w + e, 0) for w in allowed for e in ALLOWED_ENDINGS]
    return [(shape.format(w), label) for w, label in words for shape in SHAPES]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(url: str) -> tuple[str, str]:
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    if not found:
        return "", ""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]


def matching_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as ``struct<verdict, rule>``; NULL if none does.

    ``rules`` are pairs of a verdict and ``host/path``; a rule fits its host and
    all subdomains of it if the path starts with the rule's. Of equal rules the
    first counts. Meant for few rules; :func:`with_rules` joins any number.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    none = F.lit(None).cast("struct<verdict: string, rule: string>")
    return none if found is None else found


def with_rules(pages: DataFrame, rules: DataFrame, match: str) -> DataFrame:
    """Add the longest rule that fits ``host`` and ``path``, as a column ``match``.

    ``rules`` has ``verdict`` and ``rule``; of equal rules the least verdict counts.
    Distinct hosts and paths are listed under the ends of their host, as many as
    the rules have labels at most, and meet the rules by that and by beginnings of
    the path of those lengths that the rules of the domain have. Both are equal
    joins, so neither the number of rules nor that of pages of one host multiplies.
    """
    slash = F.instr("rule", "/")
    table = rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    table = table.select(
        "rule",
        "verdict",
        F.when(slash > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")).alias("_domain"),
        F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("_start"),
    )
    lengths = table.groupBy("_domain").agg(F.collect_set(F.char_length("_start")).alias("_lengths"))
    deepest = table.agg(F.coalesce(F.max(F.size(F.split("_domain", r"\."))), F.lit(1)).alias("n")).scalar()
    asked = pages.select("host", "path").distinct().withColumn("_labels", F.split("host", r"\."))
    first = F.greatest(F.lit(1), F.size("_labels") - deepest + 1)
    ends = asked.withColumn("_i", F.explode(F.sequence(first, F.size("_labels"))))
    ends = ends.select("host", "path", F.expr("array_join(slice(_labels, _i, size(_labels)), '.')").alias("_domain"))
    tried = ends.join(lengths, "_domain").select(
        "host", "path", "_domain", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("path"))).alias("_n")
    )
    tried = tried.withColumn("_start", F.expr("substring(path, 1, _n)"))
    best = tried.join(table, ["_domain", "_start"]).groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("rule").alias("n"), "rule", "verdict")).alias("_best")
    )
    found = F.when(F.col("_best").isNotNull(), F.struct("_best.verdict", "_best.rule"))
    return pages.join(best.select("host", "path", found.alias(match)), ["host", "path"], "left")


@dataclass(frozen=True)
class Model:
    """Weights of the hashed n-grams, and how telling each one is: 0 for those
    that the labelled URLs do not have, little for those that most of them have."""

    weights: np.ndarray
    telling: np.ndarray
    bias: float

    def log_odds(self, texts: list[str]) -> np.ndarray:
        feature, owner = _features(texts)
        value = self.telling[feature]
        size = np.sqrt(np.bincount(owner, value**2, len(texts)) + 1)
        return self.bias + np.bincount(owner, self.weights[feature] * value, len(texts)) / size


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (as bytes) of each text, and their number."""
    data = np.frombuffer("".join([f"\x02{t}\x03" for t in texts]).encode(), np.uint8)
    sizes = np.array([len(t.encode()) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    values = data.astype(np.uint64) + np.uint64(1)
    hashed, owners, gram = [], [], values
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * np.uint64(257) + values[n - 1 :]
        if n in GRAMS:
            same = owner[: len(gram)] == owner[n - 1 :]
            hashed.append((gram[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
            owners.append(owner[: len(gram)][same])
    return np.concatenate(hashed).astype(np.int64), np.concatenate(owners)


def fit(
    urls: Sequence[tuple[str, int]], *, share: float = 1 / 3, rounds: int = 300, penalty: float = 1e-4
) -> Model:
    """Train on labelled URLs, at most 10,000, by gradient steps.

    ``share`` is the part of all URLs that is to be blocked, as expected where the
    model is used; the labelled table may have another, which the bias makes up for.
    """
    if len(urls) > LABELLED:
        raise ValueError(f"more than {LABELLED} labelled URLs")
    if not urls:
        return Model(np.zeros(TABLE), np.zeros(TABLE), 0.0)
    texts = [host + path for host, path in (_parts(u) for u, _ in urls)]
    y = np.array([label for _, label in urls], float)
    feature, owner = _features(texts)
    pairs = np.unique(np.stack([feature, owner]), axis=1)
    times = np.bincount(pairs[0], minlength=TABLE)
    telling = np.where(times > 0, np.log((len(y) + 1) / np.maximum(times, 1)), 0.0)
    value = telling[feature]
    scale = value / np.sqrt(np.bincount(owner, value**2, len(y)) + 1)[owner]
    w, bias = np.zeros(TABLE), 0.0
    for _ in range(rounds):
        z = bias + np.bincount(owner, w[feature] * scale, len(y))
        slope = (1 / (1 + np.exp(-z)) - y) / len(y)
        w -= 20.0 * (np.bincount(feature, slope[owner] * scale, TABLE) + penalty * w)
        bias -= 2.0 * slope.sum()
    shift = 0.0
    if 0 < y.mean() < 1:
        shift = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(w, telling, float(bias + shift))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] | DataFrame,
    model: Model,
    *,
    url: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``probability`` and ``verdict``.

    The longest rule that fits decides; without one, ``block`` if the model's
    probability is at least ``threshold``, else ``allow``. ``rules`` are few pairs
    of verdict and rule, which become one expression, or a table of any size with
    ``verdict`` and ``rule``, which is joined. A NULL url or one
    without ``://`` has empty host and path; like any empty text it has the
    probability of the model's bias. Rows are independent; columns named like a
    result are replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    link = F.col(f"`{url}`").cast("string")

    def work(texts: pa.Array) -> pa.Array:
        p = 1 / (1 + np.exp(-sent.value.log_odds(texts.to_pylist())))
        return pa.StructArray.from_arrays([pa.array(p)], ["probability"])

    joined, match = fresh(pages, "_joined"), fresh(pages, "_match")
    names = ("host", "path", "rule", "probability", "verdict")
    host, path = host_of(link), path_of(link)
    parted = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names],
        host.alias("host"),
        path.alias("path"),
        F.concat(host, path).alias(joined),
    )
    scored = with_results(parted, joined, work, "probability double")
    if isinstance(rules, DataFrame):
        columns = scored.columns
        scored = with_rules(scored, rules, match).select(*[F.col(f"`{c}`") for c in columns], match)
    else:
        scored = scored.withColumn(match, matching_rule(rules, F.col("host"), F.col("path")))
    learned = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.withColumns(
        {"rule": F.col(match)["rule"], "verdict": F.coalesce(F.col(match)["verdict"], learned)}
    ).drop(joined, match)
