"""Byte-pair encoding with word ends, cut at byte pairs no token contains.

A merge joins two neighbouring symbols into a token of the vocabulary, so where
a pair of bytes occurs inside no token, no merge ever crosses it: the place is a
certain cut. Each word is split at its certain cuts, the fragments are encoded
one by one and the identifiers are put together. A worker remembers words and
pieces of words it has met.
"""

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm._columns import fresh, turn, with_results

# Words and pieces that a worker remembers; of words, as many older ones too.
REMEMBERED = 200_000
# Largest vocabulary file that is sent to the executors.
LARGEST_FILE = 64 << 20

# What the vocabulary file must say for the rules below to hold.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same pattern for lower-case words of ASCII characters.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
# Words of these characters are in composed form, and Python lowers and splits
# them as the tokenizer does.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
LATIN_SPLIT = regex.compile(SPLIT)
WORD_END = "</w>"


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in a vocabulary: printable
    Latin-1 bytes are themselves, the others follow one another from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Encodes texts as the vocabulary file asks; see the module's description.

    ``special=False`` takes the texts of special tokens as ordinary text.
    """

    def __init__(self, content: bytes, special: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.loads(content)
        model, normalizer = spec["model"], spec["normalizer"] or {}
        kinds = [n["type"] for n in normalizer.get("normalizers", [normalizer])]
        splits = [
            p["pattern"]["Regex"]
            for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
            if p["type"] == "Split"
        ]
        if (
            kinds != NORMALIZERS
            or splits != [SPLIT]
            or model["end_of_word_suffix"] != WORD_END
            or spec["decoder"] is not None
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
                   for t in spec["added_tokens"])
        ):
            raise ValueError("the vocabulary file asks for rules that are not supported")
        library = Tokenizer.from_str(content.decode())
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary = model["vocab"]
        self.tokens = {i: t for t, i in self.vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        rules = {"vocab": self.vocabulary, "merges": merges, "cache_capacity": 0}
        # For the last fragment of a piece, and for the fragments before it.
        self._closing = BPE(**rules, end_of_word_suffix=WORD_END)
        self._inner = BPE(**rules)
        inside = {
            pair
            for token in self.vocabulary
            for body in [token.removesuffix(WORD_END)]
            for pair in zip(body, body[1:])
        }
        self.inside = {a + b for a, b in inside}
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        self._special = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if special and self.special
            else None
        )
        self._pieces: dict[str, tuple[int, ...]] = {}
        # Words met lately, and those met before them.
        self._words: dict[str, tuple[int, bytes, bytes]] = {}
        self._old: dict[str, tuple[int, bytes, bytes]] = {}

    def cuts(self, piece: str) -> list[int]:
        """Places in a piece that no merge can cross."""
        inside = self.inside
        return [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inside]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Identifiers of one piece, whose characters stand for bytes."""
        found = self._pieces.get(piece)
        if found is None:
            bounds = [0, *self.cuts(piece), len(piece)]
            ids = []
            for a, b in zip(bounds, bounds[1:]):
                model = self._closing if b == len(piece) else self._inner
                ids += [t.id for t in model.tokenize(piece[a:b])]
            found = tuple(ids)
            if len(piece) < 64:
                if len(self._pieces) >= REMEMBERED:
                    self._pieces.clear()
                self._pieces[piece] = found
        return found

    def word(self, word: str) -> list[int]:
        """Identifiers of a word: a run without ASCII white space."""
        out: list[int] = []
        for part in self._special.split(word) if self._special and "<|" in word else [word]:
            if self._special and part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                for piece in ASCII_SPLIT.findall(part.lower()):
                    out += self._piece(piece if piece.isprintable() else piece.translate(self.letters))
            elif LATIN.fullmatch(part):
                for piece in LATIN_SPLIT.findall(part.lower()):
                    shown = piece if piece.isascii() else piece.encode().decode("latin-1")
                    out += self._piece(shown.translate(self.letters))
            elif part:
                for piece, _ in self._split(self._normalize(part)):
                    out += self._piece(piece)
        return out

    def _remember(self, word: str) -> tuple[int, bytes, bytes]:
        found = self._words.get(word) or self._old.get(word)
        ids = self.word(word) if found is None else ()
        found = found or (
            len(ids),
            array("i", ids).tobytes(),
            " ".join([self.tokens[i] for i in ids]).encode(),
        )
        if len(word) < 64:
            if len(self._words) >= REMEMBERED:
                self._old, self._words = self._words, {}
            self._words[word] = found
        return found

    def text(self, text: str) -> tuple[int, bytes, bytes]:
        """Token count, identifiers as 32-bit numbers, and decoded text in UTF-8."""
        words = _ascii_words(text)
        found = list(map(self._words.get, words))
        if None in found:
            found = [f or self._remember(w) for f, w in zip(found, words)]
        counts, ids, decoded = zip(*found) if found else ((), (), ())
        return sum(counts), b"".join(ids), b" ".join(filter(None, decoded))

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _ascii_words(text: str) -> list[str]:
    """Runs without the white space of ASCII: space and U+0009 to U+000D."""
    if text.isascii() and not _SEPARATORS.search(text):
        return text.split()
    return _WHITE.split(text.strip(" \t\n\r\x0b\x0c")) if text.strip(" \t\n\r\x0b\x0c") else []


# str.split() also splits at these.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[ \t\n\r\x0b\x0c]+")
_ENCODERS: dict[tuple[bytes, bool], WordEncoder] = {}


def encoder_of(content: bytes, special: bool = True) -> WordEncoder:
    """One encoder a worker process for each vocabulary."""
    turn("bpe", _ENCODERS.clear)
    key = hashlib.sha256(content).digest(), special
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(content, special)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's content; it must be small enough to be sent out."""
    with open(path, "rb") as file:
        content = file.read(LARGEST_FILE + 1)
    if len(content) > LARGEST_FILE:
        raise ValueError(f"the vocabulary file is larger than {LARGEST_FILE} bytes")
    return content


def encode_texts(
    documents: DataFrame, vocabulary: str, *, text: str = "text", special: bool = True
) -> DataFrame:
    """Add ``ids`` (array of int), ``n_tokens`` (long) and ``decoded`` (string).

    ``vocabulary`` is the path of a tokenizer file on the driver; its content is
    broadcast (64 MB at most). A NULL or empty text has no tokens and decodes to
    the empty text. Texts of any length are encoded whole. Every row is encoded
    by itself: repeated rows stay repeated, an empty table stays empty, and
    columns named like a result are replaced by it.
    """
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(sent.value, special)
        rows = [encoder.text(t) if t else (0, b"", b"") for t in texts.to_pylist()]
        counts, ids, decoded = zip(*rows) if rows else ((), (), ())
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), np.int32))
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(ends), values),
                pa.array(counts, pa.int64()),
                pa.array(decoded, pa.binary()).cast(pa.string()),
            ],
            ["ids", "n_tokens", "decoded"],
        )

    return with_results(documents, text, encode, "ids array<int>, n_tokens bigint, decoded string")


def decode_ids(documents: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the tokens of ``ids`` with a blank between them.

    NULL and empty lists decode to the empty text.
    """
    sent = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def decode(lists: pa.Array) -> pa.Array:
        encoder = encoder_of(sent.value)
        return pa.StructArray.from_arrays(
            [pa.array([encoder.decode(map(int, x.split())) if x else "" for x in lists.to_pylist()])],
            ["decoded"],
        )

    joined = fresh(documents, "_joined")
    flat = documents.withColumn(joined, F.array_join(F.col(f"`{ids}`").cast("array<string>"), " "))
    return with_results(flat, joined, decode, "decoded string").drop(joined)
