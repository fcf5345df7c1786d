"""Small helpers that run inside tasks: memoised word hashes and word-wise encoding."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import SparkSession
from tokenizers import Encoding

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Texts go to Python workers in Arrow batches of at most ``most`` bytes from now on, if the session allows more."""
    now = (spark.conf.get(_BATCH_BYTES, None) or "").rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
        spark.conf.set(_BATCH_BYTES, str(most))


class Memo(dict):
    """Values of ``compute(key)``, of which the last ``limit`` to twice as many keys met are remembered."""

    def __init__(self, compute, limit: int = 40_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class WordHashes(Memo):
    """word -> 64-bit hash."""

    def __init__(self, limit: int = 40_000):
        super().__init__(lambda word: xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")), limit)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    return h


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text gives one run of all its words, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + mix(hashes[j : n - k + 1 + j])
    return mix(out)


class WordEncoder:
    """Token ids of whole texts. For a tokenizer whose own description says that it lower-cases, drops white space and
    cuts byte-level BPE words at letter runs, texts are encoded word by word with a bounded memory, which gives the same
    ids; any other tokenizer encodes each text at once.

    Words are cut at plain white space only, which no token of such a tokenizer crosses. Where ``lower_cased`` allows,
    the text is lower-cased before it is cut, so that a word is remembered once for all its spellings. A word of Latin
    letters and trailing punctuation is two runs to the tokenizer; its letters go to the library's BPE model directly.
    All other words go through the whole tokenizer, as do texts that hold a special token's string in any case.
    """

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_at_white_space(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.letters, self.tails = Memo(self._word, limit), Memo(self._letters, limit), Memo(self._whole, limit // 8)
        self.byte_chars = _byte_chars()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, core: str) -> bytes:
        chars = core if core.isascii() else core.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if not (core and core.isalpha() and (core.isascii() or max(core) < "\u0100")):
            return self._whole(word)
        found = self.letters[core.lower()]
        return found if len(core) == len(word) else found + self.tails[word[len(core) :]]

    def ids(self, text: str) -> bytes:
        """Token ids of one text as little-endian unsigned 32-bit values."""
        if not self.by_word:
            return self._whole(text)
        low = lower_cased(text)
        if low is None:
            low = text
        if any(s in text or s in low for s in self.special):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, _cut(low)))


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer's file: a worker's later tasks go on with the words it has met."""
    return _word_encoder(path, os.stat(path).st_mtime_ns)


@lru_cache(maxsize=1)
def _word_encoder(path: str, changed: int) -> WordEncoder:
    return WordEncoder(path)


class SpanEncoder:
    """Character spans of the tokens of whole texts.

    A tokenizer as ``cuts_at_white_space`` describes spends a sixth of its time on normalising. Latin and Cyrillic
    characters without combining marks are as NFC wants them, and white space is dropped later anyway, so that only
    lower-casing is left of it: such a text is lower-cased first and encoded without the tokenizer's normalizer. As no
    token of it crosses white space, its words can also be encoded one by one, with ``WordEncoder``'s memory of them. A
    text with any other character, a special token's beginning, or a character whose lower case is two, is left to the
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = self.plain = Tokenizer.from_file(path)
        described = json.loads(self.full.to_str())
        self.folds = cuts_at_white_space(described)
        self.special = [t.content.lower() for t in self.full.get_added_tokens_decoder().values()]
        if self.folds:
            self.plain = Tokenizer.from_str(json.dumps(described | {"normalizer": None}))
            self.known = word_encoder(path).words

    def _plain(self, text: str) -> str | None:
        """A text as the plain way takes it, in lower case; None if it must be left to the tokenizer."""
        low = lower_cased(text) if self.folds else None
        return None if low is None or any(s in low for s in self.special) else low

    def encoded(self, text: str) -> tuple[Encoding, bool]:
        """A text's encoding, and whether it took the plain way, on which tokens stand in the order of their places."""
        low = self._plain(text)
        return (self.full if low is None else self.plain).encode(text if low is None else low, add_special_tokens=False), low is not None

    def words(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """The parts of a text between white space, their lengths and their numbers of tokens, each counted when it was
        first met; None if the text must be encoded as a whole."""
        low = self._plain(text)
        if low is None:
            return None
        words = _cut(low)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return words, lengths, np.fromiter(map(len, map(self.known.__getitem__, words)), dtype=np.int64, count=len(words)) // 4

    def word_spans(self, word: str) -> list[tuple[int, int]]:
        """Spans within a part that ``words`` gave."""
        return self.plain.encode(word, add_special_tokens=False).offsets

    def of(self, text: str) -> np.ndarray:
        return all_spans(self.encoded(text)[0])


def span_encoder(path: str) -> SpanEncoder:
    """The encoder of this process for a tokenizer's file, as ``word_encoder``."""
    return _span_encoder(path, os.stat(path).st_mtime_ns)


@lru_cache(maxsize=1)
def _span_encoder(path: str, changed: int) -> SpanEncoder:
    return SpanEncoder(path)


def all_spans(encoding: Encoding) -> np.ndarray:
    spans = encoding.offsets
    return np.fromiter(chain.from_iterable(spans), dtype=np.int64, count=2 * len(spans)).reshape(-1, 2)


_UNUSUAL = re.compile("[^\x00-\u02ff\u0400-\u0482\u048a-\u052f]")


def lower_cased(text: str) -> str | None:
    """A text of Latin and Cyrillic characters without combining marks in lower case, as NFC and ``Lowercase`` leave it;
    None for a text with any other character, or with one whose lower case is two."""
    if not text.isascii() and _UNUSUAL.search(text):
        return None
    low = text.lower()
    return low if len(low) == len(text) else None


def cuts_at_white_space(tokenizer: dict) -> bool:
    """Whether a tokenizer's JSON says that its tokens never cross white space, letter runs stand alone, and case is lost."""
    steps = lambda part, name: part.get(name, [part]) if part else []
    normal = steps(tokenizer.get("normalizer"), "normalizers")
    split = steps(tokenizer.get("pre_tokenizer"), "pretokenizers")
    model = tokenizer["model"]
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [p["type"] for p in split] == ["Split", "ByteLevel"]
        and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": _WORD_RUNS}, "Removed", True)
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and (model["type"], model["dropout"], model["continuing_subword_prefix"]) == ("BPE", None, None)
    )


_WORD_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the split of the vocabulary's authors
_TAIL = ".,;:!?\"()[]{}%$#&*|-_/\\<>=+"


def _cut(text: str) -> list[str]:
    """A text's parts between single plain white space characters; empty ones among them."""
    return text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1,
    else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}
