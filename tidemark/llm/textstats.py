"""Counts and statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np

#: Names of the character classes, in the order of their numbers.
CLASSES = ("lower", "upper", "other letter", "digit", "white space", "stop", "mark", "symbol", "other")
#: The characters that the contract counts as symbols.
SYMBOLS = "#*$%&|<>"
#: Common words, by language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this at from or an not have but they he she you we".split(),
    "de": "der die und das in den von zu mit ist des im für auf dem nicht ein eine als auch es an sich er wie bei aus werden".split(),
    "fr": "de la le et les des en un une du dans que est pour qui au sur par il pas ce plus avec ne se sont son à".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero sus le ha".split(),
}
LANGS = tuple(COMMON)

_SPACE = frozenset(" \t\n\r\x0b\x0c")
_STRIP = " \t\n\r\x0b\x0c"


@cache
def class_table() -> np.ndarray:
    """The class of each code point; symbols of the contract are in a class of their own."""
    import unicodedata

    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for c in range(0x30000):
        ch, kind = chr(c), unicodedata.category(chr(c))
        if ch in _SPACE:
            name = "white space"
        elif ch in SYMBOLS:
            name = "symbol"
        elif ch in ".,":
            name = "stop"
        elif kind == "Ll":
            name = "lower"
        elif kind == "Lu":
            name = "upper"
        elif kind[0] == "L":
            name = "other letter"
        elif kind == "Nd":
            name = "digit"
        elif kind[0] in "PS":
            name = "mark"
        else:
            continue
        table[c] = CLASSES.index(name)
    return table


@cache
def common_index() -> dict[bytes, list[tuple[int, int]]]:
    """For a word in lower case, with a capital or in capitals: its languages and its places in their lists."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for k, lang in enumerate(LANGS):
        for i, w in enumerate(COMMON[lang]):
            for form in {w, w.capitalize(), w.upper()}:
                out.setdefault(form.encode(), []).append((k, i))
    return out


WIDTH = max(map(len, COMMON.values())) + 1


def repeated_window_words(ids: np.ndarray, size: int = 3) -> int:
    """Words that lie in windows of size words which occur twice or more in ids."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key = first = ids.astype(np.int64)
    base = int(key.max()) + 1
    for k in range(1, size):
        if int(key.max() + 1) * base >= 2**62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key[:-1] * base + first[k : k + len(key) - 1]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(key, twice)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[size : size + n] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def lines(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, those ended by a stop, and the longest one's length."""
    seen, n, dup, ended, longest = set(), 0, 0, 0, 0
    for line in text.split("\n"):
        if not (bare := line.strip(_STRIP)):
            continue
        n += 1
        if line in seen:
            dup += 1
        seen.add(line)
        ended += bare[-1] in ".!?"
        longest = max(longest, len(bare))
    return n, dup, ended, longest


class Stats:
    """The statistics of one text."""

    __slots__ = ("classes", "common", "distinct", "dup_lines", "ended", "lines", "longest", "n_words", "repeat_words", "text", "words")

    def __init__(self, text: str) -> None:
        self.text = text
        self.classes = np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(CLASSES)) if text else np.zeros(len(CLASSES), np.int64)
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n_words = len(self.words)
        number = dict.fromkeys(self.words)
        number = dict(zip(number, range(len(number)), strict=True))
        ids = np.fromiter(map(number.__getitem__, self.words), np.int32, self.n_words)
        self.distinct = np.bincount(ids) if self.n_words else np.zeros(0, np.int64)
        self.repeat_words = repeated_window_words(ids)
        self.lines, self.dup_lines, self.ended, self.longest = lines(text)
        self.common = np.zeros((len(LANGS), WIDTH), np.int64)
        where = common_index()
        for w in number.keys() & where.keys():
            for lang, i in where[w]:
                self.common[lang, i] += self.distinct[number[w]]
        self.common[:, -1] = self.n_words - self.common[:, :-1].sum(axis=1)

    @property
    def word_chars(self) -> int:
        return int(self.classes.sum() - self.classes[CLASSES.index("white space")])

    @property
    def symbols(self) -> int:
        return int(self.classes[CLASSES.index("symbol")])

    def features(self) -> list[float]:
        """For the classifier: only the text counts, not its language, source or number."""
        n, chars = max(1, self.n_words), max(1, int(self.classes.sum()))
        share = self.classes / chars
        stops = self.common[:, :-1].sum(axis=1) / n
        p = self.distinct / n
        raw = self.text.encode("utf-8", "surrogatepass")
        bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=1) / max(1, len(raw)) if raw else np.ones(1)
        lengths = Counter(map(len, self.words))
        mean = sum(k * v for k, v in lengths.items()) / n
        return [
            math.log1p(self.n_words), math.log1p(chars), mean, math.sqrt(max(0.0, sum(k * k * v for k, v in lengths.items()) / n - mean * mean)), float(max(lengths, default=0)),
            *share.tolist(), *stops.tolist(), float(stops.max()), float(np.sort(stops)[-2]),
            len(self.distinct) / n, float(p.max(initial=0.0)), float(-(p * np.log(p)).sum()) if self.n_words else 0.0,
            self.repeat_words / n, float(self.lines), self.dup_lines / max(1, self.lines), self.ended / max(1, self.lines), self.n_words / max(1, self.lines), self.longest / chars,
            float(-(bytes_[bytes_ > 0] * np.log(bytes_[bytes_ > 0])).sum()), len(zlib.compress(raw, 1)) / max(1, len(raw)),
            self.text.count("!") / n, self.text.count("?") / n, self.text.count(".") / n, self.text.count("http") / n, sum(w.isupper() for w in self.words) / n, sum(w[:1].isupper() for w in self.words) / n,
        ]
