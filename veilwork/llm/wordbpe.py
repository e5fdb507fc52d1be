"""Word-level byte-pair encoding with a closing symbol, and exact token counts at every prefix of a word.

The vocabulary is a ``tokenizers`` JSON file whose pieces end words with ``</w>``. Merges never cross a pre-token, so
the count of a text is the sum over its pre-tokens, and the count of a prefix is that sum up to the pre-token in which
it ends plus the count of the part inside it.

Inside a pre-token the counts come from a dynamic program over prefixes. For a prefix of length ``i`` that stays open
(no closing symbol), the encoding ends in exactly one piece ``t``: the one that is compatible with the last piece of
the prefix of length ``i - len(t)``. Two pieces are compatible if encoding their concatenation gives just them. The
encoding of a prefix as a text of its own ends in a closed piece (with ``</w>``), and what stands before is again an
open prefix. Both tables take one step per byte, whatever the length.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points for which lower-casing is one to one and NFC changes nothing, and whose classes are written out below.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-įı-ňŊ-ž‐-‧‰-⁞€]*", re.S)
LETTER = "a-zªµºß-öø-ÿĀ-ž"
NUMBER = "0-9²³¹¼-¾"
SPACE = r"\t-\r\x20\x85\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
CLOSE = "</w>"
BASE = (-1, "", "")
KEEP = 1 << 18  # words held by a cache before it starts anew


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}  # piece: rank, left part, right part
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.longest = max(len(t.removesuffix(CLOSE)) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}
        self.tables = _Tables(self)
        self.ids = _Ids(self)

    # -- merges -------------------------------------------------------------------------------------------------

    def merged(self, symbols: list[str]) -> list[str]:
        """The pieces of a few symbols, by merging the lowest rank first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = min((self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i) for i in range(len(symbols) - 1))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of ``left + right`` is just these two; with an empty ``left``: of ``right``, itself.

        It goes back through the merges that made the two, the latest first, and looks at the pair that faces the border
        meanwhile: if that pair's rank comes before the merge just undone, it would have been merged across.
        """
        if not left:
            body = right.removesuffix(CLOSE)
            return self.merged([*body[:-1], body[-1] + right[len(body) :]]) == [right]
        rank, made, limit = self.rank, self.made, 1 << 60
        while True:
            found = rank.get((left, right))
            if found is not None and found < limit:
                return False
            (a, _, left_end), (b, right_start, _) = made.get(left, BASE), made.get(right, BASE)
            if a > b:
                limit, left = a, left_end
            elif b >= 0:  # of two equal merges the left one comes first
                limit, right = b + 1, right_start
            else:
                return True

    def fit(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 4 * KEEP:
                self.fits.clear()
            self.fits[left, right] = known = self.compatible(left, right)
        return known

    def _bytes_of(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])

    def _open(self, s: str) -> tuple[list[str], list[int]]:
        """For each open prefix: its last piece and its count. The last byte alone is never the end of an open prefix that is needed."""
        n, vocab, fit, longest = len(s), self.vocab, self.fit, self.longest
        last, count = [""] * n, [0] * n
        for i in range(1, n):
            for start in range(max(0, i - longest), i):
                piece = s[start:i]
                if piece in vocab and (not start or last[start]) and fit(last[start], piece):
                    last[i], count[i] = piece, count[start] + 1
                    break
        return last, count

    def _closed(self, s: str, i: int, last: list[str], count: list[int]) -> int:
        """The count of the prefix of length ``i`` as a text of its own."""
        for start in range(max(0, i - self.longest), i):
            piece = s[start:i] + CLOSE
            if piece in self.vocab and (not start or last[start]) and self.fit(last[start], piece):
                return count[start] + 1
        raise ValueError(f"no piece ends {s[:i]!r}")

    def word_count(self, word: str) -> int:
        s = self._bytes_of(word)
        return self._closed(s, len(s), *self._open(s))

    def prefix_table(self, word: str) -> np.ndarray:
        """Token counts of every code-point prefix of a pre-token, each as a text of its own; entry 0 is 0."""
        s = self._bytes_of(word)
        last, count = self._open(s)
        out, end = [0], 0
        for c in word:
            end += len(c.encode("utf-8", "surrogatepass"))
            out.append(self._closed(s, end, last, count))
        return np.array(out, np.int32)

    # -- texts --------------------------------------------------------------------------------------------------

    def plain_words(self, text: str) -> list[str] | None:
        """Pre-tokens of a text of plain code points without special strings; None for another."""
        if PLAIN.fullmatch(text) is None or self.special_cut and self.special_cut.search(text):
            return None
        return WORD.findall(text.lower())

    def count(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_each(texts))

    def encode_each(self, texts: list[str]):
        """Ids of each text in turn."""
        ids = self.ids.__getitem__
        for text in texts:
            words = self.plain_words(text)
            if words is None:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(ids, words))


class _Tables(dict):
    """Prefix tables of words, each built when first asked for."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= KEEP:
            self.clear()
        self[word] = table = self.bpe.prefix_table(word)
        return table


class _Ids(dict):
    """Ids of words. When it is full it becomes the older half, from which words that come up again are taken."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.model, self.old = bpe, bpe.library.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 2 * KEEP:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(self.bpe._bytes_of(word))], "<u4").tobytes()
        self[word] = found
        return found


class _Totals(dict):
    """Token counts of whole words: the last entry of their prefix tables."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> int:
        if len(self) >= 2 * KEEP:
            self.clear()
        self[word] = n = self.bpe.word_count(word)
        return n


class PrefixCounts:
    """Exact token counts at the prefixes of one text.

    ``counts()[i]`` is the number of tokens of the first ``i`` code points. For text that NFC or lower-casing changes in
    length, prefixes are those of the normalised text (``normalised`` is then True). ``total`` is the count of the whole.
    """

    def __init__(self, bpe: WordBpe, text: str):
        self.bpe, self.normalised = bpe, False
        words = bpe.plain_words(text)
        if words is not None:
            self.text, self.length, self.special = text, len(text), None
            self._words = words
            totals = totals_of(bpe)
            self._sums = list(map(totals.__getitem__, words))
            self.total = sum(self._sums)
            return
        # segments between special strings: (start, pre-token or None for a special string)
        self._words, self._starts, self._sums, at = [], [], [], 0
        library, self.special = bpe.library, set()
        joined = []
        for part in bpe.special_cut.split(text) if bpe.special_cut else [text]:
            if part in bpe.special:
                self.special.add(len(self._words))
                self._starts.append(at)
                self._words.append(part)
                self._sums.append(1)
            elif part:
                whole = library.normalizer.normalize_str(part)
                self.normalised |= len(whole) != len(part) or whole != part.lower()
                for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(whole):
                    self._starts.append(at + a)
                    self._words.append(whole[a:b])
                    self._sums.append(totals_of(bpe)[whole[a:b]])
                part = whole
            joined.append(part)
            at += len(part)
        self.text, self.length, self.total = "".join(joined), at, sum(self._sums)

    def _at(self) -> list[int]:
        if self.special is None:
            return [m.start() for m in WORD.finditer(self.text.lower())]
        return self._starts

    def _inside(self, k: int) -> np.ndarray:
        """The table of the k-th pre-token; a special string counts as ordinary text until it is complete."""
        word = self._words[k]
        if self.special is not None and k in self.special:
            joined = k and k - 1 not in self.special and self._starts[k - 1] + len(self._words[k - 1]) == self._starts[k]
            before = self._words[k - 1] if joined else ""
            less = self._sums[k - 1] if joined else 0
            return np.array([PrefixCounts(self.bpe, before + word[:j]).total - less for j in range(len(word))] + [1], np.int32)
        return self.bpe.tables[word]

    def counts(self) -> np.ndarray:
        out, before, end = np.zeros(self.length + 1, np.int32), 0, 0
        for k, start in enumerate(self._at()):
            out[end + 1 : start + 1] = before
            table = self._inside(k)
            out[start + 1 : (end := start + len(table) - 1) + 1] = before + table[1:]
            before += self._sums[k]
        out[end + 1 :] = before
        return out

    def longest_within(self, budget: int) -> int:
        """The most code points of a prefix of at most ``budget`` tokens: where to truncate."""
        if self.total <= budget:
            return self.length
        sums = np.cumsum(self._sums)
        k = int(np.searchsorted(sums, budget, side="right"))  # the first pre-token whose end is over the budget
        starts, best = self._at(), 0
        before = int(sums[k - 1]) if k else 0
        best = starts[k]
        while k < len(starts):  # a part of a pre-token may take more tokens than a longer one, so all of it is looked at
            inside = np.flatnonzero(before + self._inside(k) <= budget)
            best = max(best, starts[k] + int(inside[-1]))
            before += self._sums[k]
            k += 1
            if before > budget:
                break
        return best


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One instance in each Python process."""
    return WordBpe(path)


@lru_cache(maxsize=4)
def totals_of(bpe: WordBpe) -> _Totals:
    return _Totals(bpe)
