"""Per-document statistics of a stretch of documents, each computed once and only when asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .kernels import IS_WORD, mix, stretch_codes, window_codes, word_codes, words


def _lut(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SYMBOL, UPPER, LETTER, DIGIT, STOP, MARK = (
    _lut(x)
    for x in (
        b"#*$%&|<>",
        bytes(range(65, 91)),
        bytes([*range(65, 91), *range(97, 123)]),
        b"0123456789",
        b".?!",
        b"!",
    )
)
LEAD = np.ones(256, bool)  # bytes that begin a code point
LEAD[0x80:0xC0] = False


class Stretch:
    """Documents as one byte buffer and its offsets. Every statistic is an array with one number per document."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at, self.n = data, at, len(at) - 1

    def take(self, rows: np.ndarray) -> "Stretch":
        """Some of the documents: with the statistics that are known, and with bytes only once another one is asked for."""
        return Part(self, rows)

    def fresh(self) -> "Stretch":
        """The same documents, with their words found and nothing else."""
        out = Stretch(self.data, self.at)
        out._words = self._words
        return out

    def total(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def each(self, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weight, self.n).astype(np.int64)

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.at)

    @cached_property
    def _codes(self) -> np.ndarray:
        begin, end, _ = self._words
        return word_codes(self.data, begin, end)

    @cached_property
    def n_chars(self) -> np.ndarray:
        return self.total(LEAD[self.data])

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.each(self._words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.total(LEAD[self.data] & IS_WORD[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.total(SYMBOL[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.total(UPPER[self.data])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self.total(LETTER[self.data])

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self.total(DIGIT[self.data])

    @cached_property
    def n_stops(self) -> np.ndarray:
        return self.total(STOP[self.data])

    @cached_property
    def n_marks(self) -> np.ndarray:
        return self.total(MARK[self.data])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line that has a word."""
        cut = np.flatnonzero(self.data == 0x0A)
        full = self.at[:-1] < self.at[1:]
        start = np.sort(np.concatenate((self.at[:-1][full], cut + 1)))
        end = np.sort(np.concatenate((self.at[1:][full], cut)))
        # a break at a document's last byte opens a line that would begin the next document: keep those that do not overrun
        begin, _, _ = self._words
        has = np.searchsorted(begin, end) > np.searchsorted(begin, start)
        start, end = start[has], end[has]
        return start, end, np.searchsorted(self.at, start, "right") - 1

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.each(self._lines[2])

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        start, end, doc = self._lines
        return self.each(doc[_again(stretch_codes(self.data, start, end), doc)[0]])

    @cached_property
    def n_distinct(self) -> np.ndarray:
        doc = self._words[2]
        return self.n_words - self.each(doc[_again(self._codes, doc)[0]])

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        doc, code = self._words[2], self._codes
        return self.each(doc[1:][(code[1:] == code[:-1]) & (doc[1:] == doc[:-1])])

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        return self.repeat_words(5)

    def repeat_words(self, width: int) -> np.ndarray:
        """Words in `width`-word windows that the text has twice or more."""
        doc = self._words[2]
        if len(doc) < width:
            return np.zeros(self.n, np.int64)
        codes = window_codes(self._codes, width)
        whole = np.flatnonzero(doc[: len(codes)] == doc[width - 1 :])
        _, every = _again(codes[whole], doc[whole])
        first, delta = whole[every], np.zeros(len(doc) + 1, np.int64)
        np.add.at(delta, first, 1)
        np.add.at(delta, first + width, -1)
        return self.each(doc[np.cumsum(delta[:-1]) > 0])


class Part(Stretch):
    """Documents of a stretch by row; bytes are copied when a statistic is not known of the whole stretch."""

    def __init__(self, whole: Stretch, rows: np.ndarray) -> None:
        self.n = len(rows)
        self._whole, self._rows = whole, rows
        for name, value in list(vars(whole).items()):
            if name.startswith("n_") or name == "word_chars":
                self.__dict__[name] = value[rows]

    @cached_property
    def at(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.diff(self._whole.at)[self._rows])))

    @cached_property
    def data(self) -> np.ndarray:
        sizes = np.diff(self.at)
        return self._whole.data[np.repeat(self._whole.at[:-1][self._rows] - self.at[:-1], sizes) + np.arange(self.at[-1])]


def _again(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose (document, code) occurred before, and places whose (document, code) occurs twice or more."""
    key = mix(code + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, every = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    every[order[1:]] |= same
    every[order[:-1]] |= same
    return np.flatnonzero(later), np.flatnonzero(every)
