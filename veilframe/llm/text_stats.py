"""Statistics of whole texts, counted on bytes and words; every one is a number without unit, so length matters only where meant."""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

STATS = ("log_words", "word_length", "long_words", "upper", "digits", "marks", "ends", "other_bytes", "space",
         "distinct_words", "same_as_before", "top_word", "capital_words", "shout_words", "mark_words", "pipe_words",
         "lines", "line_words", "repeated_lines", "letter_entropy", "repeated_pairs", "no_vowel_words", "short_words",
         "loaded_words", "digit_words")
SLICE = 4 << 20

_CLASS = np.zeros(256, np.int64)    # 0 control, 1 space, 2 lower, 3 upper, 4 digit, 5 end of sentence, 6 other mark, 7 beyond ASCII
_CLASS[[32, 9, 10, 11, 12, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 6
_CLASS[128:] = 7
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_VOWEL[128:] = True


def text_stats(text: bytes) -> np.ndarray:
    """The ``STATS`` of a text in UTF-8; all zero for a text without words. Long texts are read in slices."""
    out = np.zeros(len(STATS))
    if not text.strip():
        return out
    bytes_, flags, last, start = np.zeros(256), np.zeros(10), None, 0
    words = same = 0
    counts, pairs = Counter(), set()    # of the whole text
    while start < len(text):
        end = len(text)
        if end - start > SLICE:
            cut = text.find(b" ", start + SLICE)
            end = cut if cut >= 0 else end
        part = text[start:end]
        start = end
        a = np.frombuffer(part, np.uint8)
        bytes_ += np.bincount(a, minlength=256)
        kinds = _CLASS[a]
        gap = kinds == 1
        first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        if not len(first):
            continue
        ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
        size = ends - first

        def per_word(mask: np.ndarray, first=first, ends=ends) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[ends] - total[first]

        upper, lower = per_word(kinds == 3), per_word(kinds == 2)
        marks, digits = per_word(kinds == 6), per_word(kinds == 4)
        stops = per_word(kinds == 5)
        flags += [size.sum(), (size > 16).sum(), (kinds[first] == 3).sum(), ((upper > 1) & (lower == 0)).sum(), (marks >= 2).sum(),
                  ((size == 1) & (marks == 1)).sum(), ((per_word(_VOWEL[a]) == 0) & (lower + upper > 0)).sum(), (size <= 2).sum(),
                  (stops + marks >= 3).sum(), (digits > 0).sum()]
        tokens = part.split()
        words += len(tokens)
        counts.update(tokens)
        before = [last, *tokens[:-1]]
        same += sum(map(operator.eq, before, tokens))
        pairs.update(zip(before, tokens))
        last = tokens[-1]
    if not words:
        return out
    n = bytes_.sum()
    kinds = np.bincount(_CLASS, bytes_, 8)
    lines = [x.strip() for x in text.split(b"\n")]
    lines = [x for x in lines if x]
    letters = bytes_[97:123] + bytes_[65:91]
    share = letters[letters > 0] / max(1.0, letters.sum())
    out[:] = (np.log1p(words), flags[0] / words, flags[1] / words, kinds[3] / n, kinds[4] / n, kinds[6] / n, kinds[5] / n, kinds[7] / n,
              kinds[1] / n, len(counts) / words, same / words, max(counts.values()) / words,
              flags[2] / words, flags[3] / words, flags[4] / words, flags[5] / words, np.log1p(len(lines)), np.log1p(words / max(1, len(lines))),
              1 - len(set(lines)) / max(1, len(lines)), -(share * np.log2(share)).sum(), 1 - len(pairs) / words,
              flags[6] / words, flags[7] / words, flags[8] / words, flags[9] / words)
    return out


def stats_of(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    rows = [text_stats(x.as_py() or b"") for x in texts.cast(pa.binary())]
    return np.stack(rows) if rows else np.zeros((0, len(STATS)))


def stats_column():
    """Column function: text → array of its ``STATS``."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def stats(texts: pa.Array) -> pa.Array:
        rows = stats_of(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATS), pa.int32()), pa.array(rows.ravel()))

    return stats
