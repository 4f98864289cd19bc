"""Quality rules from suffix arrays: how much of a text repeats within it, and how long its longest repeat is.

A suffix array over the words of each text is built by prefix doubling, many texts at a time (a word counts as
another one in every text, so nothing repeats across texts). Neighbours in the array and their longest common
prefixes give the LCP intervals; the deepest interval of a suffix is the longest repeated string that starts there, and
the union of these spans is what the maximal repeated strings cover.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabsmith.llm.common import flat, in_batches, raw, slices, sums

#: Shortest repeat that counts, in words, and what a kept text may have of them.
LEAST_WORDS = 6
MOST_COVERED = 0.35
MOST_LONGEST = 150
#: Symbols that mark poor text.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
#: First bytes of the characters of words.
_LETTER = np.ones(256, np.uint8)
_LETTER[list(SPACES)] = 0
_LETTER[0x80:0xC0] = 0


def longest_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word position: words of the longest string that starts there and is found again in the same text.

    `words` are the numbers of the words of all texts, one text after another; `sizes` are the texts' lengths in words.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # A group's rank is the place of its first suffix in the array, so that ranks only ever split.
    _, inverse, times = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - times)[inverse]
    levels = [rank]
    active = np.flatnonzero(times[inverse] > 1)
    step = 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        first = rank[active]
        place = np.arange(len(active))
        new_old = np.append(True, first[1:] != first[:-1])
        new = new_old | np.append(True, second[1:] != second[:-1])
        old_start = np.maximum.accumulate(np.where(new_old, place, 0))
        start = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[active] = first + start - old_start
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        if len(active):
            levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = left + common, right + common
        inside = (i < ends[left]) & (j < ends[right])
        same = inside & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])
        common += same.astype(np.int64) << level
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Whether each position lies in a span [i, i + lengths[i])."""
    reach = np.arange(len(lengths)) + lengths
    return np.maximum.accumulate(reach) > np.arange(len(lengths))


def repetition(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    most_covered: float = MOST_COVERED,
    most_longest: int = MOST_LONGEST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`, `kept`, `repeat_fraction`, `longest_repeat`.

    `repeat_fraction` is the share of words in repeats of at least `least_words`; `longest_repeat` counts words. A text is kept
    if it did not fail the base rules, at most `most_covered` of it repeats, and no repeat is longer than `most_longest`.
    NULL and empty texts have no words and fail the base rules. Equal rows give equal rows; an empty table gives none;
    other columns are not read. A text is held by one task as a whole.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("repeat_fraction", T.DoubleType()), T.StructField("longest_repeat", T.LongType())]

    def measure(batches):
        for batch in slices(batches, text_col):
            column = batch.column(text_col)
            data, starts = flat(column)
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            words, sizes, lines = [], [], []
            for text in raw(column).to_pylist():
                split = text.split()
                words.extend(map(number.__getitem__, split))
                sizes.append(len(split))
                full = [x for x in text.split(b"\n") if x.strip()]
                lines.append(len(full) - len(set(full)))
            n_words = np.array(sizes, np.int64)
            longest = longest_repeats(np.array(words, np.int64), n_words)
            cuts = np.append(0, np.cumsum(n_words))
            # No span leaves its text, so one sweep does for all texts.
            triples = sums(covered(np.where(longest >= 3, 3, 0)), cuts)
            part = sums(covered(np.where(longest >= least_words, longest, 0)), cuts) / np.maximum(n_words, 1)
            top = np.zeros(len(n_words), np.int64)
            np.maximum.at(top, np.repeat(np.arange(len(n_words)), n_words), longest)
            failed = (n_words < 50) | (100 * triples > 50 * n_words)
            kept = ~failed & (part <= most_covered) & (top <= most_longest)
            columns = [n_words, sums(_LETTER[data], starts), sums(_SYMBOL[data], starts), np.array(lines, np.int64), triples, failed, kept, part, top]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *map(pa.array, columns)], names=[f.name for f in fields])

    return in_batches(docs.select(id_col, text_col), measure, T.StructType(fields))
