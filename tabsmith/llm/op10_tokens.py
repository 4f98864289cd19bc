"""Token counts by prefix dynamic programming.

count(prefix) = count(words before it) + count(the part of the word it ends in). One pass over the words of a text stores the exact
count at every word end; the counts at every prefix of a word come from dynamic programming over its letters (`prefixes.py`), once
per word, in time linear in its length. Truncation ("how much of the text fits into b tokens") and cut questions ("how many
tokens are in the first c characters") are answered from stored counts; nothing is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabsmith.llm.common import in_batches, raw, slices
from tabsmith.llm.tokens import WordTokenizer, tokenizer_text, word_tokenizer

_WORDS = re.compile(r"[^\x20\x09-\x0d]+")


class PrefixCounts:
    """Exact token counts of all prefixes of one text (positions in characters)."""

    def __init__(self, tokenizer: WordTokenizer, text: bytes) -> None:
        self.tokenizer, self.raw = tokenizer, text
        words = text.split()
        self.counts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, tokenizer.words(words)), np.int64, len(words)) // 4, out=self.counts[1:])
        self._text: str | None = None

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = self.raw.decode(errors="replace")
            at = np.array([m.span() for m in _WORDS.finditer(self._text)], np.int64).reshape(-1, 2)
            self.starts, self.ends = at[:, 0], at[:, 1]
        return self._text

    def inside(self, k: int, limit: int | None = None) -> np.ndarray:
        """Counts at every prefix of word k; with a limit, at those that may be within it."""
        return self.tokenizer.prefixes(self.text[self.starts[k] : self.ends[k]], limit)

    def at(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        chars = min(max(chars, 0), len(self.text))
        k = int(np.searchsorted(self.starts, chars, side="left"))  # words that start before the cut
        if not k or self.ends[k - 1] <= chars:
            return int(self.counts[k])
        return int(self.counts[k - 1] + self.inside(k - 1)[chars - self.starts[k - 1]])

    def every(self) -> np.ndarray:
        """Counts at all prefixes of the text, the empty one first."""
        out = np.zeros(len(self.text) + 1, np.int64)
        out[self.ends] = np.diff(self.counts)
        out = np.cumsum(out)
        for k in range(len(self.starts)):
            out[self.starts[k] : self.ends[k] + 1] = self.counts[k] + self.inside(k)
        return out

    def within(self, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.counts, budget, side="right")) - 1  # whole words that fit
        # A part of a word may need more tokens than a longer part: the longest one that fits counts.
        start, left = int(self.starts[k]) if len(self.text) else 0, int(budget - self.counts[k])
        return start + int(np.flatnonzero(self.inside(k, left) <= left)[-1])


def prefix_counts(
    docs: DataFrame,
    tokenizer_path: str,
    budgets: Sequence[int] = (),
    cuts: Sequence[int] = (),
    table: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, `n_bytes`, `n_tokens`, for each budget b `chars_within_b` (characters of the longest prefix of at most b
    tokens), for each cut c `tokens_at_c` (tokens of the first c characters); with `table` also `counts`, the count at every
    prefix (the empty one first).

    NULL and empty texts count as empty; a NULL id is carried as it is; equal rows give equal rows; other columns of the
    input are not read, whatever their names. An empty table gives no rows. One text is held by one task as a whole.
    """
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(f"chars_within_{b}", T.LongType()) for b in budgets] + [T.StructField(f"tokens_at_{c}", T.LongType()) for c in cuts]
    fields += [T.StructField("counts", T.ArrayType(T.LongType()))] * table

    def count(batches):
        tokenizer = word_tokenizer(content.value)
        for batch in slices(batches, text_col):
            rows = []
            for text in raw(batch.column(text_col)).to_pylist():
                counts = PrefixCounts(tokenizer, text)
                rows.append([len(text), counts.total, *map(counts.within, budgets), *map(counts.at, cuts)] + ([counts.every().tolist()] if table else []))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=[f.name for f in fields])

    return in_batches(docs.select(id_col, text_col), count, T.StructType(fields), keeps=True)
