"""Language identification by prediction by partial matching.

One context tree of bytes per language: up to three bytes of context, escapes (method C) to shorter contexts, with
exclusion, down to a uniform choice. After training the statistics are frozen, so a text has one exact
code length under each language; the shortest one wins.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import CARRIED, crc_mod, flat, in_batches, packed, resident, slices, stored, unpacked
from tabsmith.llm.graph import first_by_hash, sent

#: Training documents of each language at most, in the order of a hash of their ids.
SAMPLE_DOCUMENTS = 400
#: A context must have been met so often to stay in the trees.
LEAST_SEEN = 8
#: A text that needs more bits a byte than this under every language resembles none of them.
MOST_BITS = 5.5
UNDETERMINED = "und"
#: Positions that are looked up at once.
BLOCK = 1 << 19


@dataclass
class LanguageModel:
    """Counts of (language, four bytes); byte b is held as b + 1, and 0 stands before a text's first byte."""

    languages: list[str]
    language: np.ndarray
    gram: np.ndarray
    count: np.ndarray
    least_seen: int = LEAST_SEEN
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def tables(self) -> Tables:
        return Tables(self)


class Tables:
    """Code lengths in bits for every kept context and byte, under each language."""

    def __init__(self, model: LanguageModel) -> None:
        gram, n_lang = model.gram.astype(np.int64), len(model.languages)
        # Four base-257 digits; letters that never occur share one more number.
        digits = np.stack([gram // 257**3, gram // 257**2 % 257, gram // 257 % 257, gram % 257], axis=1)
        seen = np.unique(np.append(digits, 0))
        self.symbol = np.full(257, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.size = a = len(seen) + 1
        unseen = max(257 - len(seen), 1)
        d = self.symbol[digits].astype(np.int64)
        below = np.full((1, a), 1 / 256, np.float32)
        below[0, 0] = 0
        below[0, a - 1] = unseen / 256
        below /= below.sum()
        nodes = np.zeros(1, np.int64)  # contexts of the order before, as numbers in base a
        tables = np.repeat(below[None], n_lang, axis=0)  # language, context, symbol
        place = np.zeros(1, np.int32)  # number of a context -> its row
        for order in range(4):
            context = np.zeros(len(d), np.int64)
            for k in range(3 - order, 3):
                context = context * a + d[:, k]
            if order == 0:
                kept = np.zeros(1, np.int64)
            else:
                numbers, inverse = np.unique(context, return_inverse=True)
                times = np.bincount(inverse, model.count, len(numbers))
                kept = numbers[times >= model.least_seen]
            counts = np.zeros((n_lang, len(kept), a), np.float32)
            if len(kept):
                row = np.minimum(np.searchsorted(kept, context), len(kept) - 1)
                own = kept[row] == context
                np.add.at(counts, (model.language[own], row[own], d[own, 3]), model.count[own])
            # The context without its first symbol is in the order before, or falls further down.
            shorter = place[kept % a ** max(order - 1, 0)] if order else np.zeros(len(kept), np.int32)
            lower = tables[:, shorter, :]
            total, kinds = counts.sum(2, keepdims=True), (counts > 0).sum(2, keepdims=True)
            left = np.where(counts > 0, 0, lower).sum(2, keepdims=True)
            escape = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0, casting="unsafe")
            full = left <= 0  # nothing is left to escape to
            seen_share = 1 / np.maximum(total + np.where(full, 0, kinds), 1)
            new_share = np.where(total > 0, escape / np.where(full, 1, left), 1)
            # In place, a table being the largest thing that a worker holds.
            np.multiply(counts, seen_share.astype(np.float32), out=counts)
            np.multiply(lower, new_share.astype(np.float32), out=lower)
            probability = np.where(counts > 0, counts, lower)
            del counts, lower
            tables = np.concatenate([tables, probability], axis=1)
            rows = np.arange(tables.shape[1] - len(kept), tables.shape[1], dtype=np.int32)
            if order == 0:
                place = rows
            else:
                place = np.tile(place, a)  # every context falls to the one without its first symbol
                place[kept] = rows
            nodes = kept
        self.place = place
        with np.errstate(divide="ignore"):
            bits = -np.log2(np.maximum(tables, 1e-12))
        bits[:, :, a - 1] += np.log2(unseen)  # the shared number is one of so many bytes
        self.bits = np.ascontiguousarray(bits.transpose(1, 2, 0).reshape(-1, n_lang), np.float32)

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        a, n = self.size, len(data)
        out = np.zeros((len(starts) - 1, self.bits.shape[1]))
        full = np.flatnonzero(np.diff(starts))
        if not n:
            return out
        symbol = self.symbol[data.astype(np.int32) + 1]
        first = starts[full]
        before = [symbol]
        for _ in range(3):
            one = np.empty_like(symbol)
            one[0], one[1:] = 0, before[-1][:-1]
            one[first] = 0
            before.append(one)
        for low in range(0, n, BLOCK):
            high = min(n, low + BLOCK)
            s, p1, p2, p3 = (x[low:high] for x in before)
            cost = self.bits[self.place[(p3 * a + p2) * a + p1].astype(np.int64) * a + s]
            lo, hi = np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, high, side="left")
            cuts = np.maximum(first[lo:hi] - low, 0)
            out[full[lo:hi]] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)
        return out


def train(
    labelled: DataFrame,
    sample_documents: int = SAMPLE_DOCUMENTS,
    least_seen: int = LEAST_SEEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Context statistics of each language from at most `sample_documents` of its documents, chosen by a hash of the id.

    Rows with a NULL id, text or language teach nothing. What reaches the driver are counts of four-byte strings.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null")
    # At most sample_documents ids of each language.
    ids = stored(first_by_hash(rows, "lang", sample_documents))
    sample = rows.join(sent(ids, ids.count()), ["id", "lang"], "left_semi").select("lang", "text")

    def grams(batches):
        for batch in slices(batches, "text"):
            data, starts = flat(batch.column("text"))
            if not len(data):
                continue
            symbol = data.astype(np.int64) + 1
            first = starts[:-1][np.diff(starts) > 0]
            code, one = symbol.copy(), symbol
            for k in (1, 2, 3):
                one = np.concatenate([[0], one[:-1]])
                one[first] = 0
                code += one * 257**k
            names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            of = np.repeat(lang, np.diff(starts))
            for k, name in enumerate(names):
                found, times = np.unique(code[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(times)], names=["lang", "gram", "n"])

    counted = in_batches(sample, grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(names)}
    language = np.array([number[x] for x in counted.column("lang").to_pylist()], np.int64)
    gram, n = counted.column("gram").to_numpy().astype(np.int64), counted.column("n").to_numpy().astype(np.float64)
    order = np.lexsort((gram, language))
    return LanguageModel(names, language[order], gram[order], n[order], least_seen)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, `lang_pred`, `score` (probability of that language against the others), `bits_per_byte` (NULL without text),
    and the columns in `carry`.

    Texts that are NULL or hold no letter are `und` with score 0, as is every text when nothing was learned. Equal code lengths
    go to the first language in order of code points. Other columns are not read; an empty table gives no rows.
    """
    if not model.languages:
        score = [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte")]
        return docs.select(id_col, *score, *carry)
    sent, key, languages = docs.sparkSession.sparkContext.broadcast(model), model.key, model.languages
    fields = [docs.schema[c] for c in (id_col, *carry)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    names = [id_col, *carry]

    def score(batches):
        tables = resident(key, lambda: sent.value.tables())
        for batch in slices(batches, "_text"):
            data, starts = flat(batch.column("_text"))
            bits, size = tables.code_lengths(data, starts), np.diff(starts)
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            sure = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            known = np.array(batch.column("_letter").fill_null(False).to_pylist(), bool) & (size > 0)
            chosen = [languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [pa.array(chosen, pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(least / np.maximum(size, 1), mask=size == 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[f.name for f in fields])

    rows = docs.select(*names, F.col(text_col).alias("_text"), has_letter(text_col).alias("_letter"))
    return in_batches(rows, score, T.StructType(fields), keeps=True)


def has_letter(text_col: str) -> Column:
    return F.col(text_col).rlike(r"\p{L}")


def folds(id_col: str = "doc_id") -> Column:
    """Whether a document is held out of training."""
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))


def keep_languages(docs: DataFrame, model: LanguageModel, most_bits: float = MOST_BITS) -> DataFrame:
    """The documents whose language is known: not `und`, and at most `most_bits` bits a byte under the best language."""
    own = ["doc_id", "text"]
    seen = identify(packed(docs, own), model, carry=("text", CARRIED))
    known = seen.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= most_bits))
    return unpacked(known, docs.columns, own)
