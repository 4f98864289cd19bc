"""Toxicity: a linear classifier over character n-grams scaled by their naive Bayes log-count ratios.

A feature is whether a hashed n-gram of the lower-cased text is present; its value is the log ratio of its
smoothed frequencies in toxic and other training texts. Logistic regression weighs the features that set the classes
apart most. Trained on a bounded sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import crc_mod, in_batches, raw, slices, stored
from tabsmith.llm.graph import first_by_hash

#: Lengths of the n-grams, and bits of their hash.
GRAMS = (3, 5, 7)
BITS = 18
#: Features of the classifier, and training texts of each class at most (by a hash of their ids).
FEATURES = 2048
SAMPLE_TEXTS = 4000
#: Added to each count, and the classifier's penalty.
SMOOTHING = 1.0
PENALTY = 1e-4
STEPS = 200
#: Characters that are hashed at once.
BLOCK = 1 << 19
#: Odd multipliers of a gram's characters.
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5)]


def gram_numbers(letters: np.ndarray) -> np.ndarray:
    """Hashed numbers of all n-grams of a text's characters (code points)."""
    found = []
    for low in range(0, max(len(letters), 1), BLOCK):
        part = letters[low : low + BLOCK + max(GRAMS) - 1]
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            mixed = mixed[:size] + part[n - 1 :] * _FACTORS[n - 1]
            if n in GRAMS:
                h = mixed[: BLOCK if low + BLOCK < len(letters) else None] + np.uint32(n)
                h = (h ^ (h >> np.uint32(15))) * _FACTORS[0]
                found.append(h >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def letters_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode(errors="replace").lower().encode("utf-32-le"), np.uint32)


@dataclass
class ToxicityModel:
    """Which hashed n-grams count (`place`, -1 for none), their weights, and the constant."""

    place: np.ndarray
    weight: np.ndarray
    constant: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        present = np.zeros(len(self.weight) + 1, bool)
        weight = np.append(self.weight, 0.0)  # the last one stands for all grams that do not count
        for k, text in enumerate(texts):
            present[:] = False
            present[self.place[gram_numbers(letters_of(text))]] = True
            out[k] = self.constant + weight[present].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of (smoothed share of a feature among the counts of toxic texts / the same of the others)."""
    p, q = toxic + smoothing, other + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant of a penalised logistic regression, by accelerated gradient steps; both classes weigh the same."""
    n, k = x.shape
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(x.dtype)
    v = np.ones(k, x.dtype) / np.sqrt(max(k, 1))
    for _ in range(20):  # the largest curvature
        v = x.T @ (each * (x @ v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    rate = 1 / (0.25 * (1.1 * top + 1) + penalty)
    w, c, w0, c0 = np.zeros(k, x.dtype), 0.0, np.zeros(k, x.dtype), 0.0
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        wv, cv = w + m * (w - w0), c + m * (c - c0)
        wrong = each * (1 / (1 + np.exp(-np.clip(x @ wv + cv, -50, 50))) - y)
        w0, c0 = w, c
        w, c = wv - rate * (x.T @ wrong + penalty * wv), cv - rate * float(wrong.sum())
    return w, c


def train(
    docs: DataFrame,
    labels: DataFrame,
    features: int = FEATURES,
    sample_texts: int = SAMPLE_TEXTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A classifier from at most `sample_texts` labelled texts of each class (plus rows that share their ids).

    Labels other than 0 and 1, NULL ids and labels without a document teach nothing. Without both classes no
    feature counts, and the score is the only class's (0.5 without any).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    # At most two times sample_texts ids.
    ids = first_by_hash(known, "label", sample_texts)
    sample = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("label", "text").dropDuplicates())

    def counts(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches, "text"):
            for text, label in zip(raw(batch.column("text")).to_pylist(), batch.column("label").to_pylist(), strict=True):
                present = np.zeros(1 << BITS, bool)
                present[gram_numbers(letters_of(text))] = True
                total[label] += present
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["gram", "other", "toxic"])

    tally = in_batches(sample, counts, "gram long, other long, toxic long").groupBy("gram").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = np.full(1 << BITS, -1, np.int32)
    if len(sizes) < 2 or not tally.num_rows:
        only = {0: -500.0, 1: 500.0}[next(iter(sizes))] if len(sizes) == 1 else 0.0
        return ToxicityModel(place, np.zeros(0), only)
    gram, other, toxic = (tally.column(c).to_numpy().astype(np.float64) for c in ("gram", "other", "toxic"))
    ratio = log_count_ratios(toxic, other)
    p, q = toxic / sizes[1], other / sizes[0]
    pooled = (toxic + other) / (sizes[0] + sizes[1])
    apart = (p - q) ** 2 / np.maximum(pooled * (1 - pooled), 1 / (sizes[0] + sizes[1]))
    best = np.lexsort((gram, -apart))[:features]
    place[gram[best].astype(np.int64)] = np.arange(len(best))

    def chosen(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in raw(batch.column("text")).to_pylist():
                found = np.unique(place[gram_numbers(letters_of(text))])
                rows.append(found[found >= 0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "features"])

    seen = in_batches(sample, chosen, "label int, features array<int>").orderBy("label", F.xxhash64("features")).toArrow()
    y = seen.column("label").to_numpy().astype(np.float32)
    x = np.zeros((len(y), len(best)), np.float32)
    scale = ratio[best].astype(np.float32)
    for k, row in enumerate(seen.column("features").to_pylist()):
        x[k, row] = scale[row]
    w, c = logistic(x, y)
    return ToxicityModel(place, (w * scale).astype(np.float64), c)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `score` (0 to 1) and `predicted` (1 from 0.5 up). NULL and empty texts have the score of no feature.

    Equal texts have equal scores; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches):
        for batch in slices(batches, text_col):
            scores = sent.value.scores(raw(batch.column(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names)

    return in_batches(docs.select(id_col, text_col), judge, schema)


def folds(id_col: str = "doc_id"):
    """Whether a document is held out of training."""
    return F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False))
