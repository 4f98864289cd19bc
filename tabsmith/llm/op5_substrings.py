"""Substring dedup by content-defined chunks: a gear rolling hash cuts the texts, chunks of the same digest are one.

A cut depends on the sixteen bytes before it, so after an insertion the cuts fall into step again and a passage
gives the same chunks in every document. Of a chunk found several times, the first one stays: in the text of the smallest id (of several
texts, that of the smallest hash), at its first place; elsewhere, runs of such chunks that hold enough words go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import CARRIED, flat, in_batches, packed, raw, slices, unpacked

#: Chunks have `LEAST` to `MOST` bytes, and on average one cut in 2 ** CUT_BITS bytes from `LEAST` on.
LEAST, MOST, CUT_BITS = 16, 512, 5
#: Words of a run of repeated chunks that is removed, at least.
RUN_WORDS = 8
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _gear() -> np.ndarray:
    """A 16-bit number per byte, from a fixed mixing rule."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b])) & 0xFFFF for b in range(256)], np.uint16)


_GEAR = _gear()


def candidates(data: np.ndarray) -> np.ndarray:
    """Places before which the gear hash asks for a cut. h = 2 h + gear[byte] in 16 bits, over all places at once by doubling."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint16(shift))
    return np.flatnonzero(h < (1 << (16 - CUT_BITS))) + 1


def cuts(text: bytes, wanted: list[int]) -> list[int]:
    """Ends of the chunks of one text, never within a character."""
    ends, last, size = [], 0, len(text)
    for place in wanted:
        while place - last > MOST:
            last = _boundary(text, last + MOST)
            ends.append(last)
        if place - last >= LEAST and place < size and text[place] & 0xC0 != 0x80:
            ends.append(place)
            last = place
    while size - last > MOST:
        last = _boundary(text, last + MOST)
        ends.append(last)
    if last < size:
        ends.append(size)
    return ends


def _boundary(text: bytes, place: int) -> int:
    while place < len(text) and text[place] & 0xC0 == 0x80:
        place += 1
    return place


def chunks_of(column: pa.Array):
    """For each text its bytes and the ends of its chunks."""
    data, starts = flat(column)
    if not len(data):
        for text in raw(column).to_pylist():
            yield text, []
        return
    places = candidates(data)
    bounds = np.searchsorted(places, starts)
    for k, text in enumerate(raw(column).to_pylist()):
        # A window that began in the text before does not count.
        own = places[bounds[k] : bounds[k + 1]] - starts[k]
        yield text, cuts(text, own[own >= LEAST].tolist())


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, place, two halves of the digest) of every chunk."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def split(batches):
        for batch in slices(batches, "text"):
            owner, place, digests = [], [], []
            for k, (text, ends) in enumerate(chunks_of(batch.column("text"))):
                last = 0
                for end in ends:
                    digests.append(xxhash.xxh3_128_digest(text[last:end]))
                    last = end
                owner.append(np.full(len(ends), k))
                place.append(np.arange(len(ends), dtype=np.int32))
            if digests:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [batch.column(c).take(pa.array(np.concatenate(owner))) for c in ("id", "text_hash")] + [pa.array(np.concatenate(place))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=schema.names)

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return in_batches(texts.where("id is not null and text is not null"), split, schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, places of chunks found before, and in which id). Rows equal in id and text are one text."""
    found = chunks(docs, id_col, text_col)
    at = F.struct("id", "text_hash", "place")
    several = found.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("first") < F.col("last"))
    again = found.join(several.select("d1", "d2", "first"), ["d1", "d2"]).where(at > F.col("first"))
    return again.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("place", F.col("first.id").alias("first")))).alias("again"))


def cut_out(text: bytes, ends: list[int], again: list[dict], run_words: int) -> tuple[bytes, list[tuple[int, int]], set]:
    """The text without long enough runs of repeated chunks, the byte spans taken out, and the documents that hold them first."""
    spans, firsts, k = [], set(), 0
    while k < len(again):
        j = k
        while j + 1 < len(again) and again[j + 1]["place"] <= again[j]["place"] + 1:
            j += 1
        low = ends[again[k]["place"] - 1] if again[k]["place"] else 0
        high = ends[again[j]["place"]]
        # Words that reach over the run's edges stay whole, in one piece.
        while 0 < low < high and text[low - 1] not in _SPACES and text[low] not in _SPACES:
            low += 1
        while low < high < len(text) and text[high] not in _SPACES and text[high - 1] not in _SPACES:
            high -= 1
        if len(text[low:high].split()) >= run_words:
            spans.append((low, high))
            firsts.update(x["first"] for x in again[k : j + 1])
        k = j + 1
    left, last = [], 0
    for low, high in spans:
        left.append(text[last:low])
        last = high
    return b"".join([*left, text[last:]]), spans, firsts


def remove_repeats(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, `carry`, the text without its repeated passages, `removed_bytes`, `removed_words`, `spans` (bytes from, to), `first_ids`.

    A passage stays where it comes first: in the text of the smallest id that holds it, once. NULL texts stay NULL, empty ones empty; rows with
    a NULL id are left as they are. Rows that share an id but not the text are texts of their own (the smaller hash comes first);
    rows equal in both count as one text, and all of them keep what it keeps. A removed run never cuts a word. An empty table gives no rows. `carry`
    names the other columns that are passed on; none may have the name of a result column.
    """
    id_type = docs.schema[id_col].dataType
    kept = list(dict.fromkeys([id_col, *carry]))
    span = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField(text_col, T.StringType()), T.StructField("removed_bytes", T.LongType()), T.StructField("removed_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("first_ids", T.ArrayType(id_type))]
    )
    places = repeated(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "again")
    texts = docs.select(*kept, F.col(text_col).alias("_text"))
    texts = texts.join(places, (F.col(id_col) == F.col("_id")) & (F.xxhash64("_text") == F.col("_hash")), "left").drop("_id", "_hash")

    def remove(batches):
        for batch in slices(batches, "_text"):
            out = []
            again = batch.column("again").to_pylist()
            null = batch.column("_text").is_null().to_pylist()
            for (text, ends), found, none in zip(chunks_of(batch.column("_text")), again, null, strict=True):
                left, spans, firsts = cut_out(text, ends, found, run_words) if found else (text, [], set())
                words = sum(len(text[a:b].split()) for a, b in spans)
                out.append((None if none else left.decode(errors="replace"), len(text) - len(left), words, [{"low": a, "high": b} for a, b in spans], sorted(firsts)))
            columns = [pa.array(c, pa_type) for c, pa_type in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields[len(kept) :]]
    return in_batches(texts, remove, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages taken out; documents of which no word is left go."""
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    left = remove_repeats(packed(docs, own), carry=(*own[2:], CARRIED))
    left = left.where((F.col("removed_bytes") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_bytes") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return unpacked(left, docs.columns, own)
