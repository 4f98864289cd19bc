"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import in_batches, raw, slices, stored
from tabsmith.llm.tokens import tokenizer_text, word_tokenizer

#: Documents of a group, on average. A group is packed in one task; its pieces are a few numbers each.
GROUP_DOCUMENTS = 8192


class BinTree:
    """First-fit over open bins: a tournament tree whose nodes hold the largest room below them.

    A search walks down from the root to the first bin with enough room, in log(bins) steps.
    """

    def __init__(self, capacity: int, bins: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put `size` into the first bin that has room for it; the bin's number."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        bin_ = k - self.leaves
        room[k] -= size
        while k > 1:
            k //= 2
            top = max(room[2 * k], room[2 * k + 1])
            if room[k] == top:
                break
            room[k] = top
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset within it of each item; longest items first, equal ones in the given order."""
    order = np.argsort(-sizes, kind="stable")
    tree = BinTree(capacity, len(sizes))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = [0] * len(sizes)
    for k in order.tolist():
        size = int(sizes[k])
        bins[k] = b = tree.place(size)
        offsets[k] = filled[b]
        filled[b] += size
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with `end_id` behind them, cut at multiples of `capacity`: one row per piece, without the ids."""
    content = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "row")]
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches):
        tokenizer, row = word_tokenizer(content.value), 0
        for batch in slices(batches, text_col):
            owner, rows = [], []
            for k, text in enumerate(raw(batch.column(text_col)).to_pylist()):
                ids = memoryview(tokenizer.ids(text) + tail)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    owner.append(k)
                    rows.append((start, len(part) // 4, zlib.crc32(part), total, row))
                row += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(owner)), *columns], names=[f.name for f in fields])

    return in_batches(docs.select(id_col, text_col), cut, T.StructType(fields), keeps=True)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    group_documents: int = GROUP_DOCUMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, `start` (the document's ids before it), `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    A document of at most `capacity` ids stays whole; a longer one is cut at multiples of it, full pieces fill a sequence
    each and the rest is packed like a short document. Groups are drawn by a hash of the piece's place, so
    hot sources, copies and one id on many rows spread evenly; the number of groups is that of the documents over `group_documents`, however
    large the input is. NULL and empty texts are a piece that holds `end_id` alone. Rows with the same id are documents
    of their own. An empty table gives no rows. Other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    # A count of rows costs a look at file footers, no text.
    groups = max(1, -(-docs.count() // group_documents))
    # Written first: a piece's place in its task decides its group, and a task that runs again may meet its rows in another order.
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    seed = F.xxhash64(F.col(id_col), "start", "row", "ids_crc32")
    drawn = cut.withColumn("group", F.pmod(seed, F.lit(groups))).withColumn("place", seed)

    def fill(key, part):
        # One order of the rows whatever the shuffle delivers first.
        part = part.sort_by([("place", "ascending"), ("start", "ascending"), ("row", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(part.column("length").to_numpy(), capacity)
        numbers = pa.array(bins + key[0].as_py() * (1 << 32))
        kept = [part.column(n) for n in (id_col, "start", "length", "ids_crc32", "doc_tokens")]
        return pa.Table.from_arrays([*kept, numbers, pa.array(offsets)], names=schema.names)

    return drawn.groupBy("group").applyInArrow(fill, schema)
