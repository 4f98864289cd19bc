"""Exact dedup: a tree merge of sorted digest runs.

Every run of rows gives a sorted run of (key, digest, size) entries, each with the identifier that stays and a count. Runs are
then exchanged in rounds: in round r a slot sends each entry to the slot whose digit r is digit r of the entry's key, so that
`RADIX` runs meet in every slot and are merged into one sorted run. After the last round a slot holds all of its share of
the keys, and no slot, at any level, holds more than that share of the distinct texts. However hot a text is, a run holds
one entry of it, and a slot reads at most `RADIX` of them a round.

The 64-bit key orders the runs; entries are merged only where SHA-256 and byte length agree as well.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import in_batches, stored

#: Runs that meet in one merge, as a power of two.
RADIX_BITS = 3
RADIX = 1 << RADIX_BITS
#: Entries of a slot after the last round, about; more rows mean more slots.
SLOT_ENTRIES = 200_000
#: Rows of one run at most, as a power of two.
RUN_BITS = 16
#: What has to agree before two entries are one.
SAME = ("key", "digest", "size")


def unchanged(text: Column) -> Column:
    return text


def digest_key(text: Column) -> Column:
    """The number that orders the runs."""
    return F.xxhash64(text)


def digests(docs: DataFrame, id_col: str, text_col: str, normal: Callable[[Column], Column]) -> DataFrame:
    """(id, place, run, key, digest, size) of every row. `place` is the row's own; `run` is a stretch of rows read together."""
    text = normal(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.col(id_col).alias("id"), digest_key(text).alias("key"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).alias("size"))
    found = found.withColumn("place", F.monotonically_increasing_id())
    return found.withColumn("run", F.shiftright("place", RUN_BITS))


def merge(batches):
    """Sorted entries as sorted entries in which each text occurs once: the first of its entries, with all their counts."""
    names, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        # The last text of a batch may go on in the next one.
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        new = np.ones(rows.num_rows, bool)
        differs = np.zeros(rows.num_rows - 1, bool)
        for c in ("slot", *SAME):
            column = rows.column(c)
            differs |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs
        first = np.flatnonzero(new)
        copies = np.add.reduceat(rows.column("copies").to_numpy(), first)
        one = rows.take(pa.array(first))
        one = one.set_column(names.index("copies"), one.schema.field("copies"), pa.array(copies))
        if one.num_rows > 1:
            yield one.slice(0, one.num_rows - 1)
        last = one.slice(one.num_rows - 1)
    if last is not None:
        yield last


def merged(entries: DataFrame, largest: bool) -> DataFrame:
    """The entries of each slot, merged within the tasks that hold them; of equal texts the identifier that stays comes first."""
    keeper = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    return in_batches(entries.sortWithinPartitions("slot", *SAME, keeper, "place"), merge, entries.schema)


def slot_digits(rows: int) -> int:
    """Rounds that are needed, two at least."""
    digits = 2
    while RADIX**digits * SLOT_ENTRIES < rows:
        digits += 1
    return digits


def tree(entries: DataFrame, digits: int, largest: bool) -> DataFrame:
    """One entry per text of all, by `digits` rounds of exchange and merge."""
    for r in range(digits):
        low = RADIX_BITS * r
        own = F.col("slot").bitwiseAND(F.lit(~((RADIX - 1) << low)).cast("long"))
        wanted = F.col("key").bitwiseAND(F.lit((RADIX - 1) << low).cast("long"))
        entries = merged(entries.withColumn("slot", own.bitwiseOR(wanted)).repartition("slot"), largest)
    return entries


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = False,
    normal: Callable[[Column], Column] = unchanged,
) -> DataFrame:
    """Per row: id, `keep_id` (id of the row that stays), `group_size`, `kept`, `text_sha256`.

    Texts are equal if `normal` makes them the same string; NULL counts as empty. Of equal texts the smallest id stays, or the
    largest. A NULL id stays only where no other row has one. Of rows that share that id too, exactly one is `kept`: the first
    one read. Other columns are not read, whatever their names. An empty table gives no rows.

    The texts are read once; what follows works on a written table of identifiers and digests.
    """
    rows = stored(digests(docs, id_col, text_col, normal))
    digits = slot_digits(rows.count())
    entries = rows.select("run", *SAME, "id", "place", F.lit(1).cast("long").alias("copies"))
    # Each run for itself first; copies within it are one entry from here on.
    runs = stored(merged(entries.withColumnRenamed("run", "slot"), largest))
    slots = runs.withColumn("slot", F.pmod(F.xxhash64("slot"), F.lit(RADIX**digits)))
    groups = stored(tree(slots, digits, largest).where("copies > 1").select(*SAME, F.col("id").alias("keep_id"), F.col("place").alias("keep_place"), F.col("copies").alias("group_size")))
    # Down again: a run asks for its repeated texts once each, then its rows ask the run.
    told = runs.select(F.col("slot").alias("run"), *SAME).distinct().join(groups, [*SAME])
    out = rows.join(told, ["run", *SAME], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: The registered query over `documents` (the largest id stays), for DuckDB.
DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
