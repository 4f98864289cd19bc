"""Near-duplicate documents: BagMinHash signatures of word shingles, banded, then verified by exact multiset overlap.

A document is a multiset of five-word shingles. Each shingle carries Poisson processes over its weight axis, cut into
dyadic intervals (0, 1], (1, 2], (2, 4], ...; a point has a time, a level and a signature slot, all drawn from hashes
of the shingle, so documents share points. A slot keeps the earliest point whose level lies within the
shingle's weight; two documents agree in a slot with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import free_resident, in_batches, raw, ship, slices, stored
from tabsmith.llm.graph import components, sent

SHINGLE_WORDS = 5
#: Similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 28, about 1 in 70,000.
BANDS, ROWS = 28, 5
#: Buckets of up to so many documents are compared pair by pair; larger ones in blocks of about so many shingles and
#: documents at most: two blocks meet in arrays of shingles, and of documents x documents.
PAIRED_MEMBERS, BLOCK_SHINGLES, BLOCK_DOCUMENTS = 8, 1 << 17, 1000
#: Bands that are sent to all tasks at most, because they hold more than this share of all entries each.
HOT_BANDS = 2000
#: Shingles that are compared at once within a block, and numbers of an array over pairs of its documents.
COLUMNS, PAIRS = 2048, 1 << 19
#: Points that are drawn at once.
POINTS = 1 << 18

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SEED_INTERVAL, _SEED_POINT = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers of distinct ones."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE_WORDS + 1, 1)
    total = np.full(n, min(len(words), SHINGLE_WORDS), np.uint64)
    for k in range(min(SHINGLE_WORDS, len(words))):
        total = _mix(total + h[k : k + n] * _ODD[k])
    return total


def numbered(found: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th copy of a shingle becomes a number of its own."""
    ordered = np.sort(found)
    first = np.append(True, ordered[1:] != ordered[:-1])
    place = np.arange(len(ordered))
    copy = place - np.maximum.accumulate(np.where(first, place, 0))
    return np.unique(_mix(ordered + copy.astype(np.uint64) * _ODD[0]))


def bag_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots) of weighted sets: distinct `elements` with whole `weights` of text number `owner`.

    All points of a text up to a time are drawn; where a slot stays empty, the time is extended. A filled slot has
    seen every earlier point, so the result does not depend on the times chosen.
    """
    out = np.full(texts * slots, np.inf)
    mass = np.bincount(owner, weights, texts)
    until = np.where(mass > 0, slots * (np.log(slots) + 3) / np.maximum(mass, 1), 0)
    # One process per element and dyadic interval that begins below its weight.
    top = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    rows = np.repeat(np.arange(len(elements)), top + 1)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.maximum(low, 1)
    inside = np.minimum(weights[rows] - low, size)  # levels of the interval that the weight reaches
    seed = _mix(elements[rows] + level.astype(np.uint64) * _SEED_INTERVAL)
    of, rate = owner[rows], size.astype(np.float64)
    time, point = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
    waiting = np.arange(len(rows))
    while len(waiting):
        active, block = waiting, 1
        while len(active):
            still = []
            for part in np.array_split(active, -(-len(active) * block // POINTS)):
                k = point[part, None] + np.arange(1, block + 1)
                r = _mix(seed[part, None] + k.astype(np.uint64) * _SEED_POINT)
                gaps = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate[part, None]
                times = time[part, None] + np.cumsum(gaps, axis=1)
                q = _mix(r)
                good = times <= until[of[part], None]
                # The level of the point within its interval.
                good &= ((q >> np.uint64(32)) % size[part, None].astype(np.uint64)).astype(np.int64) < inside[part, None]
                slot = ((q & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(out, (of[part, None] * slots + slot)[good], times[good])
                going = times[:, -1] <= until[of[part]]
                # Where the time is over, the first point beyond it is drawn again if the time is extended.
                stay = part[going]
                time[stay], point[stay] = times[going, -1], k[going, -1]
                still.append(stay)
            active, block = np.concatenate(still), min(2 * block, 64)
        empty = np.isinf(out.reshape(texts, slots)).any(1) & (mass > 0)
        until = np.where(empty, until * 1.6, until)
        waiting = waiting[empty[of[waiting]]]
    return out.reshape(texts, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per band, of its slots and its place."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3] + np.zeros((len(signatures), 1), np.uint64)
    for k in range(rows):
        key = _mix(key + bits[:, :, k] * _ODD[k % 5])
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, hash of the text, digest of its words, shingles, band keys); texts without words and rows without id are left out."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches):
        for batch in slices(batches, "text"):
            keep, digests, sizes, elements, weights, owner = [], [], [], [], [], []
            for k, text in enumerate(raw(batch.column("text")).to_pylist()):
                words = text.split()
                if words:
                    found, times = np.unique(shingles(words), return_counts=True)
                    elements.append(found)
                    weights.append(times)
                    owner.append(np.full(len(found), len(keep)))
                    sizes.append(int(times.sum()))
                    digests.append(digest_of(words))
                    keep.append(k)
            if not keep:
                continue
            signed = bag_signatures(np.concatenate(elements), np.concatenate(weights), np.concatenate(owner), len(keep), bands * rows)
            keys = band_keys(signed, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            passed = [batch.column(c).take(pa.array(keep)) for c in ("id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=schema.names)

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return in_batches(texts.where("id is not null and text is not null"), sketch, schema)


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, numbered shingles) of the texts in `nodes` (node, id of a row that holds it, digest)."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def sets(batches):
        for batch in slices(batches, "text"):
            words = [text.split() for text in raw(batch.column("text")).to_pylist()]
            found = [numbered(shingles(w)).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, words), pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    ids = nodes.select("id").distinct()
    # Rows that share an id may hold other texts: the digest decides.
    found = in_batches(texts.join(sent(ids, ids.count()), "id", "left_semi"), sets, schema)
    return found.join(nodes.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "set")


def enough(shared, size_a, size_b):
    """Whether two multisets with so many common elements are similar, for numbers, arrays and columns alike."""
    least, of = SIMILAR
    return shared * of >= (size_a + size_b - shared) * least


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose shingle multisets overlap enough."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "id", "digest"))
    sets = stored(shingle_sets(docs, wanted, id_col, text_col))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return both.where(enough(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"))).select("a", "b")


def linked_groups(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the first one that it is linked with, directly or over others; sets of sides 0 and 1 are compared across
    (all with all if there is one side)."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only shingles of several sets can be shared.
    number = np.cumsum(times > 1) - 1
    owner, column = owner[times[column] > 1], number[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # A few rows at once: numbers of eight bytes for all pairs would weigh more than the block itself.
    rows = max(1, PAIRS // len(sets))
    parts = [slice(low, low + rows) for low in range(0, len(sets), rows)]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(number[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[i:j], column[i:j] - low] = 1
        for part in parts:
            shared[part] += has[part] @ has.T
    links = np.empty(shared.shape, bool)
    for part in parts:
        links[part] = enough(shared[part].astype(np.int64), sizes[part, None], sizes[None, :])
    del shared
    if side.any() and not side.all():
        links &= side[:, None] != side[None, :]
    np.fill_diagonal(links, True)
    first = np.arange(len(sets))
    while True:
        lower = np.concatenate([np.where(links[part], first[None, :], len(sets)).min(1) for part in parts])
        lower = lower[lower]
        if (lower == first).all():
            return first
        first = lower


def blocks_of(sizes: DataFrame) -> DataFrame:
    """(label, blocks) of the clusters of (label, size): enough blocks for their shingles and for their documents."""
    needed = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCUMENTS))
    return sizes.groupBy("label").agg(needed.cast("int").alias("blocks"))


def met_in_groups(met: DataFrame, label: str) -> DataFrame:
    """Links (a, b) of the groups (label, low, high) of (node, set, side): one link at most per text, to the first it is linked with."""

    def compare(key, part):
        free_resident()
        part = part.sort_by([("node", "ascending"), ("side", "ascending")])
        column = part.column("set").combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        first = linked_groups(sets, part.column("side").to_numpy(zero_copy_only=False)) if len(sets) > 1 else np.zeros(len(sets), np.int64)
        nodes = part.column("node").to_numpy()
        own = np.flatnonzero(nodes[first] != nodes)
        return pa.Table.from_arrays([pa.array(nodes[first[own]]), pa.array(nodes[own])], names=["a", "b"])

    ship(met.sparkSession)
    return met.groupBy(label, "low", "high").applyInArrow(compare, "a long, b long")


def compared_in_blocks(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links among the members of large buckets (node, size, band, first node of the band).

    Buckets that overlap are one cluster. Its texts are dealt by hash into blocks of bounded size. First every block is compared in
    itself and with block 0, which joins a cluster of near copies of one text at once. Of each cluster the texts outside its largest class
    so far are then compared with all of it, in groups of two blocks. All pairs of different classes are compared, none is written,
    and no group grows with the cluster. Work grows with the cluster's size times the texts that lie outside its largest class.
    """
    clusters = components(stored(buckets.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())).withColumnRenamed("id", "node")
    sizes = clusters.join(buckets.select("node", "size").distinct(), "node")
    placed = stored(sizes.join(blocks_of(sizes), "label").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("node", "size", "label", "block", "blocks"))
    sets = stored(shingle_sets(docs, stored(nodes.join(placed.select("node"), "node", "left_semi").select("node", "id", "digest")), id_col, text_col))
    full = stored(placed.join(sets, "node"))
    others = F.sequence(F.least(F.lit(1), F.col("blocks") - 1), F.col("blocks") - 1)
    group = F.explode(F.when(F.col("block") == 0, others).otherwise(F.array("block"))).alias("high")
    links = stored(met_in_groups(full.select("node", "set", "label", F.lit(0).alias("low"), group, F.lit(False).alias("side")), "label"))
    classes = components(links).withColumnRenamed("id", "node").withColumnRenamed("label", "class")
    # Several blocks only: what is in one block has met.
    many = placed.where("blocks > 1").join(classes, "node", "left").select("node", "size", "label", F.coalesce("class", "node").alias("class"))
    counted = many.groupBy("label", "class").agg(F.count("*").alias("n"))
    largest = counted.groupBy("label").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    rest = stored(many.join(largest, "label").where(F.col("class") != F.col("largest")).select("node", "size", "label"))
    if rest.isEmpty():
        return links
    asked = rest.join(blocks_of(rest).withColumnRenamed("blocks", "asking"), "label")
    asked = asked.withColumn("low", F.pmod(F.xxhash64("node"), "asking").cast("int")).join(sets, "node")
    asked = asked.join(placed.select("label", "blocks").distinct(), "label")
    asked = asked.select("node", "set", "label", "low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("high"), F.lit(True).alias("side"))
    told = full.join(blocks_of(rest).withColumnRenamed("blocks", "asking"), "label")
    told = told.select("node", "set", "label", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("low"), F.col("block").alias("high"), F.lit(False).alias("side"))
    return links.unionByName(met_in_groups(asked.unionByName(told), "label"))


def shared_bands(distinct: DataFrame) -> DataFrame:
    """(node, size, band, members, first) of every band that several texts share.

    Bands with so many members that they would weigh on one task of a join are few, whatever the input, and are sent to all tasks.
    """
    keyed = distinct.select("node", "size", F.explode("bands").alias("band"))
    shared = stored(keyed.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("first")).where("members > 1"))
    total = shared.agg(F.sum("members")).first()[0] or 0
    # At most HOT_BANDS bands hold more than this.
    hot = F.col("members") > max(PAIRED_MEMBERS, total // HOT_BANDS)
    hot_bands = F.broadcast(shared.where(hot))
    rest = keyed.join(hot_bands.select("band"), "band", "left_anti").join(shared.where(~hot), "band")
    return keyed.join(hot_bands, "band").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, `class_id`, `class_size`, `kept`, `text_hash`) of every row: texts linked by a similarity of 0.8 or more, directly or over
    others, are a class.

    The class id is the smallest id among the class's rows, its size their number. Texts of the same words are one class at once; only one of
    them is compared further. Rows that share an id but not the text are texts of their own. Of each class the row of the smallest id is
    kept (of several, the one of the smallest digest); rows equal in id and words are kept or not together. NULL texts, texts without words and
    rows with a NULL id are a class of their own (class id = id). An empty table gives no rows; other columns are not read.

    Documents that share a band meet in a bucket. Small buckets give pairs, which are verified once each; documents of large
    buckets are compared in blocks. Either way every pair that shares a band is compared on its whole multisets, or known to be of one class.
    """
    sketched = stored(sketches(docs, id_col, text_col, bands, rows))
    # Hot copies are combined before the shuffle. Nodes are numbers of distinct texts, fixed by the written table.
    grouped = sketched.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    distinct = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    buckets = stored(shared_bands(distinct))
    small, large = buckets.where(F.col("members") <= PAIRED_MEMBERS), buckets.where(F.col("members") > PAIRED_MEMBERS)
    # No pair can be similar whose sizes are further apart than the similarity.
    near = (F.col("x.node") < F.col("y.node")) & enough(F.least("x.size", "y.size"), F.col("x.size"), F.col("y.size"))
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & near)
    pairs = stored(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    links = verified(pairs, distinct, docs, id_col, text_col)
    if not large.isEmpty():
        links = links.unionByName(compared_in_blocks(large, distinct, docs, id_col, text_col))
    labels = components(stored(links)).withColumnRenamed("id", "node")
    named = stored(distinct.join(labels, "node", "left").select("digest", "id", "copies", F.coalesce("label", "node").alias("label")))
    classes = named.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("first"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "label").select("digest", F.col("first.id").alias("class_id"), F.col("first.digest").alias("first"), "class_size")
    kept = (F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("first"))
    classed = sketched.select("id", "text_hash", "digest").join(named, "digest").select("id", "class_id", "class_size", kept.alias("kept"), "text_hash")
    rest = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rest = rest.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.xxhash64("text").alias("text_hash"))
    return classed.unionByName(rest).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one row of each class: the one of the smallest id."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left_anti").select(*docs.columns)
