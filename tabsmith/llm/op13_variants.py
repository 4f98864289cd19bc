"""Spelling variants: words one edit apart, by dynamic programming over the sorted vocabulary.

Words are sorted, and a query's edit-matrix row for a prefix is computed once for all words that share it: where the longest
common prefix (LCP) of neighbours in the list ends, new rows branch off. Of a row only the band of three cells around the
diagonal can hold one edit or less; where all three exceed it, the whole range of words with that prefix is skipped.

One edit leaves one half of a word as it is. So a word scans the range of its first half in the sorted list, and the range
of its last half in the list sorted from the words' ends. Both lists are cut into blocks of bounded size, and a word visits those
blocks of its range whose shared prefix is still within one edit. Rows of all queries of a block are computed together, a
character further at a time.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import in_batches, raw, slices, stored

#: A form occurs at least so many times as often as its variant.
FORM_FACTOR = 10
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A run whose checksum this number divides loses one letter.
DIVISOR = 31
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 500_000
#: Words of a block (at least, as a power of two) and blocks of either list (about, at most): bounds what every task is told of the blocks.
BLOCK_BITS, MOST_BLOCKS = 12, 50_000
#: Letters of a block's bounds that are told.
BOUND_LETTERS = 64
#: Queries whose rows are computed together.
TOGETHER = 4096


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, divisor: int = DIVISOR) -> DataFrame:
    """(word, n) of the texts' letter runs, lower-cased in A to Z, some without one letter. Counts are summed in the tasks first."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def count(batches):
        total = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for id_, text in zip(batch.column("id").to_pylist(), raw(batch.column("text")).to_pylist(), strict=True):
                start = zlib.crc32(f"{id_ or ''}:".encode())
                # Bytes are lower-cased in A to Z only. The checksum of a whole run goes on from that of the id.
                for run, n in Counter(runs(text.lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % divisor == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                    if len(run) >= least:
                        total[run] += n
            if len(total) > HELD_WORDS:
                yield rows()
                total.clear()
        if total:
            yield rows()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return in_batches(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def flat_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, two zeros after each; where each starts; lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join([w + "\0\0" for w in words]).encode("utf-32-le"), np.uint32)
    return letters, np.cumsum(lengths + 2) - lengths - 2, lengths


def common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def step(band: tuple, letter: np.ndarray, letters: np.ndarray, at: np.ndarray, lengths: np.ndarray, depth: int) -> tuple:
    """The band of the row after one letter more: distances of depth + 1 letters of the list's word from depth, depth + 1 and
    depth + 2 letters of the query (whose letter number `depth` lies at `at`). Beyond the query's end: 2."""
    left, middle, right = band
    new = np.minimum(left + (letters[at - 1] != letter), middle + 1) if depth else middle + 1
    equal = np.minimum(middle + (letters[at] != letter), np.minimum(right, new) + 1)
    after = np.minimum(right + (letters[np.minimum(at + 1, len(letters) - 1)] != letter), equal + 1)
    two = np.int8(2)
    new = np.where(depth > lengths, two, np.minimum(new, two)).astype(np.int8)
    equal = np.where(depth + 1 > lengths, two, np.minimum(equal, two)).astype(np.int8)
    return new, equal, np.where(depth + 2 > lengths, two, np.minimum(after, two)).astype(np.int8)


class SortedList:
    """A sorted block of words: letters, lengths, and the LCP of each with the one before."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.letters, self.starts, self.lengths = flat_letters(words)
        self.lcp = np.array([-1, *map(common, words[:-1], words[1:])], np.int64)
        self._levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, depth: int) -> np.ndarray:
        """Places where ranges of words with the same first `depth` letters start."""
        return np.flatnonzero((self.lcp < depth) & (self.lengths >= depth))

    def near(self, queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs one edit apart that share the query's first `half` letters."""
        letters, starts, lengths = flat_letters(queries)
        entering: dict[int, list[tuple[int, int, int]]] = {}
        for q, (query, half) in enumerate(zip(queries, halves, strict=True)):
            prefix = query[:half]
            low = bisect_left(self.words, prefix)
            high = bisect_left(self.words, prefix[:-1] + chr(ord(prefix[-1]) + 1), low) if half else len(self.words)
            if low < high:
                entering.setdefault(half, []).append((q, low, high))
        q = low = high = np.zeros(0, np.int64)
        band = (np.zeros(0, np.int8),) * 3
        found_q, found_word = [], []
        depth = min(entering, default=0)
        while len(q) or any(d >= depth for d in entering):
            if depth in entering:
                new = np.array(entering.pop(depth), np.int64)
                one, none = np.ones(len(new), np.int8), np.zeros(len(new), np.int8)
                q, low, high = (np.concatenate([x, y]) for x, y in zip((q, low, high), new.T, strict=True))
                band = tuple(np.concatenate([x, y]) for x, y in zip(band, (one, none, one), strict=True))
            # The first word of a range may end here.
            ahead = lengths[q] - depth
            ends = np.flatnonzero((self.lengths[low] == depth) & (np.abs(ahead) <= 1))
            distance = np.choose(ahead[ends] + 1, [b[ends] for b in band])
            found_q.append(q[ends[distance == 1]])
            found_word.append(low[ends[distance == 1]])
            # Ranges of one letter more within the ranges.
            level = self.level(depth + 1)
            first, last = np.searchsorted(level, low), np.searchsorted(level, high)
            many = last - first
            of = np.repeat(np.arange(len(q)), many)
            child = np.arange(len(of)) + np.repeat(first - (np.cumsum(many) - many), many)
            inner_low = level[child]
            inner_high = np.where(child + 1 < last[of], np.append(level, 0)[np.minimum(child + 1, len(level))], high[of])
            q = q[of]
            band = step(tuple(b[of] for b in band), self.letters[self.starts[inner_low] + depth], letters, starts[q] + np.minimum(depth, lengths[q] + 1), lengths[q], depth)
            alive = np.flatnonzero(np.minimum(np.minimum(band[0], band[1]), band[2]) <= 1)
            q, low, high, band = q[alive], inner_low[alive], inner_high[alive], tuple(b[alive] for b in band)
            depth += 1
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_word)


def half_of(side: int, length: int) -> int:
    """Letters that a word's near words share with it at the start (side 0) or at the end (side 1), if the edit is beyond."""
    return length // 2 if side == 0 else length - length // 2


def within_one_edit(prefix: str, query: str, half: int) -> bool:
    """Whether a word that goes on from `prefix` may be one edit from the query, whose first `half` letters it shares."""
    if len(prefix) <= half + 1:
        return True
    letters, _, lengths = flat_letters([query])
    band = tuple(np.array([v], np.int8) for v in (1, 0, 1))
    for depth in range(half, len(prefix)):
        band = step(band, np.uint32(ord(prefix[depth])), letters, np.array([min(depth, len(query) + 1)]), lengths, depth)
        if min(b[0] for b in band) > 1:
            return False
    return True


class Blocks:
    """Which blocks of a sorted list a query visits, from the (shortened) first and last words of the blocks."""

    def __init__(self, bounds: list[tuple[int, str, str]], told: int = BOUND_LETTERS) -> None:
        self.told = told
        self.numbers, self.first, self.last = (list(x) for x in zip(*bounds, strict=True)) if bounds else ([], [], [])
        self.shared = [os.path.commonprefix(b) for b in zip(self.first, self.last, strict=True)]

    def visited(self, query: str, half: int) -> list[int]:
        prefix = query[: min(half, self.told)]
        k = bisect_left(self.last, prefix)
        found = []
        while k < len(self.first) and self.first[k][: len(prefix)] <= prefix:
            if within_one_edit(self.shared[k], query, half):
                found.append(self.numbers[k])
            k += 1
        return found


def near_words(words: DataFrame) -> DataFrame:
    """(word, `n_near`, `best`) of the words of (word, n) that have near words; `best` holds the most frequent one (ties: the first)."""
    total = words.count()
    bits = BLOCK_BITS
    while total > MOST_BLOCKS << bits:
        bits += 1
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    listed = sides.select("side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("key"), "n")
    parts = max(1, min(2 * (total >> bits) + 1, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = listed.repartitionByRange(parts, "side", "key").sortWithinPartitions("side", "key")
    listed = stored(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits)))
    short = lambda c: F.substring(c, 1, BOUND_LETTERS)
    # At most one row per block: MOST_BLOCKS for either side, and one more per partition.
    bounds = listed.groupBy("side", "block").agg(F.min(short("key")).alias("first"), F.max(short("key")).alias("last")).orderBy("side", "first", "last", "block").collect()
    sent = words.sparkSession.sparkContext.broadcast([Blocks([(r["block"], r["first"], r["last"]) for r in bounds if r["side"] == side], BOUND_LETTERS) for side in (0, 1)])

    def route(batches):
        for batch in batches:
            of, block = [], []
            for k, (side, key) in enumerate(zip(batch.column("side").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                seen = sent.value[side].visited(key, half_of(side, len(key)))
                of.extend([k] * len(seen))
                block.extend(seen)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(of, pa.int64())) for c in ("side", "key", "n")] + [pa.array(block, pa.int64())], names=["side", "key", "n", "block"])

    asked = in_batches(listed.select("side", "key", "n"), route, "side int, key string, n long, block long").withColumn("asks", F.lit(True))
    met = listed.withColumn("asks", F.lit(False)).unionByName(asked).repartition("side", "block").sortWithinPartitions("side", "block", "asks", "key")
    found = in_batches(met, scan, "word string, n_near long, best_n long, best string")
    # Both sides, and the blocks of a long range, give parts of a word's answer.
    best = F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def scan(batches):
    """Blocks of words, each followed by its queries: per query and block the number of near words, and the best one."""
    at, held, words, counts = None, None, [], []
    for batch in batches:
        place = batch.column("block").to_numpy() * 2 + batch.column("side").to_numpy()
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((place[1:] != place[:-1]) | (asks[1:] != asks[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(place)], strict=True):
            if low == high:
                continue
            if place[low] != at:
                at, held, words, counts = place[low], None, [], []
            keys = batch.column("key").slice(low, high - low).to_pylist()
            if not asks[low]:
                words += keys
                counts += batch.column("n").slice(low, high - low).to_pylist()
                continue
            if held is None:
                held = SortedList(words), np.array(counts, np.int64), ranks(words, at % 2)
            for k in range(0, len(keys), TOGETHER):
                yield answers(*held, keys[k : k + TOGETHER], int(at % 2))


def ranks(words: list[str], side: int) -> np.ndarray:
    """The place of each word in the order of the words as they are written."""
    out = np.arange(len(words))
    if side:
        out[np.array(sorted(range(len(words)), key=lambda k: words[k][::-1]), np.int64)] = np.arange(len(words))
    return out


def answers(block: SortedList, counts: np.ndarray, rank: np.ndarray, queries: list[str], side: int) -> pa.RecordBatch:
    q, word = block.near(queries, [half_of(side, len(x)) for x in queries])
    turned = slice(None, None, -1) if side else slice(None)
    if side:
        # Pairs that share the first half too were found from the start.
        fresh = [queries[i][::-1][: len(queries[i]) // 2] != block.words[j][::-1][: len(queries[i]) // 2] for i, j in zip(q.tolist(), word.tolist(), strict=True)]
        q, word = q[fresh], word[fresh]
    order = np.lexsort((rank[word], -counts[word], q))
    q, word = q[order], word[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    near = np.diff(np.append(first, len(q)))
    best = word[first]
    return pa.RecordBatch.from_arrays(
        [pa.array([queries[i][turned] for i in q[first]], pa.string()), pa.array(near, pa.int64()), pa.array(counts[best], pa.int64()), pa.array([block.words[j][turned] for j in best], pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form): forms followed to the last one. Counts grow tenfold with each, so chains are short."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = stored(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR, divisor: int = DIVISOR
) -> DataFrame:
    """Per word of at least `least` letters and `least_count` occurrences: `word`, `form`, `root`, `n`, `n_near`, `form_n`.

    `form` is the most frequent word one edit away (ties: the first by code points) if it occurs at least `factor` times as often,
    else NULL; `root` is where the forms lead, or the word itself. `n_near` counts all words one edit away. NULL texts have no words; a NULL id
    counts as an empty one; repeated rows count again. An empty table gives no rows; other columns are not read.
    """
    words = stored(counted_words(docs, id_col, text_col, least, divisor).where(F.col("n") >= least_count))
    near = words.join(near_words(words), "word", "left")
    form_n = -F.col("best.minus_n")
    has = F.coalesce(form_n >= factor * F.col("n"), F.lit(False))
    named = stored(near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, form_n).alias("form_n")))
    led = named.join(roots(named.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The registered query over `documents`, for DuckDB: CRC-32 by its byte table, near words as words that agree where one letter is left out.
VARIANTS_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT) ORDER BY b) AS t FROM range(256) r(b)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), spelled AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(bytes) // 2), lambda k: ('0x' || substr(bytes, (2 * k + 1)::INT, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM spelled, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min((-n, other)) AS best FROM near GROUP BY word
), named AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form,
    CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END::BIGINT AS form_n
  FROM words w LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root, 0 AS steps FROM named
  UNION ALL SELECT led.word, named.form, steps + 1 FROM led JOIN named ON led.root = named.word WHERE named.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM named JOIN (SELECT word, max_by(root, steps) AS root FROM led GROUP BY word) USING (word)
"""
