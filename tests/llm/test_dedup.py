"""Near copies against brute force; repeated passages against planted ones."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabsmith.llm import common, op3_neardup, op5_substrings
from tests.llm.helpers import docs, words


def _similar(a, b):
    def bag(t):
        w = t.split()
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    shared = sum((x & y).values())
    return shared * 5 >= (sum(x.values()) + sum(y.values()) - shared) * 4


def _classes(rows):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    full = [(i, t) for i, t in rows if t and t.split()]
    for n, (i, a) in enumerate(full):
        for j, b in full[:n]:
            if _similar(a, b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def _edited(text, share, seed):
    rng = random.Random(seed)
    w = text.split()
    for k in rng.sample(range(len(w)), int(share * len(w))):
        w[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        e = rng.integers(0, 2**63, 150).astype(np.uint64)
        a = rng.integers(0, 7, 150)
        b = np.where(rng.random(150) < 0.7, a, rng.integers(0, 7, 150))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        e2 = np.concatenate([e[a > 0], e[b > 0]])
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = op3_neardup.bag_signatures(e2, np.concatenate([a[a > 0], b[b > 0]]), owner, 2, 512)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_classes_equal_brute_force(spark):
    base = [words(n, n) for n in (3, 5, 8, 40, 80, 200, 400)]
    rows = []
    for text in base:
        rows += [(len(rows) + k, t) for k, t in enumerate([text, text, text + "  ", *[_edited(text, 0.02, s) for s in range(6)], *[_edited(text, 0.05, s) for s in range(4)]])]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "aa " * 300), (906, "aa " * 290), (907, "aa " * 100)]
    table = docs(spark, [(i, t, "en", "hot") for i, t in rows] + [(None, base[3], None, None)])
    out = {r.doc_id: r for r in op3_neardup.near_duplicates(table).collect()}
    expected = _classes(rows)
    assert {i: out[i].class_id for i in expected} == expected
    sizes = Counter(expected.values())
    assert all(out[i].class_size == sizes[c] for i, c in expected.items())
    assert out[None].class_id is None
    kept = {r.doc_id for r in op3_neardup.one_of_each(table).select("doc_id").collect()}
    assert kept == set(expected.values()) | {None}
    assert op3_neardup.near_duplicates(docs(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    base = words(60, 41)
    rows = [(1, words(50, 40)), (1, base), (2, _edited(base, 0.02, 1)), (2, words(50, 42)), (3, words(50, 40)), (3, words(50, 40))]
    for order in (rows, rows[::-1]):
        out = op3_neardup.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in order])).collect()
        # Two classes of texts around id 1, and one text alone.
        assert sorted((r.doc_id, r.class_id, r.class_size) for r in out) == [(1, 1, 2), (1, 1, 3), (2, 1, 2), (2, 2, 1), (3, 1, 3), (3, 1, 3)]
        left = op3_neardup.one_of_each(docs(spark, [(i, t, "en", "a") for i, t in order])).collect()
        assert sorted((r.doc_id, r.text) for r in left) == sorted([rows[0], rows[1], rows[3]])


def test_template_copies_are_not_squared(spark, monkeypatch):
    monkeypatch.setattr(op3_neardup, "BLOCK_DOCUMENTS", 50)
    groups = []
    real = op3_neardup.met_in_groups
    monkeypatch.setattr(op3_neardup, "met_in_groups", lambda met, label: groups.append(met.select(label, "low", "high").distinct().count()) or real(met, label))
    center = words(80, 9)
    rows = [(n, _edited(center, 0.02, n)) for n in range(1000)]
    out = {r.doc_id: r.class_id for r in op3_neardup.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert set(out.values()) == {0}
    # 20 blocks: one group each with block 0, and none of the 190 others.
    assert groups[0] <= 20 and sum(groups[1:]) <= 20


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op3_neardup, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(op3_neardup, "COLUMNS", 16)
    # A chain: neighbours are similar, the ends are not, and all share long parts.
    base = words(120, 5).split()
    rows = []
    for n in range(40):
        base[3 * n % 120] = f"step{n}"
        rows.append((n, " ".join(base)))
    # And a group of copies around one text, of which some are similar to each other and some to none.
    center = words(120, 6)
    rows += [(100 + n, _edited(center, (0.01, 0.02, 0.05)[n % 3], n)) for n in range(60)]
    out = {r.doc_id: r.class_id for r in op3_neardup.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert out == _classes(rows)


def test_blocks_are_bounded_by_documents(spark, monkeypatch):
    # Many short texts: few shingles, but as many array rows as texts.
    sizes = spark.range(10_500).selectExpr("1L label", "26L size").union(spark.range(3).selectExpr("2L", "100000L"))
    assert {r.label: r.blocks for r in op3_neardup.blocks_of(sizes).collect()} == {1: 11, 2: 3}
    monkeypatch.setattr(op3_neardup, "BLOCK_DOCUMENTS", 10)
    center = words(30, 8)
    rows = [(n, _edited(center, 0.034, n)) for n in range(60)]
    out = {r.doc_id: r.class_id for r in op3_neardup.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert out == _classes(rows)


def test_cuts_resist_insertions():
    text = words(400, 9).encode()

    def parts(t):
        ends = op5_substrings.cuts(t, op5_substrings.candidates(np.frombuffer(t, np.uint8)).tolist())
        assert ends[-1] == len(t)
        return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    assert b"".join(parts(text)) == text
    shifted = parts(b"inserted " + text)
    assert len(set(parts(text)) & set(shifted)) > 0.9 * len(set(shifted)) - 3
    long_line = ("é" * 3000).encode()
    assert all(x.decode() for x in parts(long_line))


def test_passages_leave_all_but_the_first(spark):
    passage = words(60, 77)
    rows = [(n, f"{words(50, 100 + n)} {passage} {words(50, 200 + n)}", "en", "a") for n in range(5)]
    rows += [(50, words(300, 300), "en", "a"), (51, None, None, None), (52, "", None, None), (53, passage + " " + passage, None, None), (None, passage, None, None)]
    table = docs(spark, rows)
    out = {r.doc_id: r for r in op5_substrings.remove_repeats(table).collect()}
    original = {i: t for i, t, _, _ in rows}
    assert out[0].text == original[0] and out[50].text == original[50] and out[None].text == passage
    assert out[51].text is None and out[52].text == ""
    for n in (1, 2, 3, 4, 53):
        assert out[n].removed_words >= 30 and out[n].first_ids[0] == 0
        raw = original[n].encode()
        cut = b"".join(raw[a:b] for a, b in zip([0, *[s.high for s in out[n].spans]], [*[s.low for s in out[n].spans], len(raw)], strict=True))
        assert cut.decode() == out[n].text
        assert set(out[n].text.split()) <= set(original[n].split())
    left = op5_substrings.without_repeats(table)
    assert left.columns == table.columns and left.count() == len(rows)
    assert op5_substrings.remove_repeats(docs(spark, [])).count() == 0


def _left(rows, hashes):
    """Rows (id, text) without repeated runs, by plain loops over the chunks of all texts in order."""
    parts = {}
    for k, (i, text) in enumerate(rows):
        data = text.encode()
        ends = op5_substrings.cuts(data, op5_substrings.candidates(np.frombuffer(data, np.uint8)).tolist())
        parts[i, hashes[k]] = data, ends, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    seen, out = set(), {}
    for key in sorted(parts):
        data, ends, chunks = parts[key]
        again = []
        for place, chunk in enumerate(chunks):
            if chunk in seen:
                again.append({"place": place, "first": 0})
            seen.add(chunk)
        out[key] = op5_substrings.cut_out(data, ends, again, op5_substrings.RUN_WORDS)[0].decode()
    return [out[i, hashes[k]] for k, (i, _) in enumerate(rows)]


def test_repeats_equal_brute_force_with_shared_ids(spark):
    shared = [words(40, 900 + k) for k in range(3)]
    unique = [words(60, 950 + k) for k in range(4)]
    rows = [(1, shared[0]), (5, shared[0]), (5, unique[0]), (5, f"{unique[1]} {shared[1]} tail"), (6, f"{shared[1]} {unique[2]} {shared[1]}"), (6, shared[2]), (2, f"{unique[3]}\n{unique[3]}"), (7, f"é {shared[2]}")]
    for order in (rows, rows[::-1]):
        table = docs(spark, [(i, t, "en", "a") for i, t in order])
        hashes = [r[0] for r in table.selectExpr("xxhash64(text)").collect()]
        got = sorted((r.doc_id, r.text) for r in op5_substrings.remove_repeats(table).collect())
        assert got == sorted((i, t) for (i, _), t in zip(order, _left(order, hashes), strict=True))
        left = " ".join(t for _, t in got)
        # What is found nowhere else stays, once.
        assert all(u in left for u in unique) and (5, unique[0]) in got


def test_whole_copies_go_in_the_stage(spark):
    text = words(100, 4)
    left = op5_substrings.without_repeats(docs(spark, [(1, text, "en", "a"), (2, text, "en", "a")])).collect()
    assert [r.doc_id for r in left] == [1]


def peak_mb(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def test_short_texts_are_signed_in_bounded_memory():
    rng = np.random.default_rng(4)
    texts, mass = 5000, 20
    elements = rng.integers(0, 1 << 63, texts * mass).astype(np.uint64)
    weights = rng.integers(1, 4, texts * mass)
    owner = np.repeat(np.arange(texts), mass)
    signed, peak = peak_mb(lambda: op3_neardup.bag_signatures(elements, weights, owner, texts, 140))
    assert peak < 100
    own = slice(0, mass)
    assert (op3_neardup.bag_signatures(elements[own], weights[own], owner[own], 1, 140) == signed[:1]).all()


def test_blocks_meet_in_bounded_memory():
    rng = np.random.default_rng(5)
    near = rng.integers(-(1 << 62), 1 << 62, 50)
    sets = [np.append(near, k) if k % 3 == 0 else rng.integers(-(1 << 62), 1 << 62, 50) for k in range(2000)]
    first, peak = peak_mb(lambda: op3_neardup.linked_groups(sets, np.zeros(len(sets), bool)))
    assert peak < 100
    assert first.tolist() == [0 if k % 3 == 0 else k for k in range(2000)]


def test_a_worker_keeps_one_large_thing(spark):
    assert common.resident("a", lambda: [1]) is common.resident("a", lambda: [2])
    assert common.resident("b", lambda: list(common._RESIDENT)) == []
    common.free_resident()

    def held(batches):
        for batch in batches:
            common.resident("tables", list)
            yield batch

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._RESIDENT)] * batch.num_rows, pa.int64())], names=["id"])

    rows = spark.range(100, numPartitions=16)
    assert common.in_batches(rows, held, "id long", keeps=True).count() == 100
    assert common.in_batches(rows, left, "id long").agg(F.max("id")).first()[0] == 0
