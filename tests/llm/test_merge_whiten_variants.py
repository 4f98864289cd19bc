"""Exact dedup, whitening and spelling variants against brute force on small and hard tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import op11_tree_dedup, op12_whitening, op13_variants, queries
from tabsmith.llm.graph import first_by_hash
from tests.conftest import DATA
from tests.llm.helpers import docs, words


def _groups(rows, largest):
    """(id, keep_id, size, sha) per row, and how many rows each text keeps: one."""
    held = defaultdict(list)
    for i, t in rows:
        held[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in held[t or ""] if x is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((i, keep, len(held[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out), len(held)


def _dedup_rows():
    rng = random.Random(3)
    rows = [(n, f"text {rng.randint(0, 60)}") for n in range(300)] + [(1000 + n, "hot") for n in range(200)]
    # Repeated rows, shared ids, NULLs, empty texts, one very long text.
    rows += [(5, "hot"), (5, "hot"), (5, "only here"), (None, "hot"), (None, "nobody"), (None, "nobody"), (7, None), (8, ""), (9, "x" * 200_000), (10, "x" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("collide", [False, True])
def test_tree_dedup_equals_brute_force(spark, monkeypatch, largest, collide):
    if collide:
        # All texts share their key: only the verified digests tell them apart.
        monkeypatch.setattr(op11_tree_dedup, "digest_key", lambda t: F.length(F.lit("same")).cast("long"))
    rows = _dedup_rows()
    table = docs(spark, [(i, t, "en", "a") for i, t in rows]).repartition(7)
    out = op11_tree_dedup.exact_duplicates(table, largest=largest).collect()
    want, texts = _groups(rows, largest)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == texts == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_tree_dedup_many_levels_and_norms(spark, monkeypatch):
    monkeypatch.setattr(op11_tree_dedup, "SLOT_ENTRIES", 1)
    assert op11_tree_dedup.slot_digits(510) == 3
    rows = _dedup_rows()
    lower = [(i, t.upper() if t and i and i % 2 else t) for i, t in rows]
    out = op11_tree_dedup.exact_duplicates(docs(spark, [(i, t, "en", "a") for i, t in lower]), normal=F.lower).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == _groups(rows, False)[0]
    assert op11_tree_dedup.exact_duplicates(docs(spark, [])).count() == 0


def _whitened(x):
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, w = np.linalg.eigh(v)
    return e[::-1], (x - x.mean(0)) @ w[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), np.trace(v)


def test_whitening_equals_eigenvectors(spark):
    out = queries.op12_whitening_cholesky(spark, DATA).toPandas()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(table.embedding).astype(float) * 64) + 1_000_000
    e, z, trace = _whitened(x)
    assert len(out) == len(x) * 32 and (out.n == len(x)).all() and out.identity_error.max() < 1e-9
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    sign = np.sign((got * z[:, :32]).sum(0))
    assert np.allclose(got * sign, z[:, :32], atol=1e-7)
    share = out.drop_duplicates("component").set_index("component").explained
    assert np.allclose(share.loc[range(1, 33)], e[:32] / trace, rtol=1e-9)
    d = (len(x) * x.astype(int) - x.astype(int).sum(0)).astype(object)
    exact = dict(zip(table.vec_id, (d * d).sum(1), strict=True))
    assert all(exact[i] == v for i, v in out.drop_duplicates("vec_id")[["vec_id", "deviation"]].itertuples(index=False))


def test_whitening_of_bad_and_flat_vectors(spark):
    rng = np.random.default_rng(4)
    # Two dimensions agree and one is constant: two components are left; scales differ by a factor of 10,000.
    base = rng.normal(size=(400, 2)) * [1000, 0.1]
    rows = [(n, [float(a), float(a), float(b), 2.5]) for n, (a, b) in enumerate(base)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [float("nan"), 1.0, 1.0, 1.0]), (903, [float("inf"), 1.0, 1.0, 1.0]), (904, [1.0]), (905, []), (906, [1e30, 1.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>, component string, n string, v string, id string"

    def table(rows):
        return spark.createDataFrame([(i, v, "c", "n", "v", "i") for i, v in rows], schema)

    out = op12_whitening.whiten(table(rows + bad + [rows[0], (None, rows[1][1])])).toPandas()
    assert set(out.vec_id.dropna()) == set(range(400)) and set(out.component) == {1, 2} and len(out) == 402 * 2
    assert out.identity_error.max() < 1e-4 and (out.n == 402).all() and abs(out.drop_duplicates("component").explained.sum() - 1) < 1e-6
    x = np.floor(np.array([v for _, v in [*rows, rows[0], rows[1]]]) * 64)
    e, z, _ = _whitened(x)
    first = out[(out.component == 1) & out.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id").whitened.to_numpy()
    assert np.allclose(np.abs(first), np.abs(z[:400, 0]), atol=1e-6)
    for few in ([], [rows[0]], [rows[0]] * 5, bad):
        assert op12_whitening.whiten(table(few)).count() == 0


def test_triangular_solves_and_shifts():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 6)) @ np.diag(10.0 ** -np.arange(0, 12, 2))
    r = op12_whitening.triangle(a.T @ a, 50, True)
    assert np.allclose(op12_whitening.solve_rows(a, r) @ r, a) and np.allclose(r, np.triu(r))
    assert np.isfinite(op12_whitening.triangle(np.diag([1.0, 0.0]), 2, False)).all()


def _edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(rows, least=7, divisor=31):
    found = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % divisor == 0 else run] += 1
            run = ""
    found = {w: n for w, n in found.items() if len(w) >= least and n >= 2}
    out = {}
    for w, n in found.items():
        near = [v for v in found if _edit_one(w, v)]
        best = min(near, key=lambda v: (-found[v], v), default=None)
        out[w] = [best if best and found[best] >= 10 * n else None, None, n, len(near)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: (*v, found[v[0]] if v[0] else None) for w, v in out.items()}


def _variant_rows():
    rng = random.Random(8)
    common = ["abcdefgh", "aaaaaaaa", "élèvesñabc", "zyxwvut", "abcdefghijklmnop"]
    rows = [(n, " ".join([*common * 12, words(30, n)])) for n in range(12)]
    for n in range(60):
        w = rng.choice(common)
        k = rng.randrange(len(w))
        v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aéz") + w[k:], w[:k] + rng.choice("aéz") + w[k + 1 :], w.upper()])
        rows.append((100 + n, f"{v} {v}\n{v}9{v}"))
    chain = ["qqqqqqq"] * 2 + ["qqqqqqqr"] * 20 + ["qqqqqqrr"] * 300
    return rows + [(500, " ".join(chain)), (500, "repeated repeated"), (500, "repeated repeated"), (None, "nobodys nobodys"), (501, None), (502, ""), (503, "Y" * 3000 + " " + "Y" * 3000 + " " + "Y" * 2999 + " " + "Y" * 2999)]


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:
        # Many blocks, bounds told in part, few words held and few queries at once.
        for name, value in {"BLOCK_BITS": 3, "BOUND_LETTERS": 5, "HELD_WORDS": 10, "TOGETHER": 3}.items():
            monkeypatch.setattr(op13_variants, name, value)
    rows = _variant_rows()
    out = op13_variants.spelling_variants(docs(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == _variants(rows)
    assert {r.word: r.root for r in out}["qqqqqqq"] == "qqqqqqrr"


def test_variants_of_nothing(spark):
    assert op13_variants.spelling_variants(docs(spark, [])).count() == 0
    assert op13_variants.spelling_variants(docs(spark, [(1, "short words only", "en", "a"), (2, None, None, None)])).count() == 0


@pytest.mark.parametrize("side", [0, 1])
def test_blocks_lose_no_word(side):
    rng = random.Random(2)
    found = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(1500)})
    cut = [found[k : k + 16] for k in range(0, len(found), 16)]
    blocks = op13_variants.Blocks([(n, b[0], b[-1]) for n, b in enumerate(cut)])
    total = 0
    for w in rng.sample(found, 200):
        half = op13_variants.half_of(side, len(w))
        near = [v for v in found if _edit_one(w, v) and v[:half] == w[:half]]
        got = []
        for n in blocks.visited(w, half):
            q, v = op13_variants.SortedList(cut[n]).near([w], [half])
            got += [cut[n][k] for k in v]
        assert sorted(got) == near
        total += len(near)
    assert total > 100


def test_first_by_hash_is_the_sorted_start(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 < 2, 'hot', concat('g', id % 7)) as lang")
    rows = rows.union(rows.where("id % 2 = 0")).union(spark.range(50_000).selectExpr("7L", "'hot'"))
    got = {tuple(r) for r in first_by_hash(rows, "lang", 40).collect()}
    by = defaultdict(set)
    for r in rows.distinct().selectExpr("id", "lang", "xxhash64(id) as h").collect():
        by[r.lang].add((r.h, r.id))
    assert got == {(i, g) for g, found in by.items() for _, i in sorted(found)[:40]}
    assert first_by_hash(rows.limit(0), "lang", 40).count() == 0
