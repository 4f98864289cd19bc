"""Languages, toxicity, repetition, URLs, mixing, nearest neighbours and the pipeline on small and hard tables."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import op1_multi_index, op4_toxicity, op6_mixing, op7_urls, op8_language, op9_repetition, queries
from tests.conftest import DATA
from tests.llm.helpers import docs, words

HARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n 12 34", "en", "a"), (None, "no id here", "en", "a"), (4, "twice", "en", "b"), (4, "twice", "en", "b")]


def test_language_tables_are_exact_distributions():
    text = b"the cat and the hat, the dog and the log " * 20
    symbol = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    padded = np.concatenate([[0, 0, 0], symbol])
    gram = padded[:-3] * 257**3 + padded[1:-2] * 257**2 + padded[2:-1] * 257 + padded[3:]
    found, times = np.unique(gram, return_counts=True)
    tables = op8_language.LanguageModel(["xx"], np.zeros(len(found), np.int64), found, times.astype(float), 2).tables()
    probability = np.exp2(-tables.bits.reshape(-1, tables.size))
    shared = 257 - (tables.size - 1)  # bytes of the shared number
    total = probability[1:, 1:-1].sum(1) + probability[1:, -1] * shared
    assert np.allclose(total[probability[1:, 0] < 1e-9], 1, atol=1e-4)
    data = np.frombuffer(text + b"" + b"zebra", np.uint8)
    starts = np.array([0, len(text), len(text), len(data)])
    bits = tables.code_lengths(data, starts)
    assert bits[1, 0] == 0 and bits[0, 0] / len(text) < 1 < bits[2, 0] / 5
    alone = [tables.code_lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0, 0] for t in (text, b"zebra")]
    assert np.allclose(bits[[0, 2], 0], alone)


def test_languages_held_out_and_hard_rows(spark):
    out = queries.op8_language_ppm(spark, DATA).toPandas()
    table = duckdb.sql(f"select doc_id, lang from '{DATA}/documents.parquet'").df()
    seen = out.merge(table, on="doc_id")
    assert len(seen) == len(table)
    assert (seen.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in seen.doc_id]).all()
    held = seen[seen.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op8_language.train(base)
    rows = {r.doc_id: r for r in op8_language.identify(docs(spark, HARD), model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred in model.languages
    table = docs(spark, HARD)
    assert op8_language.keep_languages(table, model).columns == table.columns
    assert op8_language.identify(docs(spark, []), model).count() == 0
    none = op8_language.train(docs(spark, [(1, "text", None, None)]))
    assert {r.lang_pred for r in op8_language.identify(docs(spark, HARD), none).collect()} == {"und"}


def test_toxicity_held_out_and_hard_rows(spark):
    out = queries.op4_toxicity_nb(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").df()
    seen = out.merge(labels, on="doc_id")
    held = seen[seen.held_out]
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.2
    table = docs(spark, [(n, words(30, n) + (" vile" if n % 2 else ""), "en", "a") for n in range(60)] + HARD)
    known = spark.createDataFrame([(n, n % 2) for n in range(5, 60)] + [(None, 1), (999, 0), (6, None)], "doc_id long, toxic int")
    model = op4_toxicity.train(table, known)
    rows = op4_toxicity.score(table, model).collect()
    assert len(rows) == 66 and all(r.predicted == (r.doc_id or 0) % 2 for r in rows[10:60])
    assert op4_toxicity.score(docs(spark, []), model).count() == 0
    one = op4_toxicity.train(table, known.where("toxic = 0"))
    assert {r.predicted for r in op4_toxicity.score(table, one).collect()} == {0}
    nothing = op4_toxicity.train(table, known.where("toxic = 7"))
    assert {r.score for r in op4_toxicity.score(table, nothing).collect()} == {0.5}


def test_grams_over_block_edges(monkeypatch):
    letters = op4_toxicity.letters_of(words(300, 1).encode())
    whole = Counter(op4_toxicity.gram_numbers(letters).tolist())
    monkeypatch.setattr(op4_toxicity, "BLOCK", 37)
    assert Counter(op4_toxicity.gram_numbers(letters).tolist()) == whole
    assert sum(whole.values()) == sum(len(letters) - n + 1 for n in op4_toxicity.GRAMS)


def _longest(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_suffix_arrays_equal_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        texts = [[rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.choice([0, 1, 2, 5, 20, 40]))] for _ in range(5)]
        got = op9_repetition.longest_repeats(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
        assert got.tolist() == sum(map(_longest, texts), [])


def test_repetition_rules(spark):
    plain, repeated = words(200, 1, 5000), " ".join([words(20, 2, 5000)] * 10)
    once = words(200, 3, 5000)
    rows = [*HARD, (10, plain, "en", "a"), (11, repeated, "en", "a"), (12, "a b c\n\na b c\n a b c\nx # <é>", "en", "a"), (13, f"{once} {words(300, 4, 9000)} {once}", "en", "a")]
    out = {r.doc_id: r for r in op9_repetition.repetition(docs(spark, rows)).collect()}
    assert out[10].kept and out[10].longest_repeat < 4
    assert out[11].base_failed and out[11].n_repeat_words == 200 and out[11].repeat_fraction == 1
    small = out[12]
    assert (small.n_words, small.word_chars, small.n_symbols, small.n_dup_lines, small.n_repeat_words) == (12, 14, 3, 1, 9)
    # A text that holds one long passage twice passes no base rule's eye but the method's.
    assert out[13].longest_repeat == 200 and not out[13].kept
    assert (out[1].n_words, out[1].base_failed, out[1].kept) == (0, True, False)
    assert op9_repetition.repetition(docs(spark, [])).count() == 0


def test_url_rules_and_classifier(spark):
    urls = ["https://A.Example.COM/en/x?q", "http://www.example.com/en/1", "http://x.net/es/", "http://xnet/es/", "http://a.com", "ftp://com/", "no scheme", None, "http://h.org#/en/", "x://://y", "http://é.ORG/ä/" + "a" * 5000]
    pages = spark.createDataFrame([(n, u, "h") for n, u in enumerate(urls)] + [(None, "http://x.net/fr/", "h")], "page_id long, url string, host string")
    out = {r.page_id: r for r in op7_urls.judge(pages, queries.URL_RULES).collect()}
    assert [out[n].rule for n in range(6)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/"]
    assert [(out[n].host, out[n].path) for n in (0, 4, 6, 7, 8, 9)] == [("a.example.com", "/en/x"), ("a.com", ""), ("", ""), ("", ""), ("h.org", ""), (":", "//y")]
    assert out[None].verdict == "block" and all(r.verdict in ("allow", "block") for r in out.values())
    labelled = spark.createDataFrame([(f"site{n}.{'bad' if n % 2 else 'good'}.org", "/p/", n % 2) for n in range(60)], "host string, path string, label int")
    fresh = spark.createDataFrame([(n, f"http://new{n}.{'bad' if n % 2 else 'good'}.org/p/{n}") for n in range(20)], "page_id long, url string")
    judged = op7_urls.judge(fresh, [], labelled).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") and r.rule is None for r in judged)
    nothing = op7_urls.judge(fresh, [], labelled.where("label = 1")).collect()
    assert {r.verdict for r in nothing} == {"allow"}
    assert op7_urls.judge(fresh.limit(0), queries.URL_RULES).count() == 0


def test_url_classifier_tells_hosts_apart_not_endings(spark):
    endings, languages = ("com", "net", "org"), ("en", "de", "fr", "es")
    # Names that the labelled table does not hold.
    plain, unwanted = ["m.ththen", "www.therin", "tionble", "blog.thther", "bakery"], ["casino-win", "www.free-bets", "m.cheap-pills", "ads-track", "spam-farm", "blog.adult-x"]
    urls = [(f"https://{name}.example.{e}/{x}/{n}31.html", name in unwanted) for n, name in enumerate(plain + unwanted) for e in endings for x in languages]
    pages = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(urls)], "page_id long, url string")
    out = op7_urls.judge(pages, queries.URL_RULES).where("rule is null").collect()
    assert {urls[r.page_id][1] for r in out} == {False, True} and all(r.block_score is not None for r in out)
    assert [urls[r.page_id][0] for r in out if (r.verdict == "block") != urls[r.page_id][1]] == []


def test_mix_on_hard_rows(spark):
    rows = [*HARD, *[(100 + n, words(n % 40, n), "en", "abc"[n % 3]) for n in range(90)], *[(300 + n, words(5, n), "en", None) for n in range(4)]]
    table = docs(spark, rows)
    out = op6_mixing.mix(table, buckets=8).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    for _, part in out.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1e-6
        assert part.target.iloc[0] <= 3 * part.source_size.iloc[0]
    assert out.groupby("source", dropna=False).target.first().sum() == pytest.approx(out["size"].sum())
    again = op6_mixing.mix(table.repartition(5), buckets=64).toPandas()
    order = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[order].values.tolist())) == sorted(map(str, again[order].values.tolist()))
    left = op6_mixing.mixed_documents(table)
    assert left.columns == table.columns and left.count() == out.copies.sum()
    assert op6_mixing.mix(docs(spark, [])).count() == 0


def test_mix_of_many_equal_rows(spark, tmp_path):
    rows = [(7, words(50, 1), "en", "a")] * 400 + [(100 + n, words(20, n), "en", "b") for n in range(300)] + [(None, words(9, n), "en", "c") for n in range(200)]
    table = docs(spark, rows).repartition(6)
    out = op6_mixing.mix(table, buckets=16).toPandas()
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1e-6
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    left = op6_mixing.mixed_documents(table)
    assert left.columns == table.columns and left.count() == out.copies.sum()
    # The same in SQL; more than one stretch of places.
    table.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(op6_mixing.MIX_SQL).df()
    order = ["size", "source_size", "taken"]
    assert sorted(out[order].values.tolist()) == sorted(want[order].values.tolist())


def test_mix_equals_sql(spark):
    got = queries.op6_mixing_es(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op6_mixing_es"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got[sorted(got)].equals(want[sorted(want)].astype(got.dtypes.to_dict())[sorted(got)])


def test_nearest_recall_and_hard_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    x[100:160] = x[100]  # a hot vector
    rows = [(n, v.tolist()) for n, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [1.0, None] + [0.0] * 14), (4060, [float("nan")] * 16), (4080, [1.0] * 3), (None, [1.0] * 16), (4100, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, i int")
    out = op1_multi_index.search(table, F.col("id") % 20 == 0, k=20).toPandas()
    found = exact = 0
    for q, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        found, exact = found + len(set(best) & set(part.vec_id)), exact + 20
        assert part["rank"].tolist() == list(range(1, 21))
        assert np.allclose(part.score, s[part.vec_id], rtol=0, atol=1e-12)
        assert sorted(zip(-part.score, part.vec_id, strict=True)) == list(zip(-part.score, part.vec_id, strict=True))
    assert out.query_id.nunique() == 150 and found / exact > 0.9
    hot = out[out.query_id == 100].sort_values("rank")
    assert hot.vec_id.tolist() == list(range(101, 121))
    few = op1_multi_index.search(table.where("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0).collect()
    assert [r.vec_id for r in few] == sorted([1, 2], key=lambda n: -x[n] @ x[0])
    assert op1_multi_index.search(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    index = op1_multi_index.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)), 1.0)
    q = rng.normal(size=8)
    sums = [float(index.first[i] @ q[:4] + index.second[j] @ q[4:]) for i, j in index.walk(q)]
    assert len(sums) == 30 and sums == sorted(sums, reverse=True)


def test_index_turns_without_loss_and_bands_hold_all():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 7, 8):
        x = rng.normal(size=(300, dim)) * rng.uniform(0.1, 3, dim)
        index = op1_multi_index.fit(x, 6)
        assert np.allclose(index.turned(x) @ index.turned(x).T, x @ x.T)
        i, j = index.cells(x)
        counts = np.zeros((len(index.first), len(index.second)), np.int64)
        np.add.at(counts, (i, j), 1)
        assert len(list(index.walk(x[0]))) == counts.size and index.visited(x[0], counts, len(x)).sum() <= counts.size
        best = [np.argsort(-(x @ q))[:10] for q in x[:40]]
        cells = [list(zip(i[b].tolist(), j[b].tolist(), strict=True)) for b in best]
        share = op1_multi_index.share_needed(index, counts, x[:40], cells, 0.9)
        opened = [index.visited(q, counts, share * len(x)) for q in x[:40]]
        assert 0 < share <= 1 and np.mean([o[i[b], j[b]].mean() for o, b in zip(opened, best, strict=True)]) >= 0.9
        starts = op1_multi_index.bands(counts.sum(1), 50)
        parts = np.split(counts.sum(1), starts[1:-1])
        assert starts[-1] == len(counts) and sum(p.sum() for p in parts) == len(x) and all(len(p) == 1 or p.sum() <= 50 for p in parts)


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    before = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == table.columns
        before = spark.createDataFrame(after.toPandas(), table.schema)
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA).toPandas()
    assert set(packed.doc_id) == ids
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    run = corpus_pipeline.run(spark, DATA).toPandas()
    order = ["doc_id", "start", "ids_crc32", "length"]
    assert run[order].sort_values(order).reset_index(drop=True).equals(packed[order].sort_values(order).reset_index(drop=True))
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
