"""Language-model scores, whitening and hard negatives against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscore.llm import lm, negatives, queries, whitening

SMALL = "/root/testdata/sf0.001"


def _words(text):
    return (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return lm.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0))


def _aside(key):
    return zlib.crc32(str(key).encode()) % 10 == 0


def test_base_scores_and_counts(spark, texts):
    found = {r.doc_id: r for r in queries.op11_lm_scores(spark, SMALL).collect()}
    count = Counter(w for k, t in texts.items() if not _aside(k) for w in [*_words(t), None])
    n, v = sum(count.values()), len(count)
    assert found.keys() == texts.keys()
    for k, t in texts.items():
        tokens = [*_words(t), None]
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (_aside(k), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score < 0
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _plain_score(model, counts, text):
    """Token by token: a softmax over all symbols, times a word's share of those that look alike."""
    w, total, before = model.weights, 0.0, [0, 0]
    for token in [*_words(text), None]:
        symbol = 0 if token is None else model.own.get(token) or 768 + zlib.crc32(token[-3:]) % 256
        h = w.seen[before[0]] * w.place[0] + w.seen[before[1]] * w.place[1]
        z = (w.asked @ h + w.bias).astype(np.float64)
        total += z[symbol] - np.log(np.exp(z).sum())
        if symbol >= 768:
            alike = [n for word, n in counts.items() if word not in model.own and zlib.crc32(word[-3:]) % 256 == symbol - 768]
            total += math.log((counts.get(token, 0) + 0.1) / (sum(alike) + 0.1 * (len(alike) + 1)))
        before = [symbol, before[0]]
    return total / math.log(10)


def test_scores_are_those_of_a_plain_version(spark, texts, trained):
    counts = {bytes(r.word): r.n for r in trained.counts.collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.score for r in lm.score(docs, trained).collect()}
    short = sorted(texts, key=lambda k: (len(texts[k] or ""), k))[:25]
    for k in short:
        assert found[k] == pytest.approx(_plain_score(trained, counts, texts[k]), rel=1e-4)


def test_words_beyond_the_frequent_ones_are_looked_up(spark, trained, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    few = dict(list(trained.frequent.items())[:50])
    few |= {w: trained.frequent[w] for w in trained.own}
    whole, part = ({r.doc_id: r for r in lm.score(docs, m).collect()} for m in (trained, replace(trained, frequent=few)))
    for k, r in whole.items():
        assert (part[k].n_tokens, part[k].n_known) == (r.n_tokens, r.n_known)
        assert (part[k].base_score, part[k].score) == (pytest.approx(r.base_score), pytest.approx(r.score))
    monkeypatch.setattr(lm, "FREQUENT", 40)
    again = lm.fit(docs.where("doc_id % 2 = 0"), rounds=0)
    assert len(again.frequent) == len(again.own) == lm.OWN  # those of FREQUENT words that aren't symbols are none


def test_probabilities_add_up(trained):
    before = np.array([[0, 0], [5, 9], [900, 3]])
    for b in before:
        every = trained.weights.log_probabilities(np.arange(1024), np.tile(b, (1024, 1)))
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    assert trained.share().sum() == pytest.approx(1) and trained.tokens == trained.shape_tokens.sum() + sum(trained.frequent[w] for w in trained.own) + trained.ends


def test_steps_follow_the_slope_of_the_noise_contrastive_objective():
    rng = np.random.default_rng(3)
    k = 1 + lm.OWN + lm.SHAPES
    share = rng.random(k)
    share /= share.sum()
    start = lm.Weights.start(share)
    symbols, before = rng.integers(0, 50, 40).astype(np.int32), rng.integers(0, 50, (40, 2)).astype(np.int32)
    noise = np.searchsorted(np.cumsum(share), np.random.default_rng(8).random(lm.NOISE))

    def objective(flat):
        seen, asked, bias, place = (p.astype(np.float64) for p in lm.Weights.from_flat(flat).parts())
        h = seen[before[:, 0]] * place[0] + seen[before[:, 1]] * place[1]
        real = (h * asked[symbols]).sum(1) + bias[symbols] - np.log(lm.NOISE * share[symbols])
        fake = h @ asked[noise].T + bias[noise] - np.log(lm.NOISE * share[noise])
        return -np.log1p(np.exp(-real)).sum() - np.log1p(np.exp(fake)).sum()

    trainer = lm._Trainer(start, share, 0.05, 8)
    trainer.step(symbols, before)
    old = start.flat().astype(np.float64)
    moved = trainer.weights.flat() - old
    for at in [*rng.choice(50 * lm.WIDTH, 10), *(k * lm.WIDTH + rng.choice(50 * lm.WIDTH, 10)), *(2 * k * lm.WIDTH + rng.choice(50, 5)), len(old) - 1, len(old) - 30]:
        up, down = old.copy(), old.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (objective(up) - objective(down)) / 2e-2
        assert moved[at] == pytest.approx(0.05 * slope / math.sqrt(1e-2 + slope**2), abs=2e-3)


def test_odd_texts_are_scored(spark):
    long = "w" * 3000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a B\x0bc", "x"), (3, "a b c", "x"), (3, "a b c", "x"), (4, f"{long} {long} é é", "x"), (5, "a b " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("row", F.lit(7))
    model = lm.fit(df)
    assert model.tokens == sum(len(_words(t)) + 1 for _, t, _ in rows) and model.ends == len(rows)
    found = lm.score(df, model)
    assert found.columns == ["doc_id", "row", "n_tokens", "n_known", "base_score", "score"]
    got = found.collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(_words(t)) + 1 for _, t, _ in rows) and all(r.n_known == r.n_tokens and r["row"] == 7 for r in got)
    one, two = (r for r in got if r.doc_id == 3)
    assert one == two and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].base_score == pytest.approx(by[3].base_score)
    count = Counter(w for _, t, _ in rows for w in [*_words(t), None])
    n, v = sum(count.values()), len(count)
    assert by[4].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*_words(rows[5][1]), None]))
    assert lm.score(df.limit(0), model).count() == 0
    none = lm.score(df, lm.fit(df.limit(0))).collect()
    assert all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in none)  # 0.1 / (0 + 0.1): all that is unseen


def test_whitening_is_that_of_a_plain_version(spark):
    found = queries.op12_whitening(spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(rows.embedding).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    plain = centred @ vectors / np.sqrt(values)
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert got == pytest.approx(plain * np.sign((plain * got).sum(0)), abs=1e-8)
    by = found.groupby("vec_id").deviation.first().loc[rows.vec_id]
    assert (by.to_numpy() == ((n * x - s) ** 2).sum(1)).all() and set(found.n) == {n}
    assert found.groupby("component").explained.first().to_numpy() == pytest.approx(values / np.trace(centred.T @ centred / n), rel=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-9


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (7, 3), (12, 12), (33, 20)])
def test_factor_and_rotations(d, rank):
    x = np.random.default_rng(d).normal(size=(rank, d)) * np.logspace(0, 4, d)
    a = x.T @ x
    factor, order = whitening.pivoted_cholesky(a)
    assert factor.shape == (d, rank) and np.allclose(np.triu(factor, 1), 0)
    assert factor @ factor.T == pytest.approx(a[order][:, order], rel=1e-9, abs=1e-9 * a.max())
    turned = whitening.one_sided_jacobi(factor)
    norms = np.sqrt((turned**2).sum(0))
    assert np.abs(turned.T @ turned / np.outer(norms, norms) - np.eye(rank)).max() < 1e-13
    assert np.sort(norms**2) == pytest.approx(np.linalg.eigvalsh(a)[-rank:], rel=1e-9, abs=1e-14 * a.max())  # its small ones are the less exact
    assert whitening.pivoted_cholesky(np.zeros((d, d)))[0].shape == (d, 0)


def test_odd_vectors_are_whitened(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [*rng.normal(size=3).tolist(), 0.5]) for k in range(40)]
    odd = [(0, rows[3][1]), (None, rows[4][1]), (50, None), (51, []), (52, [1.0, None, 2.0, 0.5]), (53, [1.0, math.nan, 2.0, 0.5]), (54, [1.0, math.inf, 2.0, 0.5]), (55, [1.0, 2.0]), (56, [1e30, 0.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"component": F.lit("x"), "n": F.lit("y")})
    found = whitening.whiten(df).toPandas()
    assert len(found) == 42 * 3 and set(found.n) == {42} and found.vec_id.isna().sum() == 3 and (found.vec_id == 0).sum() == 6
    assert found.identity_error.max() < 1e-9 and found.groupby("component").explained.first().sum() == pytest.approx(1)
    assert whitening.whiten(df.limit(0)).count() == whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")).count() == 0
    model = whitening.Whitening(1 << 31, np.zeros(2, dtype=np.int64), np.ones(2, dtype=np.int64), np.empty(0), np.empty((2, 0)), 1.0)
    assert model.deviation(np.array([[1 << 20, 5], [1, 0]])) == [None, (2**31 - 1) ** 2 + 1]


def _plain_negatives(keys, labels, x):
    out = []
    products = [[sum(int(p) * int(q) for p, q in zip(a, b, strict=True)) for b in x] for a in x]
    for a in range(len(keys)):
        if keys[a] is None or keys[a] % 50:
            continue
        order = sorted((b for b in range(len(keys)) if b != a), key=lambda b: (-products[a][b], keys[b] is None, keys[b] or 0, b))
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            best = products[a][p]
            fits = [b for b in order if labels[b] != labels[a] and 50 * best <= 100 * products[a][b] <= 95 * best]
            out += [(keys[a], keys[p], k + 1, keys[b], best, products[a][b]) for k, b in enumerate(fits[:3])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("cell", "first", "part"), [(512, 1024, 2048), (4, 3, 2), (1, 1, 1)])
def test_negatives_are_those_of_a_plain_version(spark, monkeypatch, cell, first, part):
    monkeypatch.setattr(negatives, "CELL", cell)
    monkeypatch.setattr(negatives, "FIRST", first)
    monkeypatch.setattr(negatives, "PART", part)
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 240)] + rng.normal(scale=0.3, size=(240, 6))
    x[60:90] = x[50]  # copies tie
    labels = rng.integers(0, 4, 240).tolist()
    keys = [k * 5 for k in range(200)] + [0, 50, 100, *range(7, 44)]
    rows = [*zip(keys, x.tolist(), labels, strict=True)]
    odd = [(None, x[5].tolist(), 1), (50, x[6].tolist(), None), (100, None, 2), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (200, [math.nan] * 6, 1), (250, [1.0], 1), (300, [], 1), (350, [1e30] * 6, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash")).coalesce(1)
    found = negatives.mine(df, F.col("vec_id") % 50 == 0)
    whole = np.floor(256 * np.vstack([x, x[5:6]])).astype(int)
    assert sorted(map(tuple, found.collect()), key=str) == _plain_negatives([*keys, None], [*labels, 1], whole.tolist())
    if cell == 512:
        assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_products_of_large_entries(spark):
    rows = [(0, [2.0**17, 3.0], 1), (1, [2.0**17, 5.0], 1), (2, [2.0**16 + 1, 7.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine(df, F.col("vec_id") == 0).collect()
    assert [(r.positive_score, r.negative_score) for r in got] == [(2**50 + 15 * 65536, 2**25 * (2**24 + 256) + 21 * 65536)]


def test_the_heap_gives_all_pairs_by_falling_bound():
    rng = np.random.default_rng(4)
    books = negatives.Codebooks((slice(0, 3), slice(3, 6)), (rng.normal(size=(7, 3)), rng.normal(size=(5, 3))), (rng.random(7), rng.random(5)), np.ones((7, 5), dtype=np.int64))
    x = rng.normal(size=6)
    low, high = books.bounds(x)
    whole = (high[0][:, None] + high[1][None, :]).ravel()
    order = books.visit(x, -math.inf, math.inf)
    assert sorted(order) == list(range(35)) and (np.diff(whole[order]) <= 1e-12).all()
    assert books.visit(x, 0.5, math.inf) == [c for c in order if whole[c] >= 0.5]
    assert books.visit(x, -math.inf, 0.0) == [c for c in order if (low[0][:, None] + low[1][None, :]).ravel()[c] <= 0]
    assert books.visit(x, -math.inf, math.inf, 4) == order[:4]


def test_negatives_equal_their_sql(spark):
    found = queries.op13_hard_negatives(spark, SMALL)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{SMALL}/embeddings.parquet'")
    plain = db.sql(queries.oracle_sql()["op13_hard_negatives"])
    assert sorted(found.columns) == sorted(plain.columns)
    assert sorted(map(tuple, found.select(*plain.columns).collect())) == sorted(plain.fetchall())


def test_the_index_is_merged(spark):
    """It holds every row, so it never passes through the driver, however small it is on disk."""
    plan = queries.op13_hard_negatives(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
