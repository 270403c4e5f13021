"""Near-duplicate operators against brute force, and their edge cases."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridscore.llm import cells, embeddings, queries, simhash


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if hashes and 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "one", "One TWO", "a b c", "É a b\tc  d e f", "x " * 50, "the cat sat on the mat\x0bwith a hat"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_hamming_links_miss_none(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40)
    fps = {int(b) for b in base} | {0, 1, 7}
    for b in base:  # near ones at 1 to 4 bits, dense around the first
        for n in range(60 if b == base[0] else 3):
            bits = rng.choice(63, rng.integers(1, 5), replace=False)
            fps.add(int(b) ^ sum(1 << int(k) for k in bits))
    names = sorted(fps)
    pairs = [(i, j) for i in range(len(names)) for j in range(i) if (names[i] ^ names[j]).bit_count() <= 3]
    expected = groups(len(names), pairs)
    found = [(r.src, r.dst) for r in simhash.hamming_links(spark.createDataFrame([(x,) for x in names], "fp long")).collect()]
    place = {x: k for k, x in enumerate(names)}
    assert groups(len(names), [(place[a], place[b]) for a, b in found]) == expected
    assert len(found) < 8 * len(names)


def test_large_cells_are_compared_in_blocks(spark):
    rows = spark.range(50).select(F.col("id").alias("fp"), F.lit(1).alias("cell"), F.lit(True).alias("home"))
    dealt = cells.dealt_in_blocks(rows, ["cell"], "fp", 8)
    seen = dealt.groupBy("_i", "_j").agg(F.collect_list("fp").alias("f")).collect()
    met = {(a, b) for r in seen for a in r.f for b in r.f}
    assert len(met) == 2500 and max(len(r.f) for r in seen) < 40


def test_simhash_query(spark, sf_dir):
    found = queries.op5_simhash(spark, sf_dir).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert [int(x, 16) for x in found.fingerprint] == fps
    ids = docs.doc_id.tolist()
    comp = groups(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert found.component_id.tolist() == [ids[c] for c in comp]


def test_simhash_edge_cases(spark):
    rows = spark.createDataFrame([(3, None, "k"), (1, "", "k"), (2, "a b c d e f", "k"), (2, "a b c d e f", "k"), (None, "a b c d e f", "k"), (None, "lone text of its own", "k"), (9, "z " * 5000, "k")], "doc_id long, text string, fp string")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert found == sorted([(3, 1), (1, 1), (2, 2), (2, 2), (None, 2), (None, None), (9, 9)], key=str)
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, None, 9], key=str)
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "A b c d e f"), (5, "quite another text here")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(twice).count() == 2
    assert simhash.near_duplicates(rows.limit(0)).count() == 0 and simhash.drop_near_duplicates(rows.limit(0)).count() == 0


def test_embedding_query_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    near = np.concatenate([base[k % 4] + rng.normal(scale=s, size=64) for k, s in enumerate(rng.uniform(0.1, 0.45, 150))]).reshape(-1, 64)
    x = np.concatenate([base, near, base[:5], 3 * base[5:8]]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = groups(len(u), list(zip(*map(list, np.nonzero(np.tril(links))), strict=True)))
    rows = spark.createDataFrame([(k, v.tolist(), "q") for k, v in enumerate(x)], "vec_id long, embedding array<float>, vector string")
    found = embeddings.near_duplicates(rows).toPandas().sort_values("vec_id")
    assert found.n_links.tolist() == links.sum(1).tolist() and found.component_id.tolist() == comp
    assert (found.kept == (found.vec_id == found.component_id)).all()


def test_embedding_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    expected = con.sql(queries.oracle_sql()["op1_embedding_dedup"]).df().sort_values("vec_id")
    found = queries.op1_embedding_dedup(spark, sf_dir).toPandas().sort_values("vec_id")
    assert (found[list(expected.columns)].to_numpy() == expected.to_numpy()).all()


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (9, []), (None, [0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0]), (12, [1e-300, 0.0]), (13, [-1.0, 0.0])],
        "vec_id long, embedding array<double>",
    )
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(rows).collect()}
    assert found[1] == (3, 1) and found[3] == (3, 1) and found[12] == (3, 1) and found[10] == (1, 10) and found[None] == (1, 10)
    assert all(found[k] == (0, k) for k in (4, 5, 6, 7, 8, 9, 11, 13))
    assert embeddings.near_duplicates(rows.limit(0)).count() == 0


def test_large_cells_send_a_row_to_few_blocks():
    """A grid over more coordinates and smaller chunks sent a vector of 600,000 to more than a hundred blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 64)) / 8
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    n, sent = 600_000, 0.0
    space = embeddings._Space(64, 0.95, x[:2048], n)
    rotated = space.rotated(x)
    for k in range(len(space.parts)):
        rows = np.unique(space.cells(rotated, k)[1], return_counts=True)[1] * (n / len(x))
        sent += (rows * np.ceil(rows / embeddings.CHUNK)).sum() / n
    assert sent < 40
