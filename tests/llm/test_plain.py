"""Scores and posteriors against plain re-computations, and repeated rows at a size that one task shouldn't hold."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gridscore.llm import langid, mixing, quality, queries, sharding

SMALL = "/root/testdata/sf0.001"


def _plain_features(model, text):
    """Sizes of 2,048-byte pieces, packed on their own with each dictionary."""
    data = (text or "").encode()
    cuts = list(range(0, len(data), 2048))
    if len(cuts) > 1 and len(data) - cuts[-1] < 512:
        cuts.pop()
    bounds = [*zip(cuts, cuts[1:]), (cuts[-1], len(data))] if cuts else []
    sizes = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=12)
        sizes.append([len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[a:b])) for a, b in bounds])
    if not bounds:
        return [0.0, 0.0, 0.0]
    good, bad = map(sum, sizes)
    each = sorted((b - g) / (b + g) for g, b in zip(*sizes, strict=True))
    worst = each[: math.ceil(len(each) / 5)]
    return [(bad - good) / (bad + good), sum(worst) / len(worst), min(0.0, math.log((good + bad) / 2 / len(data)))]


def _plain_dictionary(texts):
    share = max(64, (1 << 18) // len(texts))
    return b"".join(t[(len(t) - share) // 2 :][:share] if len(t) > share else t for t in texts)[-(1 << 18) :]


def test_quality_scores_are_those_of_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    model = queries.quality_model(docs, labels)
    again = queries.quality_model(docs.repartition(7), labels.repartition(3))
    assert (model.good, model.bad) == (again.good, again.bad) and model.weights == pytest.approx(again.weights)
    found = queries.op2_quality(spark, SMALL).toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, text in sorted(texts.items())[:60]:
        z = model.weights[0] + np.dot(model.weights[1:], _plain_features(model, text))
        assert found.score[key] == pytest.approx(1 / (1 + math.exp(-z)))
    # the fit: dictionaries of all labelled texts in their order, the curve from each half scored with the other's
    known = {r.doc_id: r.quality for r in labels.where(~queries.held_out()).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).collect()}
    assert max(Counter(known.values()).values()) <= quality.ROWS
    order = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    ranked = [k for _, k in sorted((r.h, r.doc_id) for r in order if r.doc_id in known)]
    own = [[(texts[k] or "").encode() for k in ranked if known[k] == y] for y in (0, 1)]
    assert (model.good, model.bad) == (_plain_dictionary(own[1]), _plain_dictionary(own[0]))
    x, y = [], []
    for fold in (0, 1):
        half = quality.Model(_plain_dictionary(own[1][fold::2]), _plain_dictionary(own[0][fold::2]), ())
        for value in (0, 1):
            x += [_plain_features(half, t.decode()) for t in own[value][1 - fold :: 2]]
            y += [value] * len(own[value][1 - fold :: 2])
    x = np.array(x)
    # the slope of the penalised likelihood is nought at the weights
    z = (x - x.mean(0)) / x.std(0)
    scaled = np.array(model.weights[1:]) * x.std(0)
    p = 1 / (1 + np.exp(-(model.weights[0] + x @ np.array(model.weights[1:]))))
    assert np.abs(z.T @ (np.array(y) - p) - 1e-3 * scaled).max() < 1e-4


def _softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def test_posteriors_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "lang AS declared", "source AS host")
    pages = langid.page_evidence(spark.read.parquet(f"{SMALL}/pages.parquet")).selectExpr("-page_id - 1 AS doc_id", "text", "declared", "host")
    odd = spark.createDataFrame([(10**6, None, "en", "a.b.org"), (10**6 + 1, "so it is", None, None), (10**6 + 2, "123", "de", "x.org"), (10**6 + 3, "das ist", "de-AT", "x.org")], "doc_id long, text string, declared string, host string")
    table = docs.unionByName(pages).unionByName(odd)
    model = langid.fit_text(table, declared="declared")
    rows = table.collect()
    n = len(model.languages)
    counts = {k: np.zeros(langid.BUCKETS) for k in model.languages[:-1]}
    code = lambda d: next(iter(__import__("re").findall(r"^([a-z]{2,3})(?:$|[^a-z])", (d or "").strip().lower())), None)
    lettered = lambda t: any(c.isalpha() for c in t or "")
    seen = set()
    for r in rows:
        if code(r.declared) and lettered(r.text) and (code(r.declared), r.text) not in seen:
            seen.add((code(r.declared), r.text))
    assert max(Counter(k for k, _ in seen).values()) > langid.ROWS or all(k in counts for k, _ in seen)
    small = {k for k, c in Counter(k for k, _ in seen).items() if c <= langid.ROWS}
    for k, t in seen:
        folded = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in t.encode()) + b" "
        for a, b, c in zip(folded, folded[1:], folded[2:]):
            if (a, b, c) != (32, 32, 32):
                counts[k][(a * 40503 + b * 2654 + c * 97) % langid.BUCKETS] += 1
    for k in small:
        assert model.table[:, model.languages.index(k)] == pytest.approx(np.log((counts[k] + 0.5) / (counts[k] + 0.5).sum()), abs=1e-4)
    like = [np.array(model.likelihoods(r.text)) for r in rows]
    post = [_softmax(x) for x in like]
    suffix = lambda h: h.lower().rsplit(".", 1)[-1] if h and "." in h else None
    domain = lambda h: ".".join(h.lower().split(".")[-2:]) if h and "." in h else None
    zero = lambda: np.zeros(n)
    sums = {name: defaultdict(zero) for name in ("declared", "suffix", "domain", "host")}
    every = np.zeros(n)
    for r, q in zip(rows, post, strict=True):
        if lettered(r.text):
            every += q
            for name, value in (("declared", code(r.declared)), ("suffix", suffix(r.host)), ("domain", domain(r.host)), ("host", r.host and r.host.lower())):
                if value is not None:
                    sums[name][value] += q
    prior = (every + 1) / (every.sum() + n)
    smooth = lambda c, above: (np.maximum(c, 0) + 10 * above) / (np.maximum(c, 0).sum() + 10)
    found = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert len(found) == len(rows)
    for r, x, q in zip(rows, like, post, strict=True):
        total = x.copy()
        for name, value in (("declared", code(r.declared)), ("suffix", suffix(r.host))):
            if value is not None and value in sums[name]:
                total += np.log((sums[name][value] + 1) / (sum(sums[name].values()) + len(sums[name]) + 1))
        host = r.host.lower() if r.host else None
        if host in sums["host"]:
            above = smooth(sums["domain"].get(domain(host), np.zeros(n)), prior)
            total += np.log(smooth(sums["host"][host] - (q if lettered(r.text) else 0), above))
        else:
            total += np.log(smooth(np.zeros(n), prior))
        p = _softmax(total)
        assert found[r.doc_id].probability == pytest.approx(p.max(), abs=1e-6)
        if lettered(r.text) and np.sort(p)[-1] - np.sort(p)[-2] > 1e-6:
            assert found[r.doc_id].language == model.languages[int(p.argmax())]


def test_repeats_are_dealt_over_leaves_and_every_text_stays_itself(spark):
    same = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("extra"))
    apart = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.lit("b"), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit(2).alias("extra"))
    other = spark.range(5000).select((F.col("id") + 10).alias("doc_id"), F.lit("w " * 9).alias("text"), F.lit(None).cast("string").alias("source"), F.lit(3).alias("extra"))
    rows = same.unionByName(apart).unionByName(other)
    found = mixing.mix(rows)
    assert found.count() == 59_000
    sums = {r.source: (r.taken, r.target) for r in found.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(taken - target) <= 9 for taken, target in sums.values())
    groups = mixing._numbered(rows.groupBy("doc_id", "text").count(), "count")
    assert groups.count() == 59_000 and groups.where("doc_id is null").agg(F.count_distinct("n")).first()[0] == 50_000
    taken = mixing.mixed(rows)
    assert taken.columns == rows.columns and taken.count() == found.agg(F.sum("copies")).first()[0]
    once, twice = (Counter((r.text, r.extra) for r in t.where("extra > 1").collect()) for t in (taken, mixing.mixed(rows.repartition(5))))
    # in this mix the texts of a source are taken with equal chances; each text is itself, and reruns agree
    assert once == twice and set(once) <= {(r.text, r.extra) for r in rows.where("extra > 1").distinct().collect()}
    assert all(c <= 2 for (_, extra), c in once.items() if extra == 2)
    assert mixing.mixed(rows.limit(0)).count() == 0


def test_shards_of_repeated_rows_agree_on_a_rerun(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("other"))
    for name, df in (("a", rows), ("b", rows.repartition(5, "other"))):
        sharding.write_shards(df, str(tmp_path / name), 7)
    one, two = ({(r.other, r.shard, r.slot) for r in spark.read.parquet(str(tmp_path / name)).collect()} for name in ("a", "b"))
    assert one == two and len(one) == 3000 and Counter(s for _, s, _ in one).most_common()[0][1] <= 430


def test_rejected_rows_are_told_apart_by_their_evidence(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = docs.unionByName(spark.createDataFrame([(9, "123", "en", "s"), (9, "und so", "de", "s"), (None, "", "en", None), (9, None, None, None)], docs.schema))
    kept = langid.accepted_only(rows, langid.fit_text(docs)).where("source = 's' or source is null").collect()
    assert all(r.text == "und so" for r in kept)


def _hash(*values):
    """xxhash64 of numbers as Spark chains it: (number, bytes) after one another from seed 42."""
    import xxhash

    seed = 42
    for value, size in values:
        seed = xxhash.xxh64(int(value).to_bytes(size, "little", signed=True), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def _pivoted(items, done):
    """Fold items (h, size, p, key), in order of h, into whole ones and at most one that is still open."""
    still = None
    for x in items:
        if still is None:
            still = x
            continue
        r = still
        up, down = min(r[1] * (1 - r[2]), x[1] * x[2]), min(r[1] * r[2], x[1] * (1 - x[2]))
        u = (_hash((42, 4), (r[0], 8), (x[0], 8), (r[1], 8), (x[1], 8)) % (1 << 53)) / float(1 << 53)
        if u * (up + down) < down:  # r rises at x's cost
            first = r[1] * (1 - r[2]) <= x[1] * x[2]
            ended, value = (r, 1) if first else (x, 0)
            still = (*x[:2], x[2] - up / x[1], x[3]) if first else (*r[:2], r[2] + up / r[1], r[3])
        else:
            first = r[1] * r[2] <= x[1] * (1 - x[2])
            ended, value = (r, 0) if first else (x, 1)
            still = (*x[:2], x[2] + down / x[1], x[3]) if first else (*r[:2], r[2] - down / r[1], r[3])
        done.append((ended[3], ended[1], value))
    return still


def test_mixing_takes_what_a_plain_pivotal_fold_takes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6))  # two leaves and more a source
    found = {r.key: r for r in mixing.mix(docs).withColumnRenamed("doc_id", "key").collect()}
    sizes = {r.doc_id: (r.source, len([w for w in (r.text or "").encode().split()])) for r in docs.collect()}
    rows = Counter(s for s, _ in sizes.values())
    for source in rows:
        own = {k: n for k, (s, n) in sizes.items() if s == source}
        one = found[next(iter(own))]
        p = one.target / one.source_size
        base, f, leaves = math.floor(p), p - math.floor(p), math.ceil(rows[source] / mixing.FAN)
        nodes, taken, ids = defaultdict(list), {}, {}
        for k, n in own.items():
            if f > 0 and n > 0:
                h = _hash((42, 4), (k, 8), (n, 8), (0, 4), (0, 8))
                nodes[_hash((h, 8)) % leaves].append((h, n, f, k))
        depth, width = 0, max(rows.values()) / mixing.FAN
        while True:
            opened = defaultdict(list)
            for node in sorted(nodes):
                done = []
                still = _pivoted(sorted(nodes[node]), done)
                for at, (k, _, value) in enumerate(done):
                    taken[k], ids[k] = value, (depth, node, at)
                if still:
                    opened[node // mixing.FAN if width > 1 else node].append(still)
            if width <= 1:
                break
            nodes, width, depth = opened, width / mixing.FAN, depth + 1
        for node, (still,) in opened.items():
            taken[still[3]], ids[still[3]] = int(still[2] >= 0.5), (depth, node, -1)
        gap = one.target - base * one.source_size - sum(own[k] * v for k, v in taken.items())
        fits = [(abs(abs(gap) - own[k]), own[k], ids[k], k) for k, v in taken.items() if v == int(gap < 0) and abs(abs(gap) - own[k]) < abs(gap)]
        if fits:
            k = min(fits)[3]
            taken[k] = 1 - taken[k]
        assert {k: found[k].copies for k in own} == {k: base + taken.get(k, 0) for k in own}
