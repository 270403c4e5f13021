"""Extra columns, whatever their names, come back as they were; broken pages and many codes cost no more than their size."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridscore.llm import langid, mixing, queries, simhash

SMALL = "/root/testdata/sf0.001"
NAMES = ["__a", "__b", "__key", "__hash", "__times", "__copy", "__score", "_", "c", "c0", "a", "b", "row", "key", "hash", "n", "times", "tie", "score", "_part", "_group", "fp", "uid", "odd name", "language", "half", "place"]


@pytest.fixture(scope="module")
def wide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in NAMES])


STEPS = {
    "mixed": lambda spark, d: mixing.mixed(d),
    "drop_near_duplicates": lambda spark, d: simhash.drop_near_duplicates(d),
    "accepted_only": lambda spark, d: langid.accepted_only(d, langid.fit_text(d)),
    **{f"stage {name}": (lambda f: lambda spark, d: f(spark, d, SMALL))(f) for name, f in corpus_pipeline.STAGES[:-1]},
}


@pytest.mark.parametrize("step", STEPS)
def test_columns_come_back_unchanged(spark, wide, step):
    found = STEPS[step](spark, wide)
    assert found.columns == wide.columns and found.schema.fieldNames() == wide.columns
    rows = {r.doc_id: r for r in wide.collect()}
    got = found.collect()
    assert got and all(r == rows[r.doc_id] for r in got)
    if "mix" not in step:  # where a row's hash draws, all its columns count
        narrow = STEPS[step](spark, wide.drop(*NAMES))
        assert sorted(r.doc_id for r in narrow.collect()) == sorted(r.doc_id for r in got)


def test_quality_filter_keeps_nulls_and_repeats_apart(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, ""), (10**6, None)], "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("doc_id", "text")}).select(*docs.columns)
    some = docs.limit(30)
    found = corpus_pipeline.quality_filter(spark, docs.unionByName(some).unionByName(odd), SMALL)
    once = corpus_pipeline.quality_filter(spark, docs, SMALL)
    again = once.join(some.select("doc_id"), "doc_id", "left_semi").count()
    assert found.where("text is not null and text <> ''").count() == once.where("text <> ''").count() + again


BROKEN = ["<html " * 170_000, "<html " * 170_000 + ">", "<a " * 330_000, "<" * 1_000_000, "<html lang" + " " * 1_000_000, "lang" * 250_000, "<script>" * 125_000, "&#" * 500_000, "<!--" * 250_000, "<a b='" * 160_000, "<a b='" * 160_000 + ">"]


@pytest.mark.parametrize("k", range(len(BROKEN)))
def test_broken_pages_are_read_once(k):
    began = time.perf_counter()
    text, declared = langid._evidence(BROKEN[k])
    assert time.perf_counter() - began < 2 and declared is None and len(text) <= len(BROKEN[k])


def test_page_evidence(spark):
    pages = [
        (1, "https://u:p@A.example.org:8/x", "<!doctype html><HTML data-x='a>b' xml:lang='pt-BR'><script>var no</script><p>caf&eacute; <b>sim</b><!-- no --></p></html><html lang=en>", "x"),
        (2, None, None, "x"), (3, "no address", "", "x"), (3, "no address", "", "x"), (4, "http://b.net", "plain < text & more", "x"), (5, "http://c.net", "<html hreflang=de><p lang='fr'>x" + " y" * 100_000, "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string").withColumn("row", F.lit(1))
    found = langid.page_evidence(df)
    assert found.columns == ["page_id", "url", "html", "row", "text", "declared", "host"]
    got = [(r.page_id, " ".join(r.text.split())[:40], r.declared, r.host) for r in found.orderBy("page_id").collect()]
    assert got[0] == (1, "café sim", "pt-BR", "a.example.org") and got[1] == (2, "", None, None) and got[2] == got[3] == (3, "", None, None)
    assert got[4] == (4, "plain < text & more", None, "b.net") and got[5][2:] == (None, "c.net")
    assert langid.page_evidence(df.limit(0)).count() == 0


def test_thousands_of_declared_codes(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b + c for a in letters[:15] for b in letters[:15] for c in letters[:14]][:3000]
    rows = [(k, f"{c} {c[::-1]}{c} words that {c}{c} declares {k % 7}", c, f"{c}.example.{c[:2]}") for k, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string").repartition(8)
    began = time.perf_counter()
    model = langid.fit_text(df, declared="declared")
    assert len(model.languages) == 3001
    found = langid.identify(df, model)
    assert found.count() == 3000 and found.where("probability > 0").count() == 3000
    assert time.perf_counter() - began < 60


def test_long_texts_weigh_more():
    model = langid.TextModel(["x", "y", "und"], langid._model(["x", "y"], langid.np.random.default_rng(1).integers(0, 9, (langid.BUCKETS, 2))).table)
    for evidence, power in langid.WEIGHTS:
        weights = [n * langid._tempered(n, evidence, power) for n in (1, 10, 100, 1000, 10**5, 10**7)]
        assert weights == sorted(weights) and weights[-1] > 2 * weights[-2] * (power < 0.7) and weights[0] == 1
    assert len(model.likelihoods("")) == 3 and set(model.likelihoods("")) == {0.0}
