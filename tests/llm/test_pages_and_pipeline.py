"""Main text of pages, and the pipeline's stages on their own inputs."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridscore.llm import htmlpages, htmltext, queries, simhash
from gridscore.session import stored


def plain_text(page):
    """What the given pages' own layout says: the blocks of their article."""
    m = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page or "", re.S)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = queries.op7_html_extraction(spark, sf_dir).collect()
    assert len(found) == len(pages)
    assert sum(r.text == plain_text(pages[r.page_id]) for r in found) >= 0.99 * len(pages)
    assert all(r.n_chars == len(r.text) for r in found)


def test_held_out_layouts():
    model = htmltext.trained()
    right = total = 0
    for page, main in htmlpages.labelled_pages(150, seed=91):
        blocks = htmltext.blocks_of(page)
        right += sum(a == (b.text in set(main)) for a, b in zip(model.label(blocks), blocks, strict=True))
        total += len(blocks)
    assert right / total > 0.99


def test_viterbi_finds_the_best_labels():
    import itertools

    model = htmltext.trained()
    blocks = htmltext.blocks_of(htmlpages.labelled_pages(1, seed=5)[0][0])[:9]
    scores = [sum(model.weights.get(f, 0.0) for f in row) for row in htmltext.features(blocks)]
    value = lambda y: sum(s for s, a in zip(scores, y, strict=True) if a) + sum(model.moves[a][b] for a, b in zip(y, y[1:], strict=False))
    assert value(model.label(blocks)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=len(blocks)))))


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><div id="cookie-banner"><p>We use cookies on this site.</p></div><nav><a>Home</a> <a>News</a></nav>
<article><h1>Real &amp; title</h1><p>First  paragraph&nbsp;of the story,<br>which goes on.<p>Second one &eacute; and &lt;b&gt;.</p><div class="advert">Buy now!</div></article>
<section id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></section><footer>&copy; 2020</footer>"""


@pytest.mark.parametrize(
    "page",
    [
        "<p title='x>don't" * 60_000, '<a x="' * 170_000, "<div>a" * 170_000, "<b><div>x</div>" * 70_000, "<div>" * 60_000 + "<li>x" * 120_000,
        "".join(f"<div class='c{k}'>a" for k in range(50_000)), "<script></script" * 60_000, "<!x" * 340_000, "<" * 1_000_000, "<a b='" + '<c d=">' * 140_000,
    ],
)
def test_long_broken_pages_are_read_once(page):
    start = time.process_time()
    htmltext.main_text(page, htmltext.trained())
    assert len(page) > 800_000 and time.process_time() - start < 30


def test_quotes_hide_the_end_of_a_tag_only_if_they_are_closed():
    texts = lambda page: [b.text for b in htmltext.blocks_of(page)]
    assert texts("<p title='a>b'>one</p><p title=it's>two</p>") == ["one", "two"]
    assert texts('<p title="a>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p>a < b</p><!-- <p>no</p> --><p>b <c") == ["a < b", "b <c"]
    assert texts("<ul><li>one<li>two<ul><li>three</ul><li>four</ul><p>five<p>six<div>seven") == ["one", "two", "three", "four", "five", "six", "seven"]


def test_extraction_edge_cases(spark):
    rows = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<<<>><a b=\"x", "x"), (None, "<script>only", "x"), (5, "<p>" + "word " * 50000, "x")], "page_id long, html string, text string")
    found = htmltext.extract(rows).collect()
    assert [r.text for r in found if r.page_id == 1] == ["Real & title\n\nFirst paragraph of the story, which goes on.\n\nSecond one é and <b>."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in found if r.page_id in (2, 3, None))
    assert next(r.n_chars for r in found if r.page_id == 5) == 249999
    assert htmltext.extract(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sf_dir() -> str:
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], sf_dir), name))
    return made


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "simhash", "mixing", "pieces"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "pieces", "n_pieces", "lossless"]


def test_filters_keep_clean_documents(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = stages[0].join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert good.join(stages[1], "doc_id", "left_anti").count() == 0
    assert good.join(stages[2], "doc_id", "left_anti").count() <= 0.05 * good.count()


def test_one_document_of_each_group_stays(stages):
    fps = {r.doc_id: simhash.fingerprint(r.text) & (1 << 64) - 1 for r in stages[2].collect()}
    kept = {r.doc_id for r in stages[3].collect()}
    assert stages[3].count() == len(kept)
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3
    assert all(any(near(d, k) for k in kept) or d in kept for d in fps if any(near(d, e) and e < d for e in fps)) and not any(near(a, b) for a in kept for b in kept if a < b)


def test_mix_and_pieces_go_together(stages):
    copies = stages[4].groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 2 and stages[4].join(stages[3], "doc_id", "left_anti").count() == 0
    assert stages[5].count() == stages[4].count() and stages[5].where("not lossless").count() == 0


def test_run_is_the_stages_together(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_pieces) for r in out.collect()) == sorted((r.doc_id, r.n_pieces) for r in stages[5].collect())


def test_stages_of_an_empty_table(spark, sf_dir, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0
        docs = stages[0].limit(0)
