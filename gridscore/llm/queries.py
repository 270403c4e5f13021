"""The queries of the numbered operators: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscore.llm import embeddings, htmltext, langid, lm, media, mixing, negatives, pieces, quality, sharding, simhash, tokens, whitening
from gridscore.session import table


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels.where(~held_out()))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(spark, table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages together; doc_id is null for a page, page_id for a document."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(NULL AS long) AS page_id", "text", "lang AS declared", "source AS host")
    pages = langid.page_evidence(table(spark, sf_dir, "pages")).selectExpr("CAST(NULL AS long) AS doc_id", "page_id", "text", "declared", "host")
    rows = docs.unionByName(pages)
    return langid.identify(rows, langid.fit_text(rows, declared="declared"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return placed.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS int) AS grown_shard")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_media(table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model = lm.fit(docs.where(~aside))
    scored = lm.score(docs.select("doc_id", "text", aside.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_quality, op3_mixing, op4_token_counts, op5_simhash, op6_language_id, op7_html_extraction, op8_pieces, op9_sharding, op10_media_columns, op11_lm_scores, op12_whitening, op13_hard_negatives)}


#: All pairs of vectors by cosine, and components by following links from every vector.
OP1_SQL = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
  l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
  n AS (SELECT s AS vec_id, count(*) AS n FROM l GROUP BY 1), r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.t FROM r JOIN l ON r.t = l.s), c AS (SELECT s AS vec_id, min(t) AS c FROM r GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)"""


#: Running sums in doc_id order; the checksum is CRC-32 over UTF-8 bytes by its table, made from the polynomial.
OP9_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
  step AS (SELECT b.range AS b, list_reduce(list_prepend(b.range, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) b),
  t AS (SELECT list(v ORDER BY b) AS t FROM step),
  u AS (SELECT doc_id, size, list_transform(string_split(text, ''), lambda c: unicode(c)) AS u FROM d),
  y AS (SELECT doc_id, size, CASE WHEN size = 16 THEN [] ELSE flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)]
    WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)] ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END)) END AS y FROM u),
  k AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, y), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS crc FROM y, t),
  p AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w AS n FROM k WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, CAST(least(39, (2 * before + size) * 40 // (2 * total)) AS INT) AS shard FROM p)
  SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


#: All products of anchors with all rows; the order of ranks decides ties.
OP13_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
  SELECT * FROM n WHERE rank <= 3"""


def oracle_sql() -> dict[str, str]:
    """Hashes, compression, training and tokenizers have no SQL here; tests/llm holds those queries against plain versions."""
    return {"op1_embedding_dedup": OP1_SQL, "op9_sharding": OP9_SQL, "op13_hard_negatives": OP13_SQL}
