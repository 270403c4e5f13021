"""Language of texts: likelihoods of letter runs fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscore.llm import htmltext
from gridscore.llm.rows import packed, schema_of, unpacked
from gridscore.session import stored

#: Buckets of hashed byte trigrams and their additive count.
BUCKETS, ALPHA = 1 << 13, 0.5
#: Trigrams of a text depend on each other, so n of them weigh as min(n, EVIDENCE ** POWER * n ** (1 - POWER)) would if
#: they didn't: the longer, the more. These pairs are tried on held-out declared rows; the first is that without any.
WEIGHTS = [(50, 0.5), *((e, p) for e in (10, 25, 50, 100, 200, 400, 800) for p in (0.25, 0.5, 0.75, 0.9) if (e, p) != (50, 0.5))]
#: Of each declared language at most ROWS distinct texts, by hash, are fitted on, each of them whole.
ROWS = 400
#: What a level of the host hierarchy weighs against the level below it, in rows; and a category's additive count.
STRENGTH, ADD = 10.0, 1.0
#: Texts whose language is less likely than this, or without letters, are rejected.
LEAST = 0.5
UNKNOWN = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes of a text, where ASCII that isn't a letter is a space; none of spaces only."""
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", dtype=np.uint8).astype(np.int32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    return ((a * 40503 + b * 2654 + c * 97) % BUCKETS)[(a != 32) | (b != 32) | (c != 32)]


@dataclass
class TextModel:
    """Log-likelihood of each bucket for each language; the last column is the unknown language, alike for all."""

    languages: list[str]
    table: np.ndarray
    evidence: float = WEIGHTS[0][0]
    power: float = WEIGHTS[0][1]

    def raw(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sums of log-likelihoods over a text's trigrams, and their number."""
        found = _trigrams(text)
        total = np.bincount(found, minlength=BUCKETS) @ self.table if len(found) > 4096 else self.table[found].sum(0)
        return total.astype(np.float64), len(found)

    def likelihoods(self, text: str | None) -> list[float]:
        """Log-likelihoods, tempered by length; no evidence where there are no letters."""
        total, n = self.raw(text)
        return (total * _tempered(n, self.evidence, self.power)).tolist() if n else [0.0] * len(self.languages)


def _tempered(n: int, evidence: float, power: float) -> float:
    return min(1.0, (evidence / n) ** power)


def code(declared: Column) -> Column:
    """The primary language code of a declared tag, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:$|[^a-z])", 1), F.lit(""))


def fit_text(df: DataFrame, text: str = "text", declared: str = "lang", rows: int = ROWS) -> TextModel:
    """Fit on texts and the language that they declare, at most `rows` whole texts of each language: their trigrams are
    counted in tasks, and counts a bucket and language come to the driver.

    Every language is learnt that a row with letters declares, however rare it is. Copies of a text count once. How much
    a long text weighs is calibrated: each half of the sample is scored with the counts of the other, and the pair of
    WEIGHTS is taken that makes the declared languages likeliest (ties: the earlier).
    """
    known = df.select(code(F.col(declared)).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    known = known.withColumn("h", F.xxhash64("t"))
    # these need not be exact: they only set how many rows beyond the first `rows` hashes are looked at
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return _model([], np.full((2, BUCKETS, 1), ALPHA))
    draw = F.pmod("h", F.lit(1 << 32))
    # a share of each language's texts that is expected to hold twice those asked for, found in one scan; copies meet
    # before they are shuffled
    limits = df.sparkSession.createDataFrame([(k, int(min(1, 2 * rows / max(n, 1)) * (1 << 32)), i) for i, (k, n) in enumerate(sorted(counts.items()))], "l string, most long, place int")
    drawn = known.join(F.broadcast(limits), "l").where(draw < F.col("most")).groupBy("l", "place", "h").agg(F.min("t").alias("t"))
    numbered = drawn.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(draw, "h"))).where(F.col("n") <= rows)
    sample = stored(numbered.select("place", (F.col("n") % 2).alias("half"), "t"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, half, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.bincount(_trigrams(t), minlength=BUCKETS)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(some), pa.int32()), pa.array([half] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(found[some])], names=["place", "half", "bucket", "n"])

    counted = sample.mapInArrow(count, "place int, half int, bucket int, n long").groupBy("place", "half", "bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 x BUCKETS a language at most
    halves = np.zeros((2, BUCKETS, len(languages)))
    place, half, bucket, n = (c.to_numpy() for c in counted.columns)
    halves[half, bucket, place] = n
    whole, folds = _model(languages, halves.sum(0)), [_model(languages, h) for h in halves]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.zeros(len(WEIGHTS))
        for batch in batches:
            for place, half, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, n = folds[1 - half].raw(t)
                if n:
                    z = np.array([_tempered(n, e, p) for e, p in WEIGHTS])[:, None] * (total - total.max())
                    lost += np.log(np.exp(z).sum(1)) - z[:, place]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(lost)], names=["i", "loss"])

    loss = {r.i: r.loss for r in sample.mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()}
    whole.evidence, whole.power = WEIGHTS[min(loss, key=lambda i: (round(loss[i], 6), i))] if any(loss.values()) else WEIGHTS[0]
    return whole


def _model(languages: list[str], counts: np.ndarray) -> TextModel:
    table = np.ones((BUCKETS, len(languages) + 1))
    if languages:
        table[:, :-1] = counts + ALPHA
    return TextModel([*languages, UNKNOWN], np.log(table / table.sum(0)).astype(np.float32))


def with_likelihoods(df: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """df without `text`, with `likelihoods`; no shuffle."""
    rest = [c for c in df.columns if c != text]
    slim = df.select(df[text].cast("string").alias("_text"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.likelihoods(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))], names=[*rest, "likelihoods"])

    return slim.mapInArrow(run, schema_of(slim.drop("_text"), "likelihoods array<double>"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, which a repeated expression inside a lambda isn't."""
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _softmax(x: Column) -> Column:
    raised = _let(x, lambda v: _let(F.array_max(v), lambda most: F.transform(v, lambda e: F.exp(e - most))))
    return _let(raised, lambda r: _let(_sum(r), lambda total: F.transform(r, lambda e: e / total)))


def _added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def _sums(column: str) -> Column:
    """Sum of arrays, entry by entry: one aggregate, however many entries there are."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def _array(values: list[float] | np.ndarray) -> Column:
    """One literal, which a plan holds as such, whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def identify(df: DataFrame, model: TextModel, text: str = "text", declared: str = "declared", host: str = "host") -> DataFrame:
    """df without `text`, with `language`, `probability` and `accepted`.

    Naive Bayes over four sources: the text's likelihood; how often rows whose text is in a language declare what this
    row declares; how often they have this address suffix (the host's last label); and the host's own mix of languages,
    smoothed by its domain's (the last two labels) and that by all rows', without the row itself. The last three are
    grouped sums of text-only posteriors over all rows, so a frequent host is summed before it is shuffled. Null or
    absent evidence counts for nothing; a text without letters is rejected whatever is declared; repeated rows get
    equal answers; an empty table gives no rows. Columns of df that clash with the added ones are replaced.
    """
    n = len(model.languages)
    rest = [c for c in df.columns if c not in (text, declared, host, "language", "probability", "accepted")]
    address = F.lower(F.col(host))
    slim = df.select(
        packed(df, rest).alias("row"), df[text].alias("text"), code(df[declared]).alias("declared"), address.alias("host"),
        F.when(address.contains("."), F.substring_index(address, ".", -2)).alias("domain"), F.when(address.contains("."), F.substring_index(address, ".", -1)).alias("suffix"),
        (F.coalesce(df[text], F.lit("")).rlike(r"\p{L}")).alias("letters"),
    )
    rows = stored(with_likelihoods(slim, model, "text").withColumn("q", _softmax(F.col("likelihoods"))), "likelihoods")
    lettered = rows.where("letters")
    total = lettered.groupBy(F.lit("")).agg(_sums("q").alias("s")).first()  # none without rows
    every = np.array(total.s if total else [0.0] * n)
    overall = (every + ADD) / (every.sum() + n * ADD)

    def category(name: str) -> DataFrame:
        """Log of how likely each language's rows are to have each value of a column."""
        found = stored(lettered.where(F.col(name).isNotNull()).groupBy(name).agg(_sums("q").alias("s")), name)
        total = found.groupBy(F.lit("")).agg(F.count("*").alias("n"), _sums("s").alias("t")).first()
        least = np.array(total.t) + ADD * (total.n + 1) if total else np.ones(n)
        return found.select(name, F.zip_with("s", _array(least), lambda s, t: F.log((s + ADD) / t)).alias(f"{name}_log"))

    def smoothed(counts: Column, above: Column) -> Column:
        def of(c: Column) -> Column:
            return _let(F.greatest(_sum(c), F.lit(0.0)), lambda size: F.zip_with(c, above, lambda n, p: (F.greatest(n, F.lit(0.0)) + STRENGTH * p) / (size + STRENGTH)))

        return _let(counts, of)

    prior = _array(overall)
    none = F.array_repeat(F.lit(0.0), n)
    domains = stored(lettered.where("domain is not null").groupBy("domain").agg(_sums("q").alias("domain_s")), "domains")
    hosts = lettered.where("host is not null").groupBy("host", "domain").agg(_sums("q").alias("host_s"))
    hosts = stored(hosts.join(domains, "domain", "left").select("host", "host_s", smoothed(F.coalesce("domain_s", none), prior).alias("domain_p")), "hosts")
    joined = rows.join(category("declared"), "declared", "left").join(category("suffix"), "suffix", "left").join(hosts, "host", "left")
    own = F.when(F.col("letters"), F.col("q")).otherwise(none)
    others = F.zip_with(F.coalesce("host_s", none), F.when(F.col("host_s").isNotNull(), own).otherwise(none), lambda a, b: a - b)
    host_log = F.transform(smoothed(others, F.coalesce("domain_p", prior)), lambda p: F.log(p))
    total = reduce(_added, [F.col("likelihoods"), F.coalesce("declared_log", none), F.coalesce("suffix_log", none), host_log])
    fused = joined.withColumn("posterior", _softmax(total)).withColumn("probability", F.array_max("posterior"))
    names = F.split(F.lit(",".join(model.languages)), ",")
    language = F.when(F.col("letters"), F.element_at(names, F.array_position("posterior", F.col("probability")).cast("int"))).otherwise(UNKNOWN)
    fused = fused.withColumn("language", language)
    accepted = F.col("letters") & (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST)
    return fused.select(*unpacked(rest), "language", "probability", accepted.alias("accepted"))


_LANG = re.compile(r"""(?:^|[\s"'/])(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z-]+)""", re.I)


def _evidence(page: str | None) -> tuple[str, str | None]:
    """(text, declared language) of a page, read once from left to right."""
    parts, declared, seen = [], None, False
    for kind, what, rest in htmltext._Scanner(page or "").tokens():
        if kind == "text":
            parts.append(what)
        elif kind == "open" and what == "html" and not seen:
            found, seen = _LANG.search(rest), True
            declared = found[1] if found else None
    return entities.unescape(" ".join(parts)), declared


def page_evidence(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with `text` (the page without scripts, styles, comments and tags, its references decoded), `declared` (the
    lang of the first html tag) and `host`; columns of these names are replaced.

    A null page has an empty text and declares nothing. A page is read once from left to right, however long or broken
    it is: what follows a tag that is never closed is text, and what follows an unclosed script or comment is dropped.
    Repeated pages are kept; an empty table gives no rows.
    """
    rest = [c for c in pages.columns if c not in ("text", "declared", "host")]
    slim = pages.select(packed(pages, rest).alias("row"), pages[html].cast("string").alias("html"), host_of(pages[url]).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                text, declared = zip(*(_evidence(h.as_py()) for h in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(declared, pa.string()), part.column(2)], names=["row", "text", "declared", "host"])

    read = slim.mapInArrow(run, schema_of(slim.select("row"), "text string, declared string, host string"))
    return read.select(*unpacked(rest), "text", "declared", "host")


def accepted_only(df: DataFrame, model: TextModel, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of df whose language is known, columns unchanged; rejected rows are found by key, text and evidence, so
    rows that repeat a key or a text each have their own fate."""
    parts = [c for name in (text, declared, host) for c in (df[name].isNull(), df[name])]
    # the caller's row goes as one struct, so that no column of it can clash with those added here
    rows = df.select(packed(df).alias("row"), F.coalesce(df[key].cast("string"), F.lit("")).alias("key"), F.xxhash64(*parts).alias("hash"))
    asked = df.select(F.coalesce(df[key].cast("string"), F.lit("")).alias("key"), F.xxhash64(*parts).alias("hash"), df[text].alias("text"), df[declared].alias("declared"), df[host].alias("host"))
    rejected = stored(identify(asked, model).where(~F.col("accepted")).select("key", "hash").distinct(), "rejected")
    return rows.join(rejected, ["key", "hash"], "left_anti").select(*unpacked(df.columns))
