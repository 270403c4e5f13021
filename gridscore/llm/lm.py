"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation beside a smoothed unigram base."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscore.llm.rows import packed, schema_of, unpacked
from gridscore.session import stored

#: The most frequent words are symbols of their own; all others share a symbol with those of the same shape.
OWN, SHAPES = 767, 256
#: Numbers a symbol has, words of context, and the additive count of the base.
WIDTH, CONTEXT, ADD = 24, 2, 0.1
#: Rounds over all training texts, positions a step, noise draws a step, the steps' size, and the seed.
ROUNDS, BATCH, NOISE, RATE, SEED = 1, 2048, 32, 0.05, 42
#: Words whose counts are sent to the tasks at most; those of all others are joined. Longer words go by their digest.
FREQUENT, LONG = 1 << 18, 64
#: Positions trained on or scored in one go, at least; distinct words that a task counts before it hands them on.
CHUNK, HELD = 1 << 21, 1 << 18
#: Weights in a row, when those of tasks are averaged.
BLOCK = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than the six ASCII white-space characters."""
    return (text or b"").translate(_LOWER).split()


def key(word: bytes) -> bytes:
    """What a word is counted by: itself, or a digest behind a space, which no word holds."""
    return word if len(word) <= LONG else b" " + sha256(word).digest()


def shape(word: bytes) -> int:
    """The symbol of words that have none of their own: by their last three bytes."""
    return 1 + OWN + zlib.crc32(word[-3:]) % SHAPES


@dataclass
class Weights:
    """score(symbol | context) = sum over context places of (place * seen[word]) . asked[symbol] + bias[symbol]"""

    seen: np.ndarray
    asked: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.seen, self.asked, self.bias, self.place]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def from_flat(cls, x: np.ndarray) -> Weights:
        k = 1 + OWN + SHAPES
        shapes = [(k, WIDTH), (k, WIDTH), (k,), (CONTEXT, WIDTH)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*[np.array(x[end - np.prod(s) : end], dtype=np.float32).reshape(s) for end, s in zip(ends, shapes, strict=True)])

    @classmethod
    def start(cls, share: np.ndarray) -> Weights:
        """The unigram model: small random vectors, logarithms of the symbols' shares as biases."""
        rng, k = np.random.default_rng(SEED), len(share)
        small = [rng.normal(scale=0.1, size=(k, WIDTH)).astype(np.float32) for _ in range(2)]
        return cls(small[0], small[1], np.log(share).astype(np.float32), np.ones((CONTEXT, WIDTH), dtype=np.float32))

    def context(self, before: np.ndarray) -> np.ndarray:
        """A vector for each row of `before`: the symbols before a position, the nearest first."""
        return sum(self.seen[before[:, i]] * self.place[i] for i in range(CONTEXT))

    def normalisers(self, before: np.ndarray) -> np.ndarray:
        """Logarithm of the sum over all symbols of exp(score), by batched matrix products."""
        out = np.empty(len(before), dtype=np.float64)
        asked, ones = np.concatenate([self.asked.T, self.bias[None]]), np.ones(len(self.bias), dtype=np.float32)
        h = np.ones((512, WIDTH + 1), dtype=np.float32)
        for k in range(0, len(before), len(h)):
            part = before[k : k + len(h)]
            h[: len(part), :WIDTH] = self.context(part)
            z = h[: len(part)] @ asked
            most = 0.0 if z.max() < 80 else z.max(1)[:, None]  # beyond that, exp() would overflow
            out[k : k + len(h)] = np.log(np.exp(z - most if np.ndim(most) else z, out=z) @ ones) + np.ravel(most)
        return out

    def log_probabilities(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithms of the symbols' probabilities; a context that repeats is normalised once."""
        k = len(self.bias)
        code = before @ (k ** np.arange(CONTEXT, dtype=np.int64))
        there = np.zeros(k**CONTEXT, dtype=bool)
        there[code] = True
        found = np.flatnonzero(there)
        each = np.zeros(len(there))
        each[found] = self.normalisers(np.stack([found // k**i % k for i in range(CONTEXT)], 1))
        out = -each[code]
        for j in range(0, len(symbols), 1 << 16):
            part = slice(j, j + (1 << 16))
            out[part] += np.einsum("nd,nd->n", self.context(before[part]), self.asked[symbols[part]]) + self.bias[symbols[part]]
        return out


@dataclass
class Model:
    """What the training texts hold: `counts` is a stored table (word, n, shape) of all their distinct words."""

    counts: DataFrame
    own: dict[bytes, int]
    frequent: dict[bytes, int]
    ends: int
    tokens: int
    distinct: int
    #: words and their distinct number that share a shape's symbol
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray
    weights: Weights

    def share(self) -> np.ndarray:
        """Of all training tokens, the share that each symbol has; none is zero."""
        n = np.full(1 + OWN + SHAPES, ADD)
        n[0] += self.ends
        for w, k in self.own.items():
            n[k] += self.frequent[w]
        n[1 + OWN :] += self.shape_tokens
        return n / n.sum()


def _positions(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, the symbols before each) of documents' symbols; each document is followed and preceded by ends."""
    pad, end = np.zeros(CONTEXT, dtype=np.int32), np.zeros(1, dtype=np.int32)
    line = np.concatenate([x for d in docs for x in (pad, d, end)])
    own = np.ones(len(line), dtype=bool)
    starts = np.cumsum([0, *[len(d) + CONTEXT + 1 for d in docs[:-1]]])
    own[(starts[:, None] + np.arange(CONTEXT)).ravel()] = False
    at = np.flatnonzero(own)
    return line[at], np.stack([line[at - 1 - i] for i in range(CONTEXT)], 1)


def _added(rows: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of values that have each number below k."""
    width = values.shape[1]
    return np.bincount((rows[:, None] * width + np.arange(width)).ravel(), weights=values.ravel(), minlength=k * width).reshape(k, width)


class _Trainer:
    """Noise-contrastive estimation by steps of adaptive size, one task's share of the texts."""

    def __init__(self, weights: Weights, share: np.ndarray, rate: float, seed: int):
        self.weights, self.rate, self.rng = replace(weights, **{n: getattr(weights, n).copy() for n in ("seen", "asked", "bias", "place")}), rate, np.random.default_rng(seed)
        self.below, self.log_share = np.cumsum(share), np.log(share).astype(np.float32)
        self.squares = [np.full(p.shape, 1e-2) for p in weights.parts()]
        self.positions = 0

    def step(self, symbols: np.ndarray, before: np.ndarray) -> None:
        """Tell each symbol from NOISE draws, which all positions of the step share."""
        w, k = self.weights, len(self.log_share)
        noise = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE)), k - 1)
        h, asked, against = w.context(before), w.asked[symbols], w.asked[noise]
        odds = np.log(np.float32(NOISE)) + self.log_share
        real = np.einsum("nd,nd->n", h, asked) + w.bias[symbols] - odds[symbols]
        fake = h @ against.T + w.bias[noise] - odds[noise]
        up, down = 1 / (1 + np.exp(np.clip(real, -30, 30))), -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        dh = up[:, None] * asked + down @ against
        d_asked = _added(symbols, up[:, None] * h, k)
        np.add.at(d_asked, noise, down.T @ h)
        d_bias = np.bincount(symbols, weights=up, minlength=k) + np.bincount(noise, weights=down.sum(0), minlength=k)
        d_seen = _added(before.T.ravel(), (dh * w.place[:, None, :]).reshape(-1, WIDTH), k)
        d_place = np.stack([(dh * w.seen[before[:, i]]).sum(0) for i in range(CONTEXT)])
        for p, d, s in zip(w.parts(), (d_seen, d_asked, d_bias, d_place), self.squares, strict=True):
            s += d * d
            p += (self.rate * d / np.sqrt(s)).astype(np.float32)

    def learn(self, docs: list[np.ndarray]) -> None:
        symbols, before = _positions(docs)
        order = self.rng.permutation(len(symbols))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            self.step(symbols[part], before[part])
        self.positions += len(symbols)


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(df[text].cast("string").cast("binary").alias("text"))


def _counts(train: DataFrame) -> DataFrame:
    """(word, shape, n) of all words of a table of texts; a task counts before it hands on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> pa.RecordBatch:
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([key(w) for w in keys], pa.binary()), pa.array([shape(w) for w in keys], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "shape", "n"])

        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(words(t.as_py()))
                if len(found) >= HELD:
                    yield out(found)
                    found = Counter()
        if found:
            yield out(found)

    return train.mapInArrow(count, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def _trained(train: DataFrame, model: Model, rounds: int) -> Weights:
    """Every task trains on its texts from where the round began; their weights are averaged by positions."""
    share, weights, own = model.share(), model.weights, model.own
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights: Weights = weights, turn: int = turn) -> Iterator[pa.RecordBatch]:
            trainer = _Trainer(weights, share, RATE, SEED + turn)
            known = dict(own)
            held, size = [], 0
            for batch in batches:
                for t in batch.column(0):
                    found = words(t.as_py())
                    if len(known) > HELD:
                        known = dict(own)
                    for w in set(found).difference(known):
                        known[w] = shape(w)
                    held.append(np.array([known[w] for w in found], dtype=np.int32))
                    size += len(found) + 1
                    if size >= CHUNK // 8:
                        trainer.learn(held)
                        held, size = [], 0
            if held:
                trainer.learn(held)
            if trainer.positions:
                flat = trainer.weights.flat().astype(np.float64)
                parts = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(trainer.positions)] * len(parts)), pa.array(parts, pa.list_(pa.float64()))], names=["block", "positions", "weights"])

        each = train.mapInArrow(run, "block int, positions double, weights array<double>").withColumn("v", array_to_vector("weights"))
        mean = each.groupBy("block").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("positions"))).alias("weights")).orderBy("block").collect()
        if not mean:
            break
        weights = Weights.from_flat(np.concatenate([np.array(r.weights) for r in mean]))
    return weights


def fit(train: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Count all words of all rows of `train` and train the log-bilinear model on all of them.

    Counts are summed by word over the cluster and stored. The OWN most frequent words (ties: by bytes) become symbols;
    a model over them, the shapes of all other words and the end of a text is trained in `rounds` rounds, in which
    tasks train on the texts they hold and send their weights (1 + OWN + SHAPES symbols, whatever the input), averaged
    by Spark. What comes to the driver is that, and the counts of at most FREQUENT words. A null text counts as empty;
    every row counts, copies too. Without rows the model is the base's: all symbols alike.
    """
    texts = _texts(train, text)
    counts = stored(_counts(texts), "words")
    most = counts.where("substring(word, 1, 1) <> X'20'").orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = {bytes(r.word): 1 + i for i, r in enumerate(most)}
    # how often a word must occur so that no more than FREQUENT words do
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    levels = sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect(), reverse=True)
    above, least = 0, None
    for r in levels:
        above += r.k
        if above > FREQUENT:
            break
        least = r.l
    listed = counts.where(F.lit(False) if least is None else level >= least).select("word", "n").toArrow()
    frequent = dict(zip(listed["word"].to_pylist(), listed["n"].to_pylist(), strict=True))
    frequent |= {bytes(r.word): r.n for r in most}
    by_shape = {r["shape"]: (r.n, r.k) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    n, k = (np.array([by_shape.get(1 + OWN + s, (0, 0))[i] for s in range(SHAPES)], dtype=np.float64) for i in (0, 1))
    tokens, distinct = int(n.sum()), int(k.sum())
    for w in own:
        n[shape(w) - 1 - OWN] -= frequent[w]
        k[shape(w) - 1 - OWN] -= 1
    ends = texts.count()
    model = Model(counts, own, frequent, ends, tokens + ends, distinct + bool(ends), n, k, None)
    model.weights = Weights.start(model.share())
    return replace(model, weights=_trained(texts, model, rounds))


class _Scorer:
    """What a task needs to score texts as far as the frequent words go."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.place = {w: i for i, w in enumerate(model.frequent)}
        c = np.array(list(model.frequent.values()), dtype=np.float64)
        self.symbols = np.array([model.own.get(w) or (shape(w) if w[:1] != b" " else 0) for w in model.frequent], dtype=np.int32)
        self.base_total = np.log10(model.tokens + ADD * (model.distinct + 1))
        self.shape_total = np.log10(model.shape_tokens + ADD * (model.shape_distinct + 1))
        self.base = np.log10(c + ADD)
        #: what a word adds to its symbol's probability: its share of the shape's words, nothing if the symbol is its own
        self.within = np.where(self.symbols > OWN, self.base - self.shape_total[np.maximum(self.symbols - 1 - OWN, 0)], 0.0)
        self.end = np.log10(model.ends + ADD)

    def read(self, text: bytes | None) -> tuple[np.ndarray, int, int, float, float, Counter]:
        """(symbols, tokens, known ones, base, what shapes' shares add, words to look up), the last not yet in the sums
        but for the totals that they are divided by."""
        found, rest = words(text), Counter()
        get = self.place.get
        at = np.array([get(w, -1) for w in found], dtype=np.int64)
        symbols = self.symbols[at] if len(self.symbols) else np.zeros(len(at), dtype=np.int32)
        there = at[at >= 0]
        base, within = float(self.base[there].sum()) + self.end, float(self.within[there].sum())
        for i in np.flatnonzero(at < 0).tolist():
            symbols[i] = shape(found[i])
            within -= self.shape_total[symbols[i] - 1 - OWN]
            rest[key(found[i])] += 1
        return symbols, len(found) + 1, len(there), base - (len(found) + 1) * self.base_total, within, rest

    def neural(self, docs: list[np.ndarray]) -> list[float]:
        """Log10 probability of each document's symbols."""
        symbols, before = _positions(docs)
        each = self.weights.log_probabilities(symbols, before) / np.log(10)
        return np.add.reduceat(each, np.cumsum([0, *[len(d) + 1 for d in docs[:-1]]])).tolist()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without `text`, with `n_tokens`, `n_known`, `base_score` and `score`, log10 probabilities of the whole text.

    Each token's probability is its symbol's, normalised over all symbols, times the word's smoothed share of its shape.
    Words beyond the FREQUENT ones are looked up by a join; only they are shuffled, counted by text. A null text counts
    as empty (its end alone), repeated rows get equal scores, an empty table gives none; columns that clash with the
    added ones are replaced.
    """
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "base_score", "score")]
    slim = docs.select(packed(docs, rest).alias("row"), docs[text].cast("string").cast("binary").alias("text"))
    plain = replace(model, counts=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(plain)
        rows, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            read, neural = held, scorer.neural([x[0] for x in held])
            lookups = pa.array([[{"word": w, "n": n} for w, n in x[5].items()] for x in read], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            columns = [pa.array([x[1] for x in read], pa.int64()), pa.array([x[2] + (plain.ends > 0) for x in read], pa.int64()), pa.array([x[3] for x in read]), pa.array([s + x[4] for s, x in zip(neural, read, strict=True)]), lookups]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *columns], names=["row", "n_tokens", "n_known", "base_score", "score", "rest"])

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(scorer.read(batch.column(1)[i].as_py()))
                rows.append(batch.column(0).slice(i, 1))
                size += held[-1][1]
                if size >= CHUNK:
                    yield out()
                    rows, held, size = [], [], 0
        if held:
            yield out()

    schema = schema_of(slim.select("row"), "n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, n: bigint>>")
    read = stored(slim.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "scored")
    asked = read.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n")
    looked = asked.join(model.counts.select("word", F.col("n").alias("c")), "word", "left")
    more = looked.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"))
    joined = read.join(more, "uid", "left")
    added = F.coalesce("more", F.lit(0.0))
    return joined.select(*unpacked(rest), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + added).alias("base_score"), (F.col("score") + added).alias("score"))
