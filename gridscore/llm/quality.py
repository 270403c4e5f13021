"""A compression classifier: how much better a text packs with a dictionary of good text than with one of bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.session import stored

#: Texts are packed in pieces of so many bytes, each from a fresh start, so that a dictionary counts for all of a text.
PIECE = 2048
#: Of labelled rows, at most so many of each class are fitted on, and a dictionary has so many bytes, equal shares of each.
ROWS, DICTIONARY, LEVEL = 1500, 1 << 18, 12


@dataclass
class Model:
    """Two dictionaries and the weights of a logistic curve over 1 and the features of _Packer."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class _Packer:
    def __init__(self, model: Model):
        self.tools = []
        for data in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, ...]:
        """(bad - good) / (bad + good) of the packed sizes, over all pieces and over the fifth of pieces where it is least;
        the logarithm of the packed share of the text, which tells text that repeats itself from text that is merely
        unlike both dictionaries."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad, least = 0, 0, []
        for k in range(0, max(1, len(data) - PIECE // 4 + 1), PIECE):  # a short rest goes with the last piece
            piece = data[k : k + PIECE] if len(data) - k - PIECE >= PIECE // 4 else data[k:]
            g, b = (len(tool.compress(piece)) for tool in self.tools)
            good, bad = good + g, bad + b
            least.append((b - g) / (b + g))
        if not data:
            return 0.0, 0.0, 0.0
        each = np.sort(least)
        return (bad - good) / (bad + good), float(each[: -(-len(each) // 5)].mean()), min(0.0, math.log((good + bad) / (2.0 * len(data))))

    def score(self, text: str | None, weights: tuple[float, ...]) -> float:
        z = weights[0] + sum(w * x for w, x in zip(weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _middle(data: bytes, share: int) -> bytes:
    return data[(len(data) - share) // 2 if len(data) > share else 0 :][:share]


def _dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """Equal shares of every text, from its middle, cut to `size` bytes in all."""
    share = _share(len(texts), size)
    return b"".join(_middle(t, share) for t in texts)[-size:].ljust(8)


def _share(texts: int, size: int = DICTIONARY) -> int:
    return max(64, size // max(1, texts))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights for the columns of x, one and all, by Newton's method; the columns are scaled by their spread meanwhile."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[1:] / scale
    return np.concatenate([[w[0] - weights @ mean], weights])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> Model:
    """Fit on docs whose key has a label (1: good, 0: bad; other labels, nulls and repeats are ignored).

    The sample is drawn from `labels`, so no text moves for it: at most `rows` keys of each label, the first by hash,
    are looked for in docs. Their whole texts are packed in tasks, and no more than their shares of the dictionaries
    and three numbers a text come to the driver. Even ones fill the dictionaries that odd ones are scored with for the
    curve, and the other way round; the final dictionaries hold all. Without rows of both labels every score is 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 32))
    # a share of the keys that is expected to hold twice the rows asked for, so that the sort sees few
    drawn = [known.where((F.col("y") == y) & (draw < int(min(1, 2 * rows / n) * (1 << 32)))).orderBy(draw, "k").limit(rows) for y, n in sorted(counts.items())]
    none = Model(b" " * 8, b" " * 8, (0.0,) * 4)
    if len(drawn) < 2:
        return none
    keys = drawn[0].unionByName(drawn[1])  # 2 x rows keys at most
    found = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(keys), "k")
    place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("t"), "k")) - 1  # `rows` of them at most
    sample = stored(found.groupBy("k", "y").agg(F.min("t").alias("t")).withColumn("n", place), "sample")
    sizes = dict(sample.groupBy("y").count().collect())
    if min(sizes.get(y, 0) for y in (0, 1)) < 2:
        return none
    # a fold's shares are the larger ones, and those of all are their middles
    most = max(_share(n // 2) for n in sizes.values())
    middle = F.expr(f"substring(encode(t, 'utf-8'), greatest(1, (octet_length(t) - {most}) div 2 + 1), {most})")
    shares = sample.select("y", "n", middle.alias("t")).orderBy("n").collect()
    texts = [[bytes(r.t) for r in shares if r.y == y] for y in (0, 1)]
    folds = [Model(_dictionary(texts[1][fold::2]), _dictionary(texts[0][fold::2]), ()) for fold in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [_Packer(m) for m in folds]
        for batch in batches:
            for t, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([list(packers[1 - n % 2].features(t))], pa.list_(pa.float64()))], names=["y", "x"])

    seen = sample.select("t", "y", "n").repartition(max(1, len(shares) // 128), "y", "n").mapInArrow(measure, "y int, x array<double>").orderBy("y", "x").collect()
    weights = _logistic(np.array([r.x for r in seen]), np.array([r.y for r in seen], dtype=np.float64))
    return Model(_dictionary(texts[1]), _dictionary(texts[0]), tuple(weights.tolist()))


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df with `column`: 0 to 1, the higher the likelier good; the whole text is packed, a null one counts as empty.

    Rows are scored where they are, without a shuffle; the model (two dictionaries of DICTIONARY bytes) goes with the
    tasks. Repeated rows get equal scores; an empty table stays empty.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])
    at = df.columns.index(text)
    kept = [k for k, name in enumerate(df.columns) if name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(model)
        for batch in batches:
            found = [packer.score(t.as_py(), model.weights) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(found, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)
