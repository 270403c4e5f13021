"""Token counts of documents in flat files of token ids: the separators are searched for, block by block."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridscore.session import shared_folder, stored

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level vocabularies of this family split a text into words (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id after a document's last token; free in the vocabulary. Ids are little-endian unsigned 16-bit integers.
SEPARATOR, ID = 50256, np.dtype("<u2")
BLOCK_BYTES = 1 << 22


@lru_cache(2)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as file:
        pairs = dict(line.split() for line in file if line.strip())
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks={base64.b64decode(k): int(v) for k, v in pairs.items()}, special_tokens={})


def write_flat(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", ranks: str = RANKS, separator: int = SEPARATOR) -> DataFrame:
    """Write each partition of df as a flat file of ids under folder (a URI that executors can write to).

    Every document is its ids and a separator; a null text is the separator alone. Returns `file`, `at` (the
    document's place in its file) and key, as a written table: a task that is run again writes another file, and only
    the files of tasks that Spark counted are named there.
    """
    slim = df.select(df[key].alias("_id"), df[text].cast("string").alias("_text"))
    kind = dict(slim.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoding(ranks)
        if separator < tool.n_vocab:
            raise ValueError("the separator is a token")
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        name, count, out = f"{uuid.uuid4().hex}.ids", 0, None
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}")
            for t in batch.column(1):
                ids = np.array([*tool.encode_ordinary(t.as_py() or ""), separator], dtype=ID)
                out.write(ids.tobytes())
            places = np.arange(count, count + len(batch))
            count += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), pa.array(places), batch.column(0)], names=["file", "at", "_id"])
        if out is not None:
            out.close()

    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1], recursive=True)
    return stored(slim.mapInArrow(run, f"file string, at long, _id {kind}"), "places").withColumnRenamed("_id", key)


def count_tokens(files: DataFrame, folder: str, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, at and n_tokens of each document in the flat files under folder that `files` (file) names.

    Files have no index. Each is cut into blocks of block_bytes; a task finds the separators of a block at once and
    gives their number, where the first and the last lie, and the distances between them. A running count and a
    running maximum over a file's blocks (one row a block) then number the documents and find, for the first separator
    of a block, the last one of the blocks before it. Ids after a file's last separator are a document of their own;
    an empty file has none. Nothing but counts leaves the tasks.
    """
    per = max(1, block_bytes // ID.itemsize)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [info.size // ID.itemsize for info in fs.get_file_info([f"{path}/{name}" for name in names])] if names else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["file", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, ids, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = block * per
                with fs.open_input_file(f"{path}/{name}") as file:
                    data = np.frombuffer(file.read_at(min(per, ids - start) * ID.itemsize, start * ID.itemsize), dtype=ID)
                found = np.flatnonzero(data == separator) + start
                if start + len(data) == ids and (not len(found) or found[-1] != ids - 1):
                    found = np.append(found, ids)  # the file ends as if a separator followed
                ends = [None, None] if not len(found) else [int(found[0]), int(found[-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(found)], pa.int64()), pa.array(ends[:1], pa.int64()), pa.array(ends[1:], pa.int64()), pa.array([(np.diff(found) - 1).tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "found", "first", "last", "between"],
                )

    listed = files.select("file").distinct().mapInArrow(sizes, "file string, ids long")
    blocks = listed.where("ids > 0").select("file", "ids", F.explode(F.expr(f"sequence(0L, (ids - 1) div {per}L)")).alias("block"))
    scanned = blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, found long, first long, last long, between array<long>")
    scanned = stored(scanned, "scanned")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the window sees one row of three numbers a block, and the distances stay where they are
    before = scanned.select("file", "block", F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("at0"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last0"))
    stitched = scanned.where("found > 0").join(before, ["file", "block"])
    lengths = F.concat(F.array(F.col("first") - F.col("last0") - 1), "between")
    return stitched.select("file", "at0", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("at0") + F.col("k")).alias("at"), "n_tokens")


def document_tokens(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of each row of df: written to flat files in the shared folder, scanned, and the files removed.

    Null and empty texts have no tokens; repeated rows are counted each; null keys are kept; an empty table gives no
    rows.
    """
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    places = write_flat(df, folder, key, text)
    counts = stored(count_tokens(places, folder), "counts")
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.delete_dir(path)
    return places.join(counts, ["file", "at"]).select(key, "n_tokens")
