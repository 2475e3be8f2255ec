"""Spark plumbing shared by the corpus operators.

Hash statistics of a corpus have billions of tiny entries.  A task therefore packs the entries that
go to the same hash range into one binary row per array; Spark shuffles the rows by range and a task of the
next stage reads one range at a time.  Documents come to such a task in blocks of about `BLOCK_CHARS`
characters (`dealt`), and a block sends each distinct hash once: however many documents have it, a range
gets one entry a block, and answers that one.  The numbers of ranges and blocks follow the input.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.scratch import scratch, shared_root

#: Characters of text in a block, and for which one range of hashes is kept; the smaller one where a block holds a number for each of its words.
BLOCK_CHARS, WORD_BLOCK_CHARS = 24_000_000, 16_000_000
#: Blocks and ranges of a small corpus, so that it too is spread over a cluster's tasks.
LEAST_BLOCKS = 32
#: Entries that a task holds before it ships them.
FLUSH = 2_000_000
#: Bytes of an Arrow batch that goes to Python; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
ZSTD = pa.Codec("zstd", 1)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def bounded(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session's Arrow batches are bounded in bytes, as rows can be of any length."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files whose lineage has been cut go now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name after underscores, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """64-bit name of a row by its id and text; equal rows share it."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for tables that an operator writes."""
    return scratch(spark, name)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, under fixed names; other columns never reach the scan."""
    return bounded(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def n_blocks(docs: DataFrame, text_col: str = "text", per: int = BLOCK_CHARS) -> int:
    """How many hash ranges this corpus needs: one pass over the lengths, one number to the driver."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-total // per))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Range of each 64-bit hash, from its upper bits."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def split(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts by bucket, in their order within each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = [a[order] for a in arrays]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[lo]), [a[lo:hi] for a in arrays]


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return start, np.diff(np.r_[start, len(key)])


def block_schema(n: int) -> str:
    return "bucket int, " + ", ".join(f"b{i} binary" for i in range(n))


def block_batch(rows: Iterable[tuple[int, list[np.ndarray]]], n: int) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([a[i].tobytes() for _, a in rows], pa.binary()) for i in range(n))], ["bucket", *(f"b{i}" for i in range(n))])


def joined(table: pa.Table, i: int, kind) -> np.ndarray:
    """Array i of all blocks of a group, end to end."""
    return np.frombuffer(b"".join(x.as_py() for x in table.column(f"b{i}")), kind)


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as compressed bytes, those of the same weight side by side; of ascending ones the steps."""
    own = values.astype(np.uint64)
    own = np.diff(own, prepend=np.uint64(0)) if ascending else own
    planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8).T)
    return len(own).to_bytes(8, "little") + ZSTD.compress(planes, asbytes=True)


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(ZSTD.decompress(data[8:], 8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    own = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(own, dtype=np.uint64) if ascending else own


def integers(table: pa.Table, i: int, ascending: bool = False) -> list[np.ndarray]:
    """The packed arrays of a column."""
    return [unpacked(x.as_py(), ascending) for x in table.column(f"b{i}")]


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, text (null: empty) and block of each row: n blocks by a hash of id and text, so a row has the same block whenever it is asked for."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("block"))


def per_bucket(blocks: DataFrame, fn, schema: str) -> DataFrame:
    """fn(Table) -> Table for each hash range."""
    return blocks.groupBy("bucket").applyInArrow(fn, schema)
