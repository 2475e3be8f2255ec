"""Substring dedup: words in windows that already occur in a document with a smaller id are removed.

Documents are dealt to blocks; a block computes the Rabin-Karp hash of every window of `k` words and sends
each distinct hash, with the smallest id that has it, to the hash's range.  There Spark's groups bring all
blocks' entries together: a window belongs to the smallest id of all, and every block whose own smallest id is
larger gets the hash back.  The block then marks the taken windows in its whole texts and merges them into
maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import WORD_BLOCK_CHARS, bucket_of, dealt, integers, n_blocks, packed, runs, split, text_rows
from docloom.llm.tokens import Words, slices

K = 50
#: Stands for a null id: after all ids.
NO_ID = (1 << 63) - 1
NONE = np.zeros(0, np.uint64)


def ids_of(column) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def pieces(table: pa.Table):
    """Slices of a block's rows with about a chunk of text each, one row at least."""
    for batch in table.to_batches():
        for lo, hi in slices(batch.column("text")):
            yield batch.slice(lo, hi - lo)


def block_windows(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct window hashes in order, the smallest id that has each, and whether another id has it too."""
    hashes, ids = [NONE], [np.zeros(0, np.int64)]
    for part in pieces(table):
        words = Words(part.column("text"))
        at, h = words.windows(k)
        hashes.append(h)
        ids.append(ids_of(part.column("doc_id"))[words.rows[at]])
    h, doc = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    start, _ = runs(h)
    if not len(start):
        return h, doc, np.zeros(0, bool)
    least = np.minimum.reduceat(doc, start)
    return h[start], least, np.maximum.reduceat(doc, start) > least


def window_entries(docs: DataFrame, k: int, n: int) -> DataFrame:
    """(block, range) with the block's distinct hashes there (b0) and the smallest id of each: a place (b1) in a list (b2)."""

    def pack(table: pa.Table) -> pa.Table:
        h, least, _ = block_windows(table, k)
        rows = []
        for b, (own, ids) in split(bucket_of(h, n), [h, least]):
            names, place = np.unique(ids, return_inverse=True)
            rows.append((b, packed(own, ascending=True), packed(place), names.tobytes()))
        block = table.column("block")[0].as_py()
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["block", "bucket", "b0", "b1", "b2"])

    return docs.groupBy("block").applyInArrow(pack, "block int, bucket int, b0 binary, b1 binary, b2 binary")


def taken_elsewhere(entries: DataFrame) -> DataFrame:
    """(block, b0): hashes of a block that a document of another block with a smaller id has too."""

    def judge(table: pa.Table) -> pa.Table:
        hashes = integers(table, 0, ascending=True)
        ids = [np.frombuffer(names.as_py(), np.int64)[place.astype(np.int64)] for place, names in zip(integers(table, 1), table.column("b2"), strict=True)]
        h, least = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(h, kind="stable")
        start, count = runs(h[order])
        first = np.empty(len(h), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(least[order], start), count)
        taken = np.split(first < least, np.cumsum([len(x) for x in hashes])[:-1])
        rows = [(block, packed(own[t], ascending=True)) for block, own, t in zip(table.column("block").to_pylist(), hashes, taken, strict=True) if t.any()]
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int32()), "b0": pa.array([x for _, x in rows], pa.binary())})

    return entries.groupBy("bucket").applyInArrow(judge, "block int, b0 binary")


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words the windows of k words from these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:n]) > 0


def intervals(covered: np.ndarray) -> np.ndarray:
    """Maximal runs of covered words as rows (start, end)."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return edge.reshape(-1, 2)


def dedup_substrings(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (word intervals [start, end)) and kept_text for each row.

    Words are split at space and 0x09-0x0D and compared as they are.  A null text is empty; texts under k
    words are kept.  A null id counts as after all ids (rows without id never take words from each other).
    Repeated rows have equal results, as a window is only taken by a smaller id.  Text of any length is
    handled whole.  An empty table gives an empty result.  Only the named columns are read.
    """
    n = n_blocks(docs, text_col, WORD_BLOCK_CHARS)
    rows = dealt(text_rows(docs, id_col, text_col), n)
    taken = taken_elsewhere(window_entries(rows, k, n))

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        elsewhere = np.sort(np.concatenate([NONE, *integers(answers, 0, ascending=True)]))
        h, least, several = block_windows(table, k)
        shared, owner = h[several], least[several]
        out = []
        for part in pieces(table):
            ids, words = ids_of(part.column("doc_id")), Words(part.column("text"))
            at, own = words.windows(k)
            hit = found(elsewhere, own)[0]
            inside, place = found(shared, own)
            hit[inside] |= owner[place[inside]] < ids[words.rows[at[inside]]]
            covered = cover(at[hit], k, len(words.starts))
            n_removed, removed, kept = [], [], []
            for r, text in enumerate(part.column("text").to_pylist()):
                spans = intervals(covered[words.first[r] : words.first[r + 1]]).tolist()
                left = text.encode().split()
                for a, z in reversed(spans):
                    del left[a:z]
                n_removed.append(sum(z - a for a, z in spans))
                removed.append(spans)
                kept.append(b" ".join(left).decode())
            out.append(pa.record_batch([part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept_text"]))
        return pa.Table.from_batches(out)

    return rows.groupBy("block").cogroup(taken.groupBy("block")).applyInArrow(strip, "doc_id long, n_words long, n_removed long, removed array<array<long>>, kept_text string")


def found(among: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the ascending ones, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values, at
