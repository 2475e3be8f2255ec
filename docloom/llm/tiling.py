"""Benchmark decontamination by greedy string tiling.

Documents that share a run of `min_match` words with a benchmark item are tiled against it: the longest
common run of unmarked words is marked again and again (running Karp-Rabin finds the runs), so passages
are caught whatever the order of their parts.  A document is contaminated by an item if its tiles cover
`threshold` of the item's words.

Words are runs of letters and digits, A-Z lower-cased, so punctuation and spacing don't hide a passage.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.blocks import bounded, cut, fresh, row_key, text_rows
from docloom.llm.tokens import NOT_ALNUM, U, Words, mix, slices, window_hashes

MIN_MATCH = 5
THRESHOLD = 0.6
#: The benchmark's text is broadcast up to this size; a larger one is joined by its seeds.
BROADCAST_BYTES = 32 << 20
#: Bits of the fixed-size filter of seeds used for a larger benchmark.
FILTER_LOG2 = 24
#: Pairs of matching windows that are looked at together; bounds a task's memory on texts that repeat one word.
PAIRS = 1 << 20
RESULT = "doc_id long, item_id long, item_words long, covered_words long, coverage double, tiles array<struct<doc_start:long,item_start:long,length:long>>"
TILES = pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))


def normal_words(column: pa.Array) -> Words:
    return Words(column, lower=True, breaks=NOT_ALNUM)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (doc start, item start, length) of each tile.

    The longest common run of unmarked words is always marked next; of equally long ones the first in the
    document, then in the item.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, length = [], max(min_match, len(item) // 2)
    while length <= len(item):
        matches = _matches(doc, item, free_doc, free_item, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:  # look for the very long ones first
            length = longest
            continue
        queue = [(-n, i, j) for i, j, n in matches]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            open_ = free_doc[i : i - n] & free_item[j : j - n]
            if not open_.all():  # a longer tile has taken a part: what is left of it competes again
                edge = np.flatnonzero(np.diff(np.r_[False, open_, False].astype(np.int8))).reshape(-1, 2)
                for a, z in edge.tolist():
                    if z - a >= length:
                        heapq.heappush(queue, (a - z, i + a, j + a))
                continue
            free_doc[i : i - n] = free_item[j : j - n] = False
            tiles.append((i, j, -n))
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return tiles


def _matches(doc, item, free_doc, free_item, length) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked words, at least `length` long, by the rolling hashes of their windows.

    Windows that match one after the other lie on one diagonal (place in the document less place in the item) and
    make one run; at most PAIRS pairs of windows are looked at together.
    """
    if len(doc) < length or len(item) < length:
        return []
    starts = []
    for words, free in ((doc, free_doc), (item, free_item)):
        taken = np.r_[0, np.cumsum(~free)]
        starts.append(np.flatnonzero(taken[length:] == taken[: len(words) - length + 1]))
    h_doc, h_item = window_hashes(doc, length)[starts[0]], window_hashes(item, length)[starts[1]]
    order = np.argsort(h_item, kind="stable")
    lo, hi = np.searchsorted(h_item[order], h_doc, "left"), np.searchsorted(h_item[order], h_doc, "right")
    hit = np.flatnonzero(hi > lo)
    lo, count, at = lo[hit], (hi - lo)[hit], starts[0][hit]
    total = np.r_[0, np.cumsum(count)]
    runs_ = []
    first = 0
    while first < len(hit):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
        n = count[first:last]
        i = np.repeat(at[first:last], n)
        j = starts[1][order[np.repeat(lo[first:last] - (total[first:last] - total[first]), n) + np.arange(n.sum())]]
        runs_.append(_joined(i - j, i, i + 1))
        first = last
    if not runs_:
        return []
    diagonal, begin, end = _joined(*(np.concatenate(x) for x in zip(*runs_, strict=True)))
    return list(zip(begin.tolist(), (begin - diagonal).tolist(), (end - begin + length - 1).tolist(), strict=True))


def _joined(diagonal: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Stretches [begin, end) of diagonals, with those that meet made one."""
    order = np.lexsort((begin, diagonal))
    diagonal, begin, end = diagonal[order], begin[order], end[order]
    new = np.r_[True, (diagonal[1:] != diagonal[:-1]) | (begin[1:] != end[:-1])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
    return diagonal[new], begin[new], end[last]


class Benchmark:
    """Word hashes of the items and their seeds, the runs of `min_match` words (of all words in a shorter item)."""

    def __init__(self, ids: np.ndarray, column: pa.Array, min_match: int):
        words = normal_words(column)
        self.ids, self.min_match = ids, min_match
        self.items = [words.hashes[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
        seeds = {}
        for k, item in enumerate(self.items):
            n = min(min_match, len(item))
            if n:
                h = window_hashes(item, n)[: len(item) - n + 1]
                seeds.setdefault(n, []).append((h, np.full(len(h), k), np.arange(len(h))))
        #: By run length: seed hashes in order, their items and positions.
        self.seeds = {}
        for n, parts in seeds.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.seeds[n] = (h[order], item[order], at[order])

    def hits(self, words: Words):
        """(row, item, item position) of each seed found in a row."""
        out = []
        for n, (h, item, at) in self.seeds.items():
            place, own = words.windows(n)
            lo = np.searchsorted(h, own, "left")
            found = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == own)
            count = np.searchsorted(h, own[found], "right") - lo[found]
            at_seed = np.repeat(lo[found] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            out.append((np.repeat(words.rows[place[found]], count), item[at_seed], at[at_seed], np.full(len(at_seed), n)))
        return (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 4

    def search(self, column: pa.Array, threshold: float):
        """(row, what `judge` says) of each contaminated row and item."""
        words = normal_words(column)
        row, item, at, n = self.hits(words)
        order = np.lexsort((at, item, row))
        row, item, at, n = row[order], item[order], at[order], n[order]
        for a, z in _groups(row, item):
            reach = np.minimum(np.diff(np.r_[at[a:z], 1 << 40]), n[a:z]).sum()  # item words that seeds cover
            if reach >= threshold * len(self.items[item[a]]):
                r = int(row[a])
                found = self.judge(words.hashes[words.first[r] : words.first[r + 1]], int(item[a]), threshold)
                if found:
                    yield r, found

    def judge(self, doc: np.ndarray, k: int, threshold: float):
        item = self.items[k]
        tiles = tile(doc, item, min(self.min_match, len(item)))
        covered = sum(t[2] for t in tiles)
        if covered < threshold * len(item):
            return None
        return int(self.ids[k]), len(item), covered, covered / len(item), [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in tiles]


def _result(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), TILES]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item of which its tiles cover `threshold` or more.

    doc_id, item_id, item_words, covered_words, coverage, tiles (word positions).  Documents without such
    an item have no row; a document with several has one for each; repeated rows each have theirs.  Null or
    wordless texts and items match nothing.  An item shorter than min_match words must occur whole.  A null
    doc_id stays null; items without an id are left out.  Whole texts are searched.  Empty tables give an
    empty result.  Only the named columns are read, so others may have any name.  Items of up to broadcast_bytes are sent to all tasks; with more, documents meet items in
    a join on the seeds behind a filter of fixed size.
    """
    rows = text_rows(docs, id_col, text_col)
    items = text_rows(benchmark, item_col, item_text_col).toDF("item_id", "text").where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return _by_broadcast(rows, items, min_match, threshold)
    return _by_seed_join(rows, items, min_match, threshold)


def _by_broadcast(rows: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    bench = _broadcast(items, min_match)

    def search(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi in slices(batch.column("text")):
                found = bench.value.search(batch.column("text").slice(lo, hi - lo), threshold)
                yield _result([(ids[lo + r].as_py(), *x) for r, x in found])

    return rows.mapInArrow(search, RESULT)


def _broadcast(items: DataFrame, min_match: int):
    held = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Benchmark(held.column("item_id").to_numpy(), held.column("text"), min_match))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates (see `contaminated`).

    Null, empty and wordless texts stay, repeated rows stay or go together, and columns keep their names whatever
    they are.  An empty benchmark leaves all documents.
    """
    items = text_rows(benchmark, item_col, item_text_col).toDF("item_id", "text").where("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > broadcast_bytes:
        row = fresh(docs, "_row")
        keyed = docs.withColumn(row, row_key(id_col, text_col))
        rows = keyed.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        bad = _by_seed_join(rows, items, min_match, threshold).select(F.col("doc_id").alias(row)).distinct()
        return keyed.join(bad, row, "left_anti").drop(row)
    bench = _broadcast(items, min_match)

    def clean(batches):
        for batch in batches:
            text = batch.column(text_col)
            ok = np.ones(len(batch), bool)
            for lo, hi in slices(text):
                for r, _ in bench.value.search(text.slice(lo, hi - lo), threshold):
                    ok[lo + r] = False
            yield batch.filter(pa.array(ok))

    return bounded(docs).mapInArrow(clean, docs.schema)


def _groups(row: np.ndarray, item: np.ndarray):
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]), True]) if len(row) else np.zeros(1, int)
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _by_seed_join(rows: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """The same pairs without sending the items to every task.

    Tiles that cover threshold of an item's words hold that many words / min_match of its seeds at least, so one of
    any seeds but so many less one is among them: candidates are asked for without the item's most common seeds,
    and a seed that all items have makes no pairs.
    """

    def item_seeds(batches):
        for batch in batches:
            b = Benchmark(batch.column("item_id").to_numpy(), batch.column("text"), min_match)
            for n, (h, item, _) in b.seeds.items():
                needed = [max(1, int(np.ceil(threshold * len(b.items[k]) / n - 1e-9))) for k in item.tolist()]
                yield pa.record_batch([pa.array(mix(h + U(n)).view(np.int64)), pa.array(b.ids[item]), pa.array(needed, pa.int64())], ["seed", "item_id", "needed"])

    places = cut(items.mapInArrow(item_seeds, "seed long, item_id long, needed long"))
    common = places.groupBy("seed").agg(F.count(F.lit(1)).alias("places"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("places"), "seed"))
    seeds = cut(places.join(common, "seed").withColumn("rank", rank).where("rank >= needed").select("seed", "item_id").distinct())
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_LOG2).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(1 << FILTER_LOG2, bool)
    bits[slots] = True
    passes = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))
    lengths = range(1, min_match + 1)

    def candidates(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                words = normal_words(batch.column("text").slice(lo, hi - lo))
                seed, row = [], []
                for n in lengths:
                    at, h = words.windows(n)
                    h = mix(h + U(n))
                    slot = (h >> U(64 - FILTER_LOG2)).astype(np.int64)
                    ok = (passes.value[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)
                    seed.append(h[ok])
                    row.append(words.rows[at[ok]])
                seed, row = np.concatenate(seed), np.concatenate(row)
                order = np.argsort(row, kind="stable")
                parts = np.split(seed[order].view(np.int64), np.cumsum(np.bincount(row, minlength=hi - lo))[:-1])
                own = batch.slice(lo, hi - lo)
                yield pa.record_batch([own.column("doc_id"), own.column("text"), pa.array([np.unique(p) for p in parts], pa.list_(pa.int64()))], ["doc_id", "text", "seeds"]).filter(pa.array([len(p) > 0 for p in parts], pa.bool_()))

    found = cut(rows.mapInArrow(candidates, "doc_id long, text string, seeds array<long>").withColumn("row", F.monotonically_increasing_id()))
    pairs = found.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item_id").distinct()
    both = pairs.join(found.select("row", "doc_id", "text"), "row").join(items.toDF("item_id", "item"), "item_id")

    def compare(batches):
        for batch in batches:
            out = []
            for r in range(len(batch)):
                b = Benchmark(batch.column("item_id").slice(r, 1).to_numpy(), batch.column("item").slice(r, 1), min_match)
                found = b.judge(normal_words(batch.column("text").slice(r, 1)).hashes, 0, threshold)
                if found:
                    out.append((batch.column("doc_id")[r].as_py(), *found))
            yield _result(out)

    return both.select("doc_id", "text", "item_id", "item").mapInArrow(compare, RESULT)
