"""Language-model scoring with context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 decision nodes has a context tree over the preceding
bytes.  A tree node keeps counts of zeros and ones, predicts with the Krichevsky-Trofimov estimate, and
is mixed with its children: ``Pw = (Pe + product of the children's Pw) / 2``; a child that no training
byte has reached predicts 1/2.

No node is dropped, and the trees grow with the corpus:

1. Documents are dealt to blocks of bounded size; a block sends each range of contexts its distinct
   grams (a byte with the bytes before it) and how often its training rows have them.  A range holds
   whole contexts of `CUT` bytes, so it can fold all deeper nodes.
2. The few nodes above that depth are folded by grouped sums, level by level, and the weights go down
   again in joins of a node with its parent.
3. A range mixes all depths for each gram and answers every block; a block then adds up its documents.

Words for the unigram score beside it are counted and answered in the same ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import bounded, bucket_of, cut, integers, joined, n_blocks, packed, release, runs, split
from docloom.llm.tokens import LOWER, U, Words, mix, slices, string_bytes

#: Context bytes of the longest contexts; 1 to 7.
DEPTH = 5
#: Nodes of contexts up to this long are folded by Spark, longer ones inside a range: 2**24 grams at most share a context of three bytes (DEPTH 5).
CUT = 3
#: Bytes of text whose grams are looked at together.
CHUNK = 1 << 20
NONE = np.zeros(0, U)


def grams(column: pa.Array, depth: int):
    """Pieces (grams, rows): each byte of each lower-cased text and a final 0 byte, with the `depth` bytes before it.

    The byte is the lowest of its gram, the one next before it the highest, and so on; before a text stand zeros.
    A text of any length comes in several pieces.
    """
    data, offsets = string_bytes(column)
    n = len(offsets) - 1
    begin = offsets[:-1] + np.arange(n) * (depth + 1)  # of a row's zeros, its bytes and the final zero
    padded = np.zeros(len(data) + n * (depth + 1), np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, np.diff(offsets))] = LOWER[data]
    for lo in range(depth, len(padded), CHUNK):
        hi = min(len(padded), lo + CHUNK)
        out = padded[lo:hi].astype(U)
        for j in range(1, depth + 1):
            out |= padded[lo - j : hi - j].astype(U) << U(8 * (depth + 1 - j))
        row = np.searchsorted(begin, np.arange(lo, hi), side="right") - 1
        real = np.arange(lo, hi) - begin[row] >= depth
        yield out[real], row[real]


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def added(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sums of their counts."""
    if not values:
        return np.zeros(0, U), np.zeros(0, np.int64)
    codes, distinct = pd.factorize(np.concatenate(values))
    sums = np.bincount(codes, np.concatenate(counts), len(distinct)).astype(np.int64)
    distinct = np.asarray(distinct, U)
    order = np.argsort(distinct)
    return distinct[order], sums[order]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2, by Stirling's series at x + 8.  Arrays or Columns."""
    y, low, log = x + 8, x, F.log if isinstance(x, Column) else np.log
    for i in range(1, 8):
        low = low * (x + i)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - log(low)


def log_kt(n0, n1):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order.  Arrays or Columns."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """Tree nodes of one depth: context (the nearest byte highest), decision node, counts and ln Pw; odds: ln(Pe / product of the children's Pw).

    up: each node's parent in the level above.
    """

    def __init__(self, depth, context, node, n0, n1, weighted, odds):
        self.depth, self.context, self.node, self.n0, self.n1, self.weighted, self.odds = depth, context, node, n0, n1, weighted, odds
        self.up: np.ndarray | None = None

    @classmethod
    def longest(cls, gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[Level, np.ndarray]:
        """The leaves of distinct grams that occur n times, and each gram's leaf at each of its eight decisions."""
        symbol, context = gram & U(255), gram >> U(8)
        key = np.concatenate([context << U(8) | (U(1 << k) + (symbol >> U(8 - k))) for k in range(8)])
        ones = np.concatenate([n * ((symbol >> U(7 - k)) & U(1)).astype(np.float64) for k in range(8)])
        key, place, (every, n1) = grouped(key, [np.tile(n.astype(np.float64), 8), ones])
        n0 = every - n1
        return cls(depth, key >> U(8), key & U(255), n0, n1, log_kt(n0, n1), np.full(len(key), np.inf)), place.reshape(8, -1)

    def fold(self) -> Level:
        d = self.depth - 1
        key, self.up, (n0, n1, split) = grouped(self.context >> U(8) << U(8) | self.node, [self.n0, self.n1, self.weighted])
        pe = log_kt(n0, n1)
        return Level(d, key >> U(8), key & U(255), n0, n1, np.logaddexp(pe, split) - math.log(2), pe - split)

    def mixed(self, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the nodes down to these give to a zero and a one, and the weight left to deeper ones; given is that of their parents."""
        stop = 1 / (1 + np.exp(-np.clip(self.odds, -700, 700)))
        total = self.n0 + self.n1 + 1
        return zero + rest * stop * (self.n0 + 0.5) / total, one + rest * stop * (self.n1 + 0.5) / total, np.where(np.isinf(self.odds), 0.0, rest * (1 - stop))


def grouped(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, each entry's place among them, and sums of the values."""
    order = np.argsort(key, kind="stable")
    start, count = runs(key[order])
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.arange(len(start)), count)
    return key[order][start], place, [np.add.reduceat(v[order], start) if len(start) else np.zeros(0) for v in values]


def range_of(context: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(context + U(0x9E3779B97F4A7C15)), n)


MESSAGE = "block int, bucket int, b0 binary, b1 binary, b2 binary, b3 binary"
NODE = "bucket int, context long, node int, n0 double, n1 double, weighted double, odds double"


def counted(rows: DataFrame, depth: int, n: int) -> DataFrame:
    """(block, range) with a block's distinct grams and words there, and their counts in its training rows.

    rows: doc_id, text, held_out, block.  b0, b1: grams (packed) and counts; b2, b3: words and counts.
    """
    low = min(CUT, depth)

    def count(table: pa.Table) -> pa.Table:
        g, g_n, w, w_n = [], [], [], []  # in pieces, which are added up now and then
        for batch in table.to_batches():
            text, learns = batch.column("text"), ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi in slices(text, CHUNK):
                part, own = text.slice(lo, hi - lo), learns[lo:hi]
                for values, row in grams(part, depth):
                    codes, distinct = pd.factorize(values)
                    g.append(np.asarray(distinct, U))
                    g_n.append(np.bincount(codes, own[row], len(distinct)))
                words = Words(part, lower=True)
                codes, distinct = pd.factorize(words.hashes)
                w.append(np.asarray(distinct, U))
                w_n.append(np.bincount(codes, own[words.rows], len(distinct)))
                if len(g) >= 16:
                    g, g_n = ([x] for x in added(g, g_n))
                    w, w_n = ([x] for x in added(w, w_n))
        gram, word = added(g, g_n), added(w, w_n)
        parts = {b: x for b, x in split(range_of(gram[0] >> U(8 * (depth - low + 1)), n), [gram[0], gram[1].astype(np.uint32)])}
        word_parts = {b: x for b, x in split(bucket_of(word[0], n), [word[0], word[1].astype(np.uint32)])}
        none = [NONE, np.zeros(0, np.uint32)]
        buckets = sorted({*parts, *word_parts})
        arrays = [[*parts.get(b, none), *word_parts.get(b, none)] for b in buckets]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(buckets), pa.int32()), pa.array(buckets, pa.int32()), *(pa.array([packed(a[i], ascending=True) if i % 2 == 0 else a[i].tobytes() for a in arrays], pa.binary()) for i in range(4))], ["block", "bucket", "b0", "b1", "b2", "b3"])

    return rows.groupBy("block").applyInArrow(count, MESSAGE)


def folded(table: pa.Table, depth: int) -> tuple[np.ndarray, list[Level], np.ndarray]:
    """A range's distinct grams, its levels from the longest contexts to those of CUT bytes, and the grams' leaves."""
    gram, n = added(integers(table, 0, True), [joined(table, 1, np.uint32)])
    level, leaves = Level.longest(gram, n, depth)
    levels = [level]
    while levels[-1].depth > min(CUT, depth):
        levels.append(levels[-1].fold())
    return gram, levels, leaves


def weighted_nodes(counts: DataFrame, depth: int) -> DataFrame:
    """Nodes of contexts of CUT bytes by range: what all nodes down to them give to a zero and a one, and the weight left (zero, one, rest)."""
    low = min(CUT, depth)

    def lift(key, table):
        top = folded(table, depth)[1][-1]
        return pa.table({"bucket": pa.array(np.full(len(top.node), key[0].as_py(), np.int32)), "context": pa.array(top.context.view(np.int64)), "node": pa.array(top.node.astype(np.int32)), "n0": top.n0, "n1": top.n1, "weighted": top.weighted, "odds": top.odds})

    levels = [cut(counts.select("bucket", "b0", "b1").groupBy("bucket").applyInArrow(lift, NODE))]
    for d in range(low - 1, -1, -1):
        sums = levels[-1].groupBy(F.shiftrightunsigned("context", 8).alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("split"))
        pe = sums.withColumn("pe", log_kt(F.col("n0"), F.col("n1")))
        both = F.greatest("pe", "split") + F.log1p(F.exp(-F.abs(F.col("pe") - F.col("split")))) - math.log(2)
        levels.append(cut(pe.select("context", "node", "n0", "n1", both.alias("weighted"), (F.col("pe") - F.col("split")).alias("odds"))))
    given = None
    for d in range(low + 1):
        level = levels[low - d]
        stop = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("odds")))))
        level = level.withColumn("stop", F.when(F.col("odds") == math.inf, 1.0).otherwise(stop)).withColumn("total", F.col("n0") + F.col("n1") + 1)
        if given is None:
            level = level.select("*", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("rest"))
        else:
            parent = given.select(F.col("context").alias("up"), F.col("node").alias("up_node"), "zero", "one", "rest")
            level = level.join(parent, (F.shiftrightunsigned(level["context"], 8) == F.col("up")) & (F.col("node") == F.col("up_node")))
        share = F.col("rest") * F.col("stop")
        keep = ["bucket"] if d == low else []
        given = level.select(*keep, "context", "node", (F.col("zero") + share * (F.col("n0") + 0.5) / F.col("total")).alias("zero"), (F.col("one") + share * (F.col("n1") + 0.5) / F.col("total")).alias("one"), (F.col("rest") * (1 - F.col("stop"))).alias("rest"))
    return given


def mixed_log10(table: pa.Table, top: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A range's distinct grams and log10 of each one's last byte given the bytes before it; top: its rows of weighted_nodes."""
    gram, levels, leaves = folded(table, depth)
    if not len(gram):
        return gram, np.zeros(0)
    key = top.column("context").to_numpy().view(U) << U(8) | top.column("node").to_numpy().astype(U)
    order = np.argsort(key)
    at = order[np.searchsorted(key[order], levels[-1].context << U(8) | levels[-1].node)]
    given = tuple(top.column(c).to_numpy()[at] for c in ("zero", "one", "rest"))
    for below in levels[-2::-1]:
        given = below.mixed(*(x[below.up] for x in given))
    symbol, total = gram & U(255), np.zeros(len(gram))
    for k in range(8):
        one = ((symbol >> U(7 - k)) & U(1)).astype(bool)
        total += np.log10(np.where(one, given[1][leaves[k]], given[0][leaves[k]]))
    return gram, total


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_bits double, bits_per_byte double"


def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits and bits_per_byte of each row.

    Learns from the rows whose crc32(id as text) mod `folds` is not `fold`.  score is log10 of the model's
    probability of the lower-cased text (A-Z) and its end; bits_per_byte is its code length over the bytes and
    the end.  base_score is the add-one word unigram of the same rows; words are split at space and
    0x09-0x0D, and each text has one end token.  A null text is empty: one end token.  A null id takes the
    fold of an empty text.  Repeated rows have equal results.  With no training rows every byte costs 8 bits
    and every word is unknown; an empty table gives an empty result.  Columns of other names are not read.
    """
    c = lambda name: F.col(f"`{name}`")
    n = n_blocks(docs, text_col)
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(c(id_col).cast("long"), text), F.lit(n)).cast("int")
    rows = bounded(docs).select(c(id_col).cast("long").alias("doc_id"), text.alias("text"), is_held_out(c(id_col), folds, fold).alias("held_out"), block.alias("block"))
    ends = rows.where(~F.col("held_out")).count()
    counts = cut(counted(rows, depth, n))
    release(docs.sparkSession)
    top = cut(weighted_nodes(counts, depth))
    release(docs.sparkSession)

    def total(table: pa.Table) -> pa.Table:
        _, sums = added(integers(table, 2, True), [joined(table, 3, np.uint32)])
        return pa.table({"tokens": [int(sums.sum())], "kinds": [int((sums > 0).sum())]})

    words = counts.select("bucket", "b2", "b3").groupBy("bucket").applyInArrow(total, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = (words[0] or 0) + ends, (words[1] or 0) + (ends > 0)

    def answer(table: pa.Table, nodes: pa.Table) -> pa.Table:
        gram, value = mixed_log10(table, nodes, depth)
        word, sums = added(integers(table, 2, True), [joined(table, 3, np.uint32)])
        values, known = [], []
        for g, w in zip(integers(table, 0, True), integers(table, 2, True), strict=True):
            values.append(value[np.searchsorted(gram, g)].astype(np.float32).tobytes())
            known.append(sums[np.searchsorted(word, w)].tobytes())
        return pa.table({"block": table.column("block"), "b0": table.column("b0"), "b1": pa.array(values, pa.binary()), "b2": table.column("b2"), "b3": pa.array(known, pa.binary())})

    answers = counts.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInArrow(answer, "block int, b0 binary, b1 binary, b2 binary, b3 binary")

    def score(table: pa.Table, given: pa.Table) -> pa.Table:
        gram, word = (np.concatenate([NONE, *integers(given, i, True)]) for i in (0, 2))
        value, count = joined(given, 1, np.float32).astype(np.float64), joined(given, 3, np.int64)
        g_order, w_order = np.argsort(gram), np.argsort(word)
        gram, value, word, count = gram[g_order], value[g_order], word[w_order], count[w_order]
        base = np.log10(count + 1.0)
        out = []
        for batch in table.to_batches():
            for lo, hi in slices(batch.column("text"), CHUNK):
                part = batch.slice(lo, hi - lo)
                text, m = part.column("text"), hi - lo
                score, size = np.zeros(m), np.zeros(m, np.int64)
                for values, row in grams(text, depth):
                    codes, distinct = pd.factorize(values)
                    score += np.bincount(row, value[np.searchsorted(gram, np.asarray(distinct, U))][codes], m)
                    size += np.bincount(row, minlength=m)
                own = Words(text, lower=True)
                at = np.searchsorted(word, own.hashes)
                n_tokens = own.counts + 1
                bits = -score / math.log10(2)
                out.append(pa.record_batch([
                    part.column("doc_id"), part.column("held_out"), pa.array(n_tokens), pa.array(np.bincount(own.rows[count[at] > 0], minlength=m) + int(ends > 0)), pa.array(np.full(m, tokens, np.int64)),
                    pa.array(np.bincount(own.rows, base[at], m) + math.log10(ends + 1) - n_tokens * math.log10(tokens + kinds + 1)), pa.array(score), pa.array(bits), pa.array(bits / size),
                ], [x.split()[0] for x in RESULT.split(", ")]))
        return pa.Table.from_batches(out)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, RESULT)
