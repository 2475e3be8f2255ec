"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length and source.  For each source the budget is first filled in
proportion of the counts, and what is left of it is fitted
by a bounded-knapsack dynamic programme over the lengths.  The plan says how many copies of each length's
documents to take; which documents have one more than the others, a seeded hash of the id says.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The dynamic programme starts with half of so many units of the budget (twice the largest length if that is
#: more), after a fill in proportion.  While the fit misses the budget, this grows, up to MOST units.
CAPACITY, MOST = 1 << 15, 1 << 24
#: Parts of a length group that are ranked apart, so that no group is ranked in one task.
PARTS = 256


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY, seed: int = 0) -> np.ndarray:
    """How many documents of each size to take (at most counts) so that their sizes add up close to budget.

    sizes: distinct, positive.  Never exceeds the budget.  Sizes count in units of their common divisor.  A fit
    without a miss, or of a budget up to `MOST` units, is the best there is; any other is the best of the fits
    with ever more of the budget left to the programme.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    if budget >= int((sizes * counts).sum()):
        return counts.copy()
    unit = int(np.gcd.reduce(sizes))
    sizes, budget = sizes // unit, budget // unit
    capacity = max(capacity, 2 * int(sizes.max()))
    best, missed = _fit(sizes, counts, budget, capacity, seed)
    while missed and capacity < min(budget, MOST):
        capacity = min(4 * capacity, MOST)
        take, miss = _fit(sizes, counts, budget, capacity, seed)
        if miss < missed:
            best, missed = take, miss
    return best


def in_proportion(sizes: np.ndarray, counts: np.ndarray, words: float, seed: int) -> np.ndarray:
    """The same share of every size's copies, in whole copies that add up to `words` but for the largest size.

    What rounding leaves over or adds is carried to the next size, so rare sizes get their share between them.
    """
    order = np.argsort(sizes)
    share = words / float((sizes * counts).sum())
    take, carry = np.zeros(len(sizes), np.int64), float(np.random.default_rng(seed).random() - 0.5) * float(sizes.min())
    for k in order.tolist():
        want = counts[k] * share + carry / sizes[k]
        take[k] = min(max(int(np.floor(want + 0.5)), 0), counts[k])
        carry = (want - take[k]) * sizes[k]
    return take


def _fit(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int, seed: int) -> tuple[np.ndarray, int]:
    """The copies of each size, and what of the budget they miss; capacity: twice the largest size at least."""
    take = in_proportion(sizes, counts, budget - capacity / 2, seed) if budget > capacity else np.zeros(len(sizes), np.int64)
    left = budget - int((sizes * take).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))  # no length comes first for its size
    take[order] += knapsack(sizes[order], (counts - take)[order], left)
    return take, budget - int((sizes * take).sum())


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the counts whose total is the largest that is at most budget."""
    take = np.zeros(len(sizes), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int32)  # the piece that first reached a sum
    pieces: list[tuple[int, int, int]] = []
    for k, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        count, step = min(count, budget // size), 1
        while count > 0 and not reached[budget]:
            n = min(step, count)
            weight = n * size
            new = reached[: budget + 1 - weight] & ~reached[weight:]
            by[weight:][new] = len(pieces)
            reached[weight:] |= new
            pieces.append((k, n, weight))
            count, step = count - n, step * 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n, weight = pieces[by[at]]
        take[k] += n
        at -= weight
    return take


def targets(by_source: DataFrame, share: float = 1.5, weights=WEIGHTS, most: float = 2.0) -> DataFrame:
    """target of each source: share of all sizes by weight, at most `most` times the source's size.

    by_source: source, source_size.  One row a source; the sources are ranked in one window.
    What a capped source can't take goes to the others by weight until none is above its cap: with the
    sources in order of cap a weight, those below the final level are capped.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    w = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("budget", budget)
    w = w.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # Capped: with it and all below it at their caps, an even level for the others is still above it.
    w = w.withColumn("capped", F.col("cap") * F.col("open") <= F.col("rest") * F.col("weight"))
    w = w.withColumn("n", F.sum(F.when(~F.col("capped"), 1).otherwise(0)).over(up_to))
    free = F.col("n") > 0
    level = F.max(F.when(free & (F.col("n") == 1) & ~F.col("capped"), F.col("rest") / F.col("open"))).over(everything)
    return w.select("source", "source_size", F.when(free, F.coalesce(level, F.lit(0.0)) * F.col("weight")).otherwise(F.col("cap")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, share: float = 1.5, weights=WEIGHTS, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep=()) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken, and the columns in keep.

    A document is taken 0, 1 or 2 times (`most` rounded up); `taken` is copies * size.  Each source's taken
    words are at most its target and as near to it as `fit_budget` comes.  A null source is a source of its
    own, a null or wordless text has size 0 and is never taken, a null id is an ordinary id.  Repeated rows
    are documents of their own; among equal ids and lengths any of the equal rows may be the one taken, so
    reruns agree as sets of rows.  An empty table gives an empty result.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(source_col).cast("string").alias("source"), word_count(c(text_col).cast("string")).alias("size"), *(c(k).alias(f"_keep_{k}") for k in keep))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)))).withColumn("_part", F.pmod("_h", F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("source", "size", "_part").agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goals = targets(by_source, share, weights, most)

    limit = int(np.ceil(most))  # a document is taken so often at most

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        take = np.zeros(len(pdf), np.int64)
        real = (pdf["size"] > 0).to_numpy()
        n = pdf["n"].to_numpy()
        if real.any():
            take[real] = fit_budget(pdf["size"].to_numpy()[real], limit * n[real], int(pdf["target"].iloc[0]), seed=seed)
        return pdf.assign(whole=take // n, extra=take % n)[["source", "size", "whole", "extra", "source_size", "target"]]

    # One group holds a source's distinct lengths and their counts, not its documents.
    planned = lengths.alias("l").join(goals.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.source", "size", "n", "source_size", "target")
    planned = planned.groupBy("source").applyInPandas(plan, "source string, size long, whole long, extra long, source_size long, target double")
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = parts.select("source", "size", "_part", ahead.alias("ahead")).alias("p")
    q = planned.alias("q")
    quota = p.join(q, F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.size") == F.col("q.size"))).select(F.col("p.source").alias("s"), F.col("p.size").alias("z"), F.col("p._part").alias("part"), "ahead", "whole", "extra", "source_size", "target")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_h", "doc_id")))
    both = ranked.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("_part") == F.col("part")))
    copies = F.col("whole") + F.when(F.col("ahead") + F.col("_rank") <= F.col("extra"), 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(F.col(f"_keep_{k}").alias(k) for k in keep))
