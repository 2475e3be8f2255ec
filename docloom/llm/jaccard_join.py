"""Set-similarity self-join of documents on word shingles by a grouped prefix join.

1. A document is the set of its distinct shingles; documents with equal sets are one set (one key), of which
   one row is looked at further.
2. Documents are dealt to blocks.  A block counts its sets by shingle and sends each distinct shingle once to
   its hash range; the range adds up and tells every block the shingles that several sets have.
3. With the rarest shingles first, two sets of Jaccard similarity t or more share a shingle among the
   first ``n - ceil(t n) + 1`` of each.  Sets with the same size and the same prefix form a group.
4. Groups that share a prefix shingle and whose sizes are close enough are candidates.  Each shingle's
   list is first compared with one pivot, then only what is still in different components with each
   other; candidates expand to members, and members' sets are compared in full.
5. Links give components; a component is named by its smallest document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import WORD_BLOCK_CHARS, bucket_of, cut, fresh, integers, n_blocks, packed, release, row_key, runs, split, text_rows
from docloom.llm.graph import components
from docloom.llm.tokens import U, Words, mix, slices

PERCENT = 85
SHINGLE = 4
#: Bits of the fixed-size filter of rows that need a decision.
FILTER_LOG2 = 25
NONE = np.zeros(0, U)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of each distinct shingle by row, and each row's set size and 64-bit set key (0: no set)."""
    words = Words(column, lower=True)
    at, h = words.windows(k)
    row = words.rows[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):  # the whole short sequence is the one shingle
        extra = np.empty(len(few), U)
        for i, r in enumerate(few):
            own = words.hashes[words.first[r] : words.first[r + 1]]
            value = U(len(own))
            for w in own:
                value = mix(np.array([value]) * U(0x9E3779B97F4A7C15) + w)[0]
            extra[i] = value
        row, h = np.r_[row, few], np.r_[h, extra]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    row, h = row[first], h[first]
    n = np.bincount(row, minlength=len(words.counts))
    start, _ = runs(row)
    key = np.zeros(len(n), U)
    if len(start):
        key[row[start]] = mix(np.add.reduceat(mix(h ^ U(0xA24BAED4963EE407)), start) + n[row[start]].astype(U))
    return row, h, n, key


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key, n_shingles of each row, and its row key; key null: no set."""

    def scan(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                _, _, n, key = shingle_sets(batch.column("text").slice(lo, hi - lo), k)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(key.view(np.int64), mask=n == 0), pa.array(n, pa.int64()), batch.column("row").slice(lo, hi - lo)], ["doc_id", "key", "n_shingles", "row"])

    return docs.withColumn("row", row_key()).mapInArrow(scan, "doc_id long, key long, n_shingles long, row long")


def chosen_sets(table: pa.Table, chosen: np.ndarray, k: int):
    """(row, shingle, set size, set key) of a block's chosen rows, piece by piece; of equal rows the first counts."""
    left = set(chosen.tolist())
    for batch in table.to_batches():
        names = batch.column("row").to_pylist()
        first = []
        for name in names:
            first.append(name in left)
            left.discard(name)
        part = batch.filter(pa.array(first, pa.bool_()))
        for lo, hi in slices(part.column("text")):
            yield shingle_sets(part.column("text").slice(lo, hi - lo), k)


def shingle_counts(texts: DataFrame, chosen: DataFrame, k: int, n: int) -> DataFrame:
    """(block, range) with a block's distinct shingles (b0) and how many of its sets have each (b1)."""

    def count(table: pa.Table, own: pa.Table) -> pa.Table:
        hashes = np.sort(np.concatenate([NONE, *(h for _, h, _, _ in chosen_sets(table, own.column("row").to_numpy(), k))]))
        start, sets = runs(hashes)
        rows = [(b, packed(h, ascending=True), packed(c)) for b, (h, c) in split(bucket_of(hashes[start], n), [hashes[start], sets])]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        block = own.column("block")[0].as_py() if len(own) else 0
        return pa.table([pa.array([block] * len(rows), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "bucket", "b0", "b1"])

    return texts.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(count, "block int, bucket int, b0 binary, b1 binary")


def shared_shingles(counts: DataFrame) -> DataFrame:
    """(block, b0, b1): a block's shingles that several sets have, and how many sets."""

    def judge(table: pa.Table) -> pa.Table:
        hashes = integers(table, 0, ascending=True)
        h, own = np.concatenate(hashes), np.concatenate(integers(table, 1)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        start, count = runs(h[order])
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(np.add.reduceat(own[order], start), count)
        rows = []
        for block, shingles, sets in zip(table.column("block").to_pylist(), hashes, np.split(df, np.cumsum([len(x) for x in hashes])[:-1]), strict=True):
            shared = sets > 1
            if shared.any():
                rows.append((block, packed(shingles[shared], ascending=True), packed(sets[shared])))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "b0", "b1"])

    return counts.groupBy("bucket").applyInArrow(judge, "block int, b0 binary, b1 binary")


RECORD = "key long, n long, singles long, prefix array<long>, prefix_hash long, shared binary"


def records(texts: DataFrame, chosen: DataFrame, shared: DataFrame, percent: int, k: int) -> DataFrame:
    """Sets whose prefix has a shared shingle.  singles: shingles that no other set has; shared: the others, in order."""

    def judge(table: pa.Table, given: pa.Table) -> pa.Table:
        own, told = given.filter(given.column("row").is_valid()), given.filter(given.column("row").is_null())
        among, sets = np.concatenate([NONE, *integers(told, 0, ascending=True)]), np.concatenate([NONE, *integers(told, 1)])
        order = np.argsort(among)
        among, sets = among[order], sets[order]
        out = {name: [] for name in ("key", "n", "singles", "prefix", "prefix_hash", "shared")}
        for row, h, size, keys in chosen_sets(table, own.column("row").to_numpy(), k) if len(among) else ():
            at = np.minimum(np.searchsorted(among, h), len(among) - 1)
            known = among[at] == h
            row, h, df = row[known], h[known], sets[at[known]]
            order = np.lexsort((h, df, row))
            row, h = row[order], h[order]
            start, count = runs(row)
            n, key = size[row[start]], keys[row[start]]
            single = n - count
            prefix = n - (percent * n + 99) // 100 + 1
            take = np.minimum(prefix - single, count)
            for i in np.flatnonzero(take > 0):
                whole = h[start[i] : start[i] + count[i]]
                head = whole[: take[i]]
                out["key"].append(int(key[i].view(np.int64)))
                out["n"].append(int(n[i]))
                out["singles"].append(int(single[i]))
                out["prefix"].append(head.view(np.int64))
                # With a shingle of its own in the prefix a set has no equal prefix: its key takes part in the hash.
                part = key[i] if single[i] > 0 else U(0)
                out["prefix_hash"].append(int(mix(np.array([(mix(head * U(3) + np.arange(len(head), dtype=U))).sum(dtype=U) ^ part]))[0].view(np.int64)))
                out["shared"].append(whole.tobytes())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.table([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    none = F.lit(None)
    given = chosen.select("block", "row", none.cast("binary").alias("b0"), none.cast("binary").alias("b1")).union(shared.select("block", none.cast("long").alias("row"), "b0", "b1"))
    return texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(judge, RECORD)


def _close(a: str, b: str, percent: int):
    """Sizes that allow the similarity, and places of the common shingle that leave enough to come.

    Similar sets meet this at their first common shingle, so it is asked at each.
    """
    na, nb, ia, ib = (F.col(f"{side}.{c}") for c in ("n", "place") for side in (a, b))
    rest = F.least(na - ia, nb - ib)
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (F.lit(100 + percent) * rest >= F.lit(percent) * (na + nb))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (u, v), those whose whole sets have the similarity."""
    of = sets.select("key", "n", "shared")
    left = pairs.join(of.toDF("u", "nu", "su"), "u")
    both = left.join(of.toDF("v", "nv", "sv"), "v").select("u", "v", "nu", "nv", "su", "sv")

    def compare(batches):
        for batch in batches:
            keep = []
            for nu, nv, su, sv in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "su", "sv")), strict=True):
                same = len(np.intersect1d(np.frombuffer(su, U), np.frombuffer(sv, U), assume_unique=True))
                keep.append(100 * same >= percent * (nu + nv - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "u long, v long")


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """node, root: components of the sets under the similarity; sets without a link have no row."""
    groups = sets.groupBy("n", "prefix_hash").agg(F.min("key").alias("group"))
    members = cut(sets.join(groups, ["n", "prefix_hash"]).select("key", "group", "n", "singles", "prefix"))
    lists = members.select(F.posexplode("prefix").alias("i", "shingle"), "key", "group", "n", "singles")
    lists = cut(lists.select("shingle", "key", "group", "n", "singles", (F.col("i") + F.col("singles")).alias("place")))
    # Groups first: each list's pivot group with its other groups, then their members; and within a group, its first with the others.
    heads = lists.where("key = group")
    # Pivots are cut off the join, so that a shingle with many groups can be split there.
    pivots = cut(heads.groupBy("shingle").agg(F.min(F.struct("singles", "key", "n", "place")).alias("p")))
    pairs = heads.alias("l").join(pivots, "shingle").where((F.col("key") != F.col("p.key")) & _close("l", "p", percent)).select(F.col("p.key").alias("u"), "group").distinct()
    pairs = pairs.join(members.select("group", F.col("key").alias("v")), "group").select("u", "v")
    inside = members.where("key != group").select(F.col("group").alias("u"), F.col("key").alias("v"))
    links = cut(verify(pairs.union(inside), sets, percent))
    found = cut(components(links))
    # Lists of one component are done.  Of the others, every open pair has a member outside the list's largest component.
    tagged = lists.drop("group").join(found.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = tagged.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("largest")).where("size > largest")
    tagged = cut(tagged.join(cut(main.select("shingle", "main")), "shingle"))
    a, b = tagged.where("root != main").alias("a"), tagged.alias("b")
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & _close("a", "b", percent))
    pairs = pairs.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()
    return components(links.union(verify(pairs, sets, percent)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest document id that links reach.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles
    (A-Z lower-cased; with fewer than k words the whole sequence is the one shingle).  A null, empty or
    wordless text has no set, links with nothing and is its own component.  Equal texts and repeated rows
    link like any others.  Null ids never name a component with other ids in it; a component of null ids
    alone has a null id.  Texts are read whole; an empty table gives an empty result.  Shingles and sets
    are told apart by 64-bit hashes.  Further columns: component (its key; null without a set) and row (a
    hash of id and text).
    """
    rows = text_rows(docs, id_col, text_col)
    n = n_blocks(docs, text_col, WORD_BLOCK_CHARS)
    of_docs = cut(document_sets(rows, k))
    block = F.pmod(F.col("row"), F.lit(n)).cast("int").alias("block")
    chosen = cut(of_docs.where("key is not null").groupBy("key").agg(F.min("row").alias("row")).select("row", block))
    texts = rows.select("text", row_key().alias("row")).select("text", "row", block)
    sets = cut(records(texts, chosen, shared_shingles(shingle_counts(texts, chosen, k, n)), percent, k))
    release(docs.sparkSession)
    roots = set_components(sets, percent)
    by_key = of_docs.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    named = by_key.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("first_id").alias("name"))
    of_key = named.join(names, "root").select("key", "name", F.col("root").alias("component"))
    return of_docs.join(of_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "component", "row")


def deduplicate(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row left of each component: the smallest id's (nulls last; of equal ids the least row hash).

    Rows without a set (null, empty or wordless texts) stay, repeated ones too; of repeated rows with one set one stays.
    All columns stay, whatever their names; an empty table gives an empty result.  A filter of fixed size passes most kept documents; only those
    that it can't tell from dropped ones go through the exact join.
    """
    found = cut(near_duplicates(docs, percent, k, id_col, text_col).where("component is not null").select("component", "doc_id", "row"))
    release(docs.sparkSession)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("w")
    winners = found.groupBy("component").agg(least).select(F.col("w.row").alias("row"), F.lit(True).alias("stays"))
    # All goes by row, so that no task gets a whole component: rows that stay alone need no decision, the others do.
    times = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    shared = cut(times.join(winners, "row", "left").where("stays is null or n > 1").select("row", F.coalesce("stays", F.lit(False)).alias("stays")))
    slots = shared.select(F.shiftrightunsigned("row", 64 - FILTER_LOG2).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(1 << FILTER_LOG2, bool)
    bits[slots] = True
    filled = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    row, doubt, stays = fresh(docs, "_row"), fresh(docs, "_doubt"), fresh(docs, "_stays")

    def doubtful(batches):
        for batch in batches:
            slot = (batch.column(row).to_numpy().view(U) >> U(64 - FILTER_LOG2)).astype(np.int64)
            yield batch.append_column(doubt, pa.array((filled.value[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)))

    keyed = docs.withColumn(row, row_key(id_col, text_col))
    marked = keyed.mapInArrow(doubtful, ", ".join(f"`{c}` {t}" for c, t in keyed.dtypes) + f", {doubt} boolean")
    unsure = marked.where(doubt).join(shared.select(F.col("row").alias(row), F.col("stays").alias(stays)), row, "left")
    alone, first = unsure.where(f"{stays} is null"), unsure.where(stays).dropDuplicates([row])
    return marked.where(f"not {doubt}").drop(row, doubt).union(alone.drop(row, doubt, stays).select(*docs.columns)).union(first.drop(row, doubt, stays).select(*docs.columns))
