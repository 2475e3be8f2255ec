"""Operators against brute force on a small corpus with nulls, empty and long texts, ties and repeated rows."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


# ---- tokens and blocks


def test_words_match_the_regular_expression():
    import pyarrow as pa

    from docloom.llm.tokens import Words

    texts = ["a b", "", None, " x\ty\x0bz ", "é ü\u00a0w", "one", "two words"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [bytes(w.data[a:z]).decode() for a, z in zip(w.starts, w.ends, strict=True)] == flat
    again = Words(pa.array(["two", "one words"])).hashes
    assert w.hashes[flat.index("two")] == again[0] and w.hashes[flat.index("words")] == again[2]
    assert len(set(w.hashes.tolist())) == len(set(flat))


def test_windows_stay_inside_rows_and_equal_sequences_hash_alike():
    import pyarrow as pa

    from docloom.llm.tokens import Words

    w = Words(pa.array(["a b c d", "x b  c\nd", "b c"]))
    at, h = w.windows(3)
    assert at.tolist() == [0, 1, 4, 5]
    assert h[1] == h[3] and h[0] != h[2]


# ---- 1 mixing


def test_knapsack_is_the_best_subset_sum():
    from docloom.llm.mixing import knapsack

    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 30), rng.randrange(1, 5)))
        counts = [rng.randrange(4) for _ in sizes]
        budget = rng.randrange(60)
        sums = {sum(s * n for s, n in zip(sizes, take, strict=True)) for take in itertools.product(*(range(c + 1) for c in counts))}
        take = knapsack(np.array(sizes), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == max(s for s in sums if s <= budget)


def test_fit_budget_comes_near_large_budgets():
    from docloom.llm.mixing import fit_budget

    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 20000, 400))
    counts = rng.integers(1, 50, len(sizes))
    for part in (0.01, 0.3, 0.77, 0.999):
        budget = int((sizes * counts).sum() * part)
        take = fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert 0 <= budget - int((take * sizes).sum()) <= sizes.min()


@pytest.mark.parametrize("part", [0.2, 0.4, 0.6, 0.9])
def test_fit_budget_takes_the_same_share_of_every_length(part):
    from docloom.llm.mixing import fit_budget

    for counts in (np.full(20000, 2), np.random.default_rng(2).integers(1, 4, 20000)):
        sizes = np.arange(1, 20001)
        budget = int((sizes * counts).sum() * part)
        take = fit_budget(sizes, counts, budget)
        assert budget - int((take * sizes).sum()) == 0
        for fifth in np.array_split(np.arange(20000), 5):
            assert abs((take * sizes)[fifth].sum() / (counts * sizes)[fifth].sum() - part) < 0.02


def test_fit_budget_of_long_documents_only():
    from docloom.llm.mixing import fit_budget

    for sizes, counts, budget in (
        ([45000], [2], 50000),
        ([40000, 50000, 60000], [2, 2, 2], 100000),
        ([60000, 70000], [40, 40], 500000),
        ([60000, 70001], [40, 40], 2000008),
        ([60000, 70001], [40, 40], 2030008),
        ([33000, 40001], [1, 3], 120002),
        ([1000000, 1000001], [2, 2], 3500000),
    ):
        take = fit_budget(np.array(sizes), np.array(counts), budget)
        sums = (sum(s * n for s, n in zip(sizes, some, strict=True)) for some in itertools.product(*(range(c + 1) for c in counts)))
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == max(s for s in sums if s <= budget), (sizes, budget)


def test_mix_takes_documents_longer_than_the_programme_starts_with(spark):
    from docloom.llm.mixing import mix_sources

    docs = spark.createDataFrame([(i, "a", "w " * n) for i, n in enumerate((40000, 50000, 60000))], "doc_id long, source string, text string")
    assert sum(r["taken"] for r in mix_sources(docs, share=0.7).collect()) == 100000


def test_mix_sources(spark, corpus):
    from docloom.llm.mixing import mix_sources

    out = mix_sources(corpus["docs"]).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in corpus["rows"])
    total = collections.Counter()
    for r in corpus["rows"]:
        total[r[3]] += len(words(r[1]))
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(total.values()), set()
    while True:
        rest = budget - sum(2 * total[s] for s in capped)
        goal = {s: 2 * total[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        more = {s for s in names if s not in capped and goal[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in out:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["taken"]
    for s in names:  # the best that any choice of up to two copies of each document gives
        reached = {0}
        for r in corpus["rows"]:
            if r[3] == s:
                n = len(words(r[1]))
                reached |= {x + k * n for x in reached for k in (1, 2) if x + k * n <= goal[s]}
        assert taken[s] == max(reached)
    again = mix_sources(corpus["docs"].repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mix_sources(corpus["empty"]).count() == 0


# ---- 2 context trees


def test_context_tree_counts_and_base(spark, corpus):
    from docloom.llm.context_tree import score_documents

    rows = corpus["rows"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = collections.Counter(), 0
    for r in rows:
        if not held(r[0]):
            counts.update(words(r[1], True))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    expected = sorted((str(r[0]), held(r[0]), len(words(r[1])) + 1, sum(counts[w] > 0 for w in words(r[1], True)) + 1, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(r[1], True)) + math.log10((ends + 1) / (n + v + 1)), 6)) for r in rows)
    out = score_documents(corpus["docs"], depth=3).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {n}
    assert all(r["score"] < 0 for r in out)
    assert score_documents(corpus["empty"], depth=3).count() == 0


def plain_context_tree(counts, depth):
    """log10 of a byte after `depth` bytes, straight from the definition; counts: {(context bytes, byte): times}."""
    nodes = collections.defaultdict(lambda: [0, 0])
    for (context, byte), times in counts.items():
        for k in range(7, -1, -1):
            for d in range(depth + 1):
                nodes[context[depth - d :], 1 << (7 - k) | byte >> (k + 1)][byte >> k & 1] += times
    below = collections.defaultdict(list)
    for context, node in nodes:
        if context:
            below[context[1:], node].append(context)

    @functools.cache
    def weighted(context, node):
        """ln Pw, and the weight of the node's own estimate against its children's."""
        a, b = nodes.get((context, node), (0, 0))
        pe = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return pe, 1.0
        split = sum(weighted(c, node)[0] for c in below[context, node])
        return np.logaddexp(pe, split) - math.log(2), 1 / (1 + math.exp(min(700, split - pe)))

    def probability(context, byte):
        total = 0.0
        for k in range(7, -1, -1):
            node, bit, p = 1 << (7 - k) | byte >> (k + 1), byte >> k & 1, 0.5
            for d in range(depth, -1, -1):
                own = nodes.get((context[depth - d :], node), (0, 0))
                stop = weighted(context[depth - d :], node)[1]
                p = stop * (own[bit] + 0.5) / (sum(own) + 1) + (1 - stop) * p
            total += math.log10(p)
        return total

    return probability


def byte_counts(texts, depth):
    counts = collections.Counter()
    for text in texts:
        data = bytes(depth) + (text or "").translate(LOWER).encode() + b"\0"
        counts.update((data[i - depth : i], data[i]) for i in range(depth, len(data)))
    return counts


@pytest.mark.parametrize("depth", [1, 2, 4, 5])
def test_context_tree_is_context_tree_weighting(spark, depth):
    from docloom.llm.context_tree import score_documents

    rng = random.Random(depth)
    texts = ["abracadabra Abracadabra cab", "", None, "zebra \u00e9t\u00e9", *("".join(rng.choice("abcd r\n") for _ in range(rng.randrange(60))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    plain = plain_context_tree(byte_counts([t for i, t in enumerate(texts) if not held(i)], depth), depth)
    got = {r["doc_id"]: r["score"] for r in score_documents(docs, depth=depth).collect()}
    assert any(map(held, got)) and len(got) == len(texts)
    for i, text in enumerate(texts):
        expected = sum(n * plain(*gram) for gram, n in byte_counts([text], depth).items())
        assert abs(got[i] - expected) < 1e-6 * max(1, abs(expected))


def test_context_tree_with_huge_counts_and_no_training_rows(spark):
    """Counts of 1e8 leave every probability above zero; no node is lost."""
    from docloom.llm import context_tree as C
    from docloom.llm.blocks import packed

    depth = 5
    counts = {(b"aaaaa", 97): 10**8, (b"aaaab", 97): 3, (b"abaaa", 98): 10**8, (b"xyaaa", 98): 7, (b"aaaaa", 120): 0, (b"qqqqq", 0): 0}
    code = lambda context, byte: int.from_bytes(bytes([byte]) + context, "little")
    g = np.array(sorted(code(*k) for k in counts), np.uint64)
    n = np.array([{code(*k): v for k, v in counts.items()}[x] for x in g.tolist()], np.uint32)
    bucket = C.range_of(g >> np.uint64(8 * (depth - C.CUT + 1)), 2)
    rows = [(0, b, packed(g[bucket == b], True), n[bucket == b].tobytes(), packed(C.NONE, True), b"") for b in (0, 1)]
    messages = spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, r)) for r in rows], C.MESSAGE)

    def value(table, top):
        gram, out = C.mixed_log10(table, top, depth)
        return __import__("pyarrow").table({"gram": gram.view(np.int64), "value": out})

    got = {r["gram"]: r["value"] for r in messages.groupBy("bucket").cogroup(C.weighted_nodes(messages, depth).groupBy("bucket")).applyInArrow(value, "gram long, value double").collect()}
    plain = plain_context_tree(counts, depth)
    for key in counts:
        expected = plain(*key)
        assert math.isfinite(expected) and abs(got[code(*key)] - expected) < 1e-6 * max(1, abs(expected))
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    out = C.score_documents(docs.where("doc_id is null or doc_id > 1"), folds=1, fold=0).collect()  # all held out
    assert [(r["n_known"], r["train_tokens"], round(r["bits_per_byte"], 5)) for r in out] == [(0, 0, 8.0)]


def test_grams_of_a_long_text_come_in_pieces(monkeypatch):
    import pyarrow as pa

    from docloom.llm import context_tree as C
    from docloom.llm.blocks import packed, unpacked

    texts = pa.array(["AbC" * 50, None, "x"])
    whole = [np.concatenate(x) for x in zip(*C.grams(texts, 5), strict=True)]
    monkeypatch.setattr(C, "CHUNK", 7)
    parts = [np.concatenate(x) for x in zip(*C.grams(texts, 5), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert np.bincount(whole[1]).tolist() == [151, 1, 2]
    assert whole[0][3] == int.from_bytes(b"a" + b"\0\0abc", "little")
    for values in (whole[0], whole[0][:1], whole[0][:0], np.array([0, 2**64 - 1], np.uint64)):
        assert np.array_equal(unpacked(packed(np.unique(values), True), True), np.unique(values))
        assert np.array_equal(unpacked(packed(values)), values)


# ---- 3 rollups


class Replay:
    """A plain ledger: {id: (source, lang, text)} and the documents without an id."""

    def __init__(self):
        self.held, self.nameless = {}, []

    def commit(self, inserts=(), deletes=(), revisions=()):
        for i in deletes:
            self.held.pop(i, None)
        new = {}
        for i, *doc in (*inserts, *revisions):
            if i is not None:
                new[i] = max(new.get(i, doc), doc, key=lambda d: len(d[2] or ""))
        self.held |= new
        self.nameless += [doc for i, *doc in inserts if i is None]

    def totals(self):
        pieces = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff \t-\r]")
        out = collections.defaultdict(lambda: [0, 0, 0])
        for source, lang, text in (*self.held.values(), *self.nameless):
            for version, pattern in (("words-1", WORD), ("pieces-1", pieces)):
                row = out[source, lang, version]
                row[0] += 1
                row[1] += len(pattern.findall(text or ""))
                row[2] += len(text or "")
        return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_ledger_follows_a_plain_replay(spark, tmp_path, monkeypatch):
    """Null ids, ids held already, repeated rows, changes of what isn't held, commits repeated and compacted."""
    from docloom.llm.token_rollup import Ledger, counted

    rng = random.Random(5)
    kind = "doc_id long, source string, lang string, text string, tokenizer string"  # with a clashing column
    doc = lambda i: (i, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([None, "", "x", "two words", "\u00e9 a, b!" * rng.randrange(9)]))
    ids = lambda n: [rng.choice([None, *range(12)]) for _ in range(n)]
    frame = lambda rows: counted(spark.createDataFrame([(*r, "x") for r in rows], kind))
    monkeypatch.setattr(Ledger, "COMPACT", 2)
    ledger, plain = Ledger(spark, str(tmp_path / "ledger")), Replay()
    assert ledger.totals().count() == ledger.documents().count() == 0
    assert ledger.commit("00", deletes=spark.createDataFrame([(1,), (None,)], "doc_id long"))
    batches = [{"inserts": [doc(i) for i in ids(8)]}, {"revisions": [doc(i) for i in ids(5)]}, {"inserts": [doc(i) for i in ids(6)], "deletes": ids(3)}, {"deletes": ids(4), "revisions": [doc(i) for i in ids(2)]}, {"inserts": []}]
    for k, batch in enumerate(batches):
        batch = {name: rows + rows[:1] for name, rows in batch.items()}
        plain.commit(**batch)
        make = {name: spark.createDataFrame([(i,) for i in rows], "doc_id long") if name == "deletes" else frame(rows) for name, rows in batch.items()}
        assert ledger.commit(f"{k + 1:02}", **make)
        assert not ledger.commit(f"{k + 1:02}", **make)
        assert sorted(map(tuple, ledger.totals().collect()), key=str) == plain.totals()
        assert ledger.documents().agg(F.sum("n_docs")).first()[0] == 2 * (len(plain.held) + len(plain.nameless))
    assert len(ledger._marked("compactions")) >= 1


def test_a_commit_that_breaks_off_counts_only_when_it_is_repeated(spark, tmp_path, monkeypatch):
    from docloom.llm.token_rollup import Ledger, counted

    docs = counted(spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", "en", "three")], "doc_id long, source string, lang string, text string"))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.commit("0", inserts=docs.where("doc_id = 1"))
    before = sorted(map(tuple, ledger.totals().collect()))

    def lost(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_mark", lost)
        with pytest.raises(OSError):
            ledger.commit("1", inserts=docs.where("doc_id = 2"))
    again = Ledger(spark, str(tmp_path / "ledger"))
    assert sorted(map(tuple, again.totals().collect())) == before and again.documents().count() == 2
    assert again.commit("1", inserts=docs.where("doc_id = 2"))
    assert sorted((r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in again.totals().collect()) == [("pieces-1", 2, 3), ("words-1", 2, 3)]


# ---- 4 near duplicates


def shingles(text, k=4):
    w = words(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        out |= {i: min(ids, default=None) for i in own}
    return sets, out, groups.values()


def test_near_duplicates(spark, corpus):
    from docloom.llm.jaccard_join import deduplicate, near_duplicates

    rows = corpus["rows"]
    sets, component, groups = brute_components(rows)
    out = near_duplicates(corpus["docs"]).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((r[0], len(sets[i]), component[i])) for i, r in enumerate(rows))
    assert near_duplicates(corpus["empty"]).count() == 0
    kept = deduplicate(corpus["docs"])
    assert kept.columns == corpus["docs"].columns
    expected = []
    for own in groups:
        own = own if not sets[own[0]] else [min(own, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))]
        expected += [rows[i][:2] for i in own]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, expected))


def test_near_duplicates_in_a_large_group(spark):
    """Copies that differ from one text in a word each, chains of small changes, and groups with equal prefixes."""
    from docloom.llm.jaccard_join import near_duplicates

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(own)))
    for i in range(60, 90):  # a chain
        base = base[1:] + [f"c{i}"]
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    _, component, _ = brute_components(rows)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {rows[i][0]: c for i, c in component.items()}


# ---- 5 substrings


def test_substring_dedup(spark, corpus):
    from docloom.llm.substring_dedup import dedup_substrings

    rows, k = corpus["rows"], 50
    owner = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - k + 1):
            key, own = tuple(w[i : i + k]), math.inf if r[0] is None else r[0]
            owner[key] = min(owner.get(key, math.inf), own)
    expected = []
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if owner[tuple(w[i : i + k])] < (math.inf if r[0] is None else r[0]):
                keep[i : i + k] = [False] * k
        expected.append((r[0], len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    out = dedup_substrings(corpus["docs"]).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out))) == sorted(map(str, expected))
    assert any(r["n_removed"] for r in out)
    assert all(sum(z - a for a, z in r["removed"]) == r["n_removed"] for r in out)
    assert dedup_substrings(corpus["empty"]).count() == 0


# ---- 7 urls


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/71?x", "example.com/en/7", "allow"), ("https://example.com/en/81", "com/en/", "block"), ("http://com/en/", "com/en/", "block"), ("http://xcom/en/", None, "allow"),
        ("http://m.example.net/de/8", "example.net/de/8", "allow"), ("http://m.example.net/de/9#f", "net/de/", "block"), ("x://y.org/es/?q", "org/es/", "block"), ("http://y.org/ES/", None, "allow"),
        ("http://x.net/a.com/en/", None, "allow"), ("http://example.com", None, "allow"), ("http://example.com?/en/7", None, "allow"), ("no scheme.com/en/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("a://b.com/en/://c.net/de/", "com/en/", "block"),
    ],
)
def test_url_filter(spark, url, rule, verdict):
    from docloom.llm.url_globs import filter_urls

    r = filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_url_tables(spark):
    """Null ids, repeated rows, very long urls, other columns with the names of the result, empty tables, no rules."""
    from docloom.llm.url_globs import RULES, filter_urls

    urls = [None, "", "http://a.com/en/x", "http://a.com/en/x", "http://b.com/" + "x" * 50_000, "http://Ü.net/de/é", "http://com/en/\n?q", "ftp://a.b.example.com:80/en/7"]
    rows = [(i if i % 3 else None, u, "own", "own", "own", "own") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")

    def plain(url):
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2]).groups() if url and "://" in url else ("", "")
        host = host.translate(LOWER)
        best, verdict = None, "allow"
        for v, rule in RULES:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
                best, verdict = rule, v
        return host, path, best, verdict

    got = filter_urls(pages).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *plain(r[1]))) for r in rows)
    assert filter_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, rules=(), default="block").collect()} == {"block"}


def test_url_rules_are_the_contract(spark):
    """The rules as the contract of op7 lists them, and the verdicts of pages under net/de/."""
    from docloom.llm.url_globs import RULES, filter_urls

    assert RULES == (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
    pages = spark.createDataFrame([(1, "http://x.net/de/8"), (2, "http://m.example.net/de/8a"), (3, "http://example.net/de/9"), (4, "http://net/fr/")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(pages, default="block").collect()} == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: (None, "block")}


def test_automaton_against_regular_expressions():
    import pyarrow as pa

    from docloom.llm.tokens import string_bytes
    from docloom.llm.url_globs import compile_globs, run

    rng = random.Random(2)
    globs = ["".join(rng.choice("ab/.*") for _ in range(rng.randrange(1, 12))) for _ in range(40)]  # several 64-bit words
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    translate = lambda g: re.sub(r"\\\*\\\*", ".*", re.escape(g)).replace(r"\*", "[^/]*")
    got = run(compile_globs(list(enumerate(globs))), *string_bytes(pa.array(texts)), len(globs))
    for j, g in enumerate(globs):
        pattern = re.compile(translate(g), re.S)
        assert [bool(x) for x in got[:, j]] == [bool(pattern.fullmatch(t)) for t in texts], g


# ---- 8 tiling


def test_tiles_cover_reordered_passages(spark):
    from docloom.llm.tiling import contaminated, decontaminate

    rng = random.Random(4)
    item = [f"t{i}" for i in range(30)]
    noise = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    docs = [(1, " ".join(noise(40) + item + noise(5))), (2, " ".join(item[15:] + noise(3) + item[:15])), (3, " ".join(noise(60))), (4, " ".join(item[:12] + noise(9))), (5, None), (None, ", ".join(x.upper() for x in item)), (6, ""), (7, " ".join(noise(9) + ["short", "one"]))]
    bench = [(10, " ".join(item)), (11, "short one"), (12, None), (13, ""), (None, "z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for most in (1 << 20, 0):
        out = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in contaminated(d, b, broadcast_bytes=most).collect()}
        assert out == {(1, 10): 30, (2, 10): 30, (None, 10): 30, (7, 11): 2}
        assert sorted(r["doc_id"] for r in decontaminate(d, b, broadcast_bytes=most).collect()) == [3, 4, 5, 6]
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_greedy_tiling_takes_the_longest_first():
    from docloom.llm.tiling import tile

    h = lambda s: np.array([hash(x) & (2**63 - 1) for x in s.split()], np.uint64)
    assert sorted(tile(h("a b c d e x a b c"), h("a b c q a b c d e"), 3)) == [(0, 4, 5), (6, 0, 3)]
    assert tile(h("a b"), h("a b c"), 3) == [] and tile(h(""), h("a b c"), 3) == []


def plain_tiling(doc, item, least):
    """Marks the longest common run of unmarked words again and again; the first of equals."""
    free, open_, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free[i + n] and open_[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return tiles
        tiles.append(best)
        free[i : i + n] = [False] * n
        open_[j : j + n] = [False] * n


def test_tiling_is_greedy_string_tiling(monkeypatch):
    from docloom.llm import tiling

    rng = random.Random(8)
    code = {c: np.uint64(rng.randrange(2**63)) for c in "abcd"}
    for most in (1 << 20, 3):
        monkeypatch.setattr(tiling, "PAIRS", most)
        for _ in range(300):
            doc, item = ("".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(30))) for _ in range(2))
            least = rng.randrange(1, 5)
            got = tiling.tile(np.array([code[c] for c in doc], np.uint64), np.array([code[c] for c in item], np.uint64), least)
            assert got == plain_tiling(doc, item, least), (doc, item, least)
    same = np.full(200_000, 7, np.uint64)  # one word, many times: no quadratic memory
    assert sum(n for _, _, n in tiling.tile(same, same[:60], 5)) == 60


def test_both_join_paths_find_what_plain_tiling_finds(spark):
    from docloom.llm.tiling import contaminated

    rng = random.Random(3)
    common = "this is what we ask of you today".split()
    items = [(i, " ".join(common + [f"{rng.choice('pqrs')}{rng.randrange(6)}" for _ in range(rng.randrange(2, 14))])) for i in range(12)] + [(20, "two words"), (21, "")]
    docs = []
    for d in range(60):
        words_ = common * (d % 3)
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(own) - 4))
            words_ += own[a : a + rng.randrange(2, 20)] + [f"z{rng.randrange(9)}"]
        docs.append((d, " ".join(words_) or None))
    docs += [docs[1], (None, docs[2][1])]
    expected = []
    for d, text in docs:
        for i, item in items:
            own = item.split()
            if own:
                covered = sum(n for _, _, n in plain_tiling((text or "").split(), own, min(5, len(own))))
                if covered >= 0.6 * len(own):
                    expected.append((d, i, covered))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("row", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    assert len(expected) > 20
    for most in (1 << 20, 0):
        got = [(r["doc_id"], r["item_id"], r["covered_words"]) for r in contaminated(frame, bench, broadcast_bytes=most).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected))


# ---- 9 toxicity


def test_chain_is_exact():
    from docloom.llm.toxic_crf import chain

    rng = np.random.default_rng(0)
    first, u, trans = np.array([0, 3, 3, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    r, s = chain(u, first, trans)
    p = r * s / (1 + r * s)
    for a, z in ((0, 3), (3, 8)):
        total, hot = 0.0, np.zeros(z - a)
        for y in itertools.product((0, 1), repeat=z - a):
            w = math.exp(sum(u[a + i] for i in range(z - a) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(z - a - 1)))
            total += w
            hot += w * np.array(y)
        assert np.allclose(p[a:z], hot / total)


def test_toxicity_on_held_out_rows(spark, corpus):
    from docloom.llm.toxic_crf import toxicity

    labels = {i: int(i % 7 == 3) for i in range(120)}
    table = spark.createDataFrame([(i, v) for i, v in labels.items()] + [(None, 1)], "doc_id long, toxic int")
    out = toxicity(corpus["docs"], table).collect()
    assert len(out) == len(corpus["rows"])
    texts = {r[0]: r[1] for r in corpus["rows"]}
    for r in out:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in texts and r["spans"]:
            assert {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]} <= {"idiot", "scum", "moron", "you"} | {f"{a} you {b}" for a in ("idiot", "scum", "moron") for b in ("idiot", "scum", "moron")}
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    insulting = lambda t: any(w in (t or "").split() for w in ("idiot", "scum", "moron"))
    right = [r["predicted"] == int(insulting(texts[r["doc_id"]])) for r in held]
    assert held and sum(right) >= 0.9 * len(held)
    assert toxicity(corpus["empty"], table).count() == 0
    assert toxicity(corpus["docs"], table.limit(0)).count() == len(corpus["rows"])


def test_unlisted_words_are_tagged_by_their_letters_and_neighbours(spark):
    """idiots and an unknown word between the words that stand around insults; scores and offsets against the definition."""
    import pyarrow as pa

    from docloom.llm import toxic_crf as T

    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choice("stone river light garden letter valley bridge copper".split()) for _ in range(n))
    rows = [(i, f"{plain(6)} you utter {rng.choice(('idiot', 'moron', 'scum'))} really {plain(5)}" if i % 4 == 0 else f"{plain(5)} the {rng.choice('abcdef')}{i} of {plain(6)}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, label int")
    field = T.fit_field(docs, labels)
    texts = ["stone you utter blarg really river", "stone the blarg of river", "stone the idiots of river", "É: you utter IDIOT really", None, ""]
    tokens = T.Tokens(pa.array(texts))
    p = field.marginals(tokens)
    of = lambda r, word: p[tokens.first[r] + texts[r].lower().replace(":", "").split().index(word)]
    assert of(0, "blarg") > 0.2 and of(0, "blarg") > 10 * of(1, "blarg") and of(2, "idiots") > 1.2 * of(1, "blarg")
    out = {r["doc_id"]: r for r in T.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)), field).collect()}
    for r, text in enumerate(texts):
        own = p[tokens.first[r] : tokens.first[r + 1]]
        most = min(max(own.max(initial=0), 1e-4), 1 - 1e-4)
        z = field.curve @ [1, math.log(most / (1 - most)), math.log1p(own.sum())]
        assert abs(out[r]["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and out[r]["predicted"] == int(out[r]["score"] >= 0.5)
        hot, spans = [x >= 0.5 for x in own], []
        places = [m.span() for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]
        for k, x in enumerate(hot):
            if x and k and hot[k - 1]:
                spans[-1] = (spans[-1][0], places[k][1])
            elif x:
                spans.append(places[k])
        assert [(s["start"], s["end"]) for s in out[r]["spans"]] == spans
    assert any("IDIOT" in texts[3][s["start"] : s["end"]] for s in out[3]["spans"])


def test_the_sample_has_toxic_rows_though_they_are_rare(spark):
    from docloom.llm import toxic_crf as T

    rows = [(i, "a vile brute" if i % 100 == 0 else "a calm lake") for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i, _ in rows], "doc_id long, label int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = T.fit_field(docs, labels, sample=60)
    got = {r["text"]: r["predicted"] for r in T.score_toxicity(docs.limit(101), field).join(docs, "doc_id").collect()}
    assert got == {"a vile brute": 1, "a calm lake": 0}


# ---- 10 personal data

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def brute_patterns(text):
    return [(kind, *m.span()) for kind, pattern, ok in KINDS for m in re.finditer(pattern, text) if ok(m[0])]


def test_patterns_match_the_expressions():
    from docloom.llm.sanitise import patterns

    rng = random.Random(9)
    for _ in range(20000):
        text = "".join(rng.choice("ab19+-.@ ()4.5") for _ in range(rng.randrange(50)))
        assert patterns(text) == brute_patterns(text), text
    assert patterns("a" * 200000 + "1" * 200000 + ".") == []  # linear


def test_disclosing_terms(spark, corpus):
    from docloom.llm.sanitise import find_personal_data, sanitise, span_digest

    rows = [(1, "call zorblax at a@b.example.com today"), (2, "zorblax wrote to a@b.example.com again"), (3, "today again call wrote to at the"), (4, "call at today again to wrote"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("extra"))
    found = {(r["doc_id"]): r for r in find_personal_data(docs).collect()}
    assert [(s["start"], s["end"]) for s in found[1]["terms"]] == [(5, 12)] and found[3]["terms"] == [] and found[5]["base"] == []
    out = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert out[1] == "call  at [EMAIL] today" and out[3] == rows[2][1] and out[5] is None
    assert sanitise(docs).columns == docs.columns and sanitise(docs).count() == 6
    digest = {r["doc_id"]: r["spans"] for r in span_digest(find_personal_data(docs)).collect()}
    assert digest[1] == "email:16:31,term:5:12"
    big = span_digest(find_personal_data(corpus["docs"])).collect()
    expected = sorted(hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in brute_patterns(r[1] or "")).encode()).hexdigest() for r in corpus["rows"])
    assert sorted(r["base_sha256"] for r in big) == expected
    assert find_personal_data(corpus["empty"]).count() == 0


def plain_terms(rows):
    """{id: pattern spans}, and {id: (start, end, disclosed)} of disclosing terms, from all pairs of entities and terms."""
    term = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
    n, holders, of, places, df, spans = len(rows), collections.defaultdict(set), {}, {}, collections.Counter(), {}
    for i, text in rows:
        text = text or ""
        df.update({w.translate(LOWER) for w in term.findall(text)})
        base = spans[i] = brute_patterns(text)
        of[i] = {(k, re.sub("[^0-9]", "", text[a:z]) if k in ("phone", "card") else text[a:z].translate(LOWER)) for k, a, z in base}
        for e in of[i]:
            holders[e].add(i)
        places[i] = [(*m.span(), m[0].translate(LOWER)) for m in term.finditer(text) if not any(m.start() < z and a < m.end() for _, a, z in base)]
    both = collections.Counter((e, w) for i in of for e in of[i] for w in {w for _, _, w in places[i]})
    disclosed = {(e, w): math.log2(n * c / (len(holders[e]) * df[w])) / math.log2(n / len(holders[e])) for (e, w), c in both.items() if c >= 2 and len(holders[e]) < n}
    expected = {}
    for i in of:
        best = [(a, z, max((disclosed.get((e, w), 0) for e in of[i]), default=0)) for a, z, w in places[i]]
        expected[i] = [(a, z, round(d, 6)) for a, z, d in best if d >= 0.8]
    return spans, expected


def test_disclosing_terms_of_whole_documents(spark, corpus):
    """Against all pairs of entities and terms of the documents that hold them, however far apart."""
    from docloom.llm.sanitise import find_personal_data, sanitise

    far = " ".join(f"filler{i}" for i in range(60))
    rng = random.Random(4)
    texts = [f"Zorblax report. {far} by a@b.example.com {far} zorblax", f"{far} ZORBLAX {far} é+49 170 555 1234 a@b.example.com", f"note on {far}", "x10.0.0.1y zorblaxes", None, ""]
    texts += [" ".join(rng.choice(("red", "blue", "kite", "lamp", "moor", "c@d.example.org", "c@d.example.org,", "10.1.2.3", "+49 170 555 1234", far, f"n{i % 9}")) for _ in range(rng.randrange(1, 9))) for i in range(60)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    _, expected = plain_terms(rows)
    assert [texts[0][a:z] for a, z, _ in expected[0]] == ["Zorblax", "zorblax"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = find_personal_data(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s["start"], s["end"], round(s["disclosed"], 6)) for s in r["terms"]] == expected[r["doc_id"]], r["doc_id"]
    assert not any("zorblax" in r["text"].lower() for r in sanitise(docs).where("doc_id in (0, 1)").collect())
