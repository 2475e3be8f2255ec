"""The pipeline's stages on a small corpus, each against what its operator says of its own input."""

import collections
import random
import re

import corpus_pipeline
import pytest
from test_operators import LOWER, plain_terms, plain_tiling, words

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = corpus["docs"].drop("_row")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(i % 7 == 3)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(corpus["rows"][8][1].split()[:30])), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert {r["copies"] for r in docs.collect()} <= {1, 2}
    texts = [r["text"] or "" for r in docs.collect()]
    assert not any(w in t.split() for t in texts for w in ("idiot", "scum", "moron"))
    assert not any("@mail" in t for t in texts)


def test_near_duplicates_are_pairs_of_four_fifths_on_five_words(spark, folder):
    def pair(n):
        a = [f"w{n}x{i}" for i in range(n)]
        b = [*a[: n // 2], "changed", *a[n // 2 + 1 :]]
        cut = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        return " ".join(a), " ".join(b), [len(cut(a, k) & cut(b, k)) / len(cut(a, k) | cut(b, k)) for k in (4, 5)]

    a, b, (four, five) = pair(50)
    c, d, (_, far) = pair(40)
    assert 0.8 <= five < 0.85 and four < 0.85 and far < 0.8
    docs = spark.createDataFrame(list(enumerate((a, b, c, d))), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()) == [0, 2, 3]


def frame(spark, texts):
    rows = [(i, t, "en" if i else None, f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def small_texts(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice("stone river light garden letter valley bridge copper market".split()) + str(rng.randrange(60)) for _ in range(n))
    texts = []
    for i in range(70):
        text = prose(rng.choice((0, 2, 5, 30, 45)))
        if i % 4 == 1 and texts[-1]:
            text = " ".join([*texts[-1].split()[:-1], "Changed"]) if i % 8 == 1 else texts[-1]
        texts.append(text)
    return [*enumerate(texts), (70, None), (71, ""), (None, texts[3]), (None, None)]


def test_near_duplicates_against_all_pairs(spark, folder):
    texts = small_texts(1)
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))(words(t, True))
    sets = [cut(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(texts[i][0])
    expected = sorted(str(min(ids, key=lambda x: (x is None, x or 0))) for ids in groups.values())
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), folder)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == expected and 10 < len(expected) < len(texts) - 5


def test_contamination_against_plain_tiling(spark, tmp_path):
    rng = random.Random(2)
    item = [f"{rng.choice('abc')}{rng.randrange(12)}" for _ in range(30)]
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = small_texts(3)
    for i in range(80, 110):
        a, z = sorted((rng.randrange(31), rng.randrange(31)))
        texts.append((i, " ".join(["start", *item[z - (z - a) // 2 : z], "mid", *item[a : z - (z - a) // 2], "end"])))
    plain = lambda t: sum(n for _, _, n in plain_tiling(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER)), item, 5))
    expected = sorted(str((i, t)) for i, t in texts if plain(t) < 0.6 * 30)
    got = corpus_pipeline.drop_contaminated(spark, frame(spark, texts), str(tmp_path))
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == expected and len(expected) < len(texts)


def test_sanitised_texts_against_all_pairs(spark, folder):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(("red", "kite", "lamp", "anna@x.example.org", "10.1.2.3", "+49 170 555 1234", f"n{i % 9}", "Qorvath bob@y.example.org")) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(60, None), (61, "")]
    base, terms = plain_terms(texts)
    expected = {}
    for i, text in texts:
        own = text
        spans = [(a, z, f"[{k.upper()}]") for k, a, z in base[i]] + [(a, z, "" if d >= 0.95 else "[NUMBER]" if text[a:z].isdigit() else "[WORD]") for a, z, d in terms[i]]
        for a, z, label in sorted(spans, reverse=True):
            own = own[:a] + label + own[z:]
        expected[i] = (own, None if own is None else len(own))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.sanitise_personal_data(spark, frame(spark, texts), folder).collect()}
    assert got == expected and any(t for t in terms.values())


def test_mixed_words_are_the_best_sums(spark, folder):
    texts = small_texts(9)
    docs = frame(spark, texts)
    got = corpus_pipeline.mix(spark, docs, folder).collect()
    by_source, taken, goal = collections.defaultdict(list), collections.Counter(), {}
    for r in docs.collect():
        by_source[r["source"]].append(len(words(r["text"])))
    for r in got:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * len(words(r["text"])) and r["copies"] in (1, 2)
    for source, sizes in by_source.items():
        reached = {0}
        for n in sizes:
            reached |= {x + k * n for x in reached for k in (1, 2) if x + k * n <= goal[source]}
        assert taken[source] == max(reached)


def test_toxic_documents_go_and_others_stay_whole(spark, corpus, folder):
    docs = corpus["docs"]  # with nulls, repeated rows and a column named as the operator's own
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    insulting = lambda t: any(w in (t or "").split() for w in ("idiot", "scum", "moron"))
    expected = [r for r in corpus["rows"] if not insulting(r[1])]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))


def test_run_is_registered_and_repeats(spark, folder):
    query = __spark_entry__.queries()["pipeline"]
    a, b = (sorted(map(str, query(spark, folder).collect())) for _ in range(2))
    assert a == b and a


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    assert docs.count() == 0


def test_each_operator_has_a_query():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
