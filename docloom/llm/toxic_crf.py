"""Toxicity scores from a linear-chain conditional random field over words.

Labels mark documents, so words get labels from the corpus first: a word of a toxic document is toxic if
Spark's counts over all labelled training documents find it far likelier in toxic ones.  The field (two
states; features: the word, its form and first letters, the words beside it, the state before) is fitted to
those word labels on a bounded sample; as form, letters and neighbours count too, it also tags words that no
list has.  Forward-backward marginals of every word of every document give the document's score, through a
logistic curve fitted on the same sample, and the offending spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import FLUSH, bounded, cut, text_rows
from docloom.llm.tokens import NOT_ALNUM, U, Words, mix, slices, string_bytes

#: Words are told apart by this many bits of their hash; the list of toxic words has at most so many.
SLOTS_LOG2 = 26
#: Labelled training documents that the field is fitted on, at most: those with the smallest hashed ids, a fifth of them toxic or as many as among all labels.
SAMPLE = 1500
#: Longer texts are not in that sample, so it is bounded in bytes too; they count for the word statistics like all others.
SAMPLE_BYTES = 1 << 16
#: A word is toxic from this many labelled toxic documents, this share of them, and this log-odds on.
SUPPORT, SHARE, ODDS = 5, 0.005, 3.5
STEPS = 25
#: Share of listed words that the fit sees as if they were not listed.
UNLISTED = 0.25
#: Bytes of text whose chains are run together.
CHUNK = 4 << 20
#: Weights of each hashed feature (first letters, the word before, the word after), and the forms of words.
BINS_LOG2 = 12
FORMS = 8
LETTERS = 4


class Tokens:
    """The words of some texts: slots (their hashes' upper bits) and the features that aren't the word itself."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column, lower=True, breaks=NOT_ALNUM)
        self.first = words.first
        self.slot = (words.hashes >> U(64 - SLOTS_LOG2)).astype(np.int64)
        raw, _ = string_bytes(column)
        s, e = words.starts, words.ends
        upto = lambda of: np.r_[0, np.cumsum(of, dtype=np.int32)]
        upper, digit = upto((raw >= 65) & (raw <= 90)), upto((raw >= 48) & (raw <= 57))
        n_upper, n_digit = upper[e] - upper[s], digit[e] - digit[s]
        # Whether it has capitals, is all capitals (of two or more) and has digits.
        form = (n_upper > 0) + 2 * ((n_upper == e - s) & (e - s > 1)) + 4 * (n_digit > 0)
        head = np.zeros(len(s), U)
        for i in range(LETTERS):
            inside = s + i < e
            head[inside] |= words.data[s[inside] + i].astype(U) << U(8 * i)
        before, after = neighbours(words.hashes, self.first)
        bins = lambda h, salt: (mix(h + U(salt)) >> U(64 - BINS_LOG2)).astype(np.int64)
        #: One feature a row: its number by word.
        self.features = np.stack([form.astype(np.int64), *(FORMS + k * (1 << BINS_LOG2) + bins(h, k) for k, h in enumerate((head, before, after)))])


N_FEATURES = FORMS + 3 * (1 << BINS_LOG2)


def chain(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 at each word: r (with the word's own u) and s (without).

    u: log-odds of state 1 by word; row k has the words first[k] to first[k + 1]; trans: 2 x 2 scores.
    All rows take a step at once, the longest rows go on alone.
    """
    m, e = np.exp(trans), np.exp(np.clip(u, -30, 30))
    r, s = np.empty(len(u)), np.ones(len(u))
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    live = len(length) - np.searchsorted(length[::-1], np.arange(1, length.max(initial=0) + 1))  # rows longer than each step
    past = None
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        past = e[at] if past is None else e[at] * (m[0, 1] + past[:n] * m[1, 1]) / (m[0, 0] + past[:n] * m[1, 0])
        r[at] = past
    end = begin + length - 1
    ahead = None
    for t, n in enumerate(live.tolist()):
        at = end[:n] - t
        if t:
            x = e[at + 1] * ahead[:n]
            ahead = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        else:
            ahead = np.ones(n)
        s[at] = ahead
    return r, s


def neighbours(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the words before and after; 0 at the ends of a row."""
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    inner = first[(first >= 0) & (first < len(values))]
    before[inner] = 0
    after[inner[inner > 0] - 1] = 0
    return before, after


class Field:
    """A fitted field: weight of each listed word, of listed neighbours and of the other features, the transitions, and the score's curve."""

    def __init__(self, slots: np.ndarray, odds: np.ndarray):
        self.slots, self.word = slots, np.r_[-4.0, odds]  # word[0]: any other word
        self.near, self.trans, self.curve = np.zeros(2), np.zeros((2, 2)), np.array([-3.0, 1.0, 0.5])
        self.other = np.zeros(N_FEATURES)

    def index(self, slot: np.ndarray) -> np.ndarray:
        """1 + place in slots, or 0."""
        if not len(self.slots):
            return np.zeros(len(slot), np.int64)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.where(self.slots[at] == slot, at + 1, 0)

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Probability of state 1 of each word."""
        return self._run(self.index(tokens.slot), tokens.features, tokens.first)[0]

    def _run(self, index, features, first):
        before, after = neighbours((index > 0).astype(float), first)
        u = self.word[index] + self.near[0] * before + self.near[1] * after
        for own in features:
            u += self.other[own]
        r, s = chain(u, first, self.trans)
        return r * s / (1 + r * s), r, s, u, before, after

    def fit(self, index: np.ndarray, features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int) -> None:
        """Gradient ascent on the log-likelihood of the word labels y, each row's words weighted: Adam for listed words, neighbours and transitions,
        steps by frequency for the other features, so that rare ones stay near 0."""
        # Some listed words count as unlisted, else the list alone would explain all labels.
        index = np.where(np.random.default_rng(0).random(len(index)) < UNLISTED, 0, index)
        inside = np.ones(len(y), bool)  # has a next word in its row
        inside[first[1:][first[1:] > 0] - 1] = False
        pairs = np.flatnonzero(inside)
        of_word = np.repeat(weight, np.diff(first))
        of_pair = of_word[pairs]
        seen = np.bincount(2 * y[pairs] + y[pairs + 1], of_pair, minlength=4).reshape(2, 2)
        n_word = len(self.word)
        theta = np.r_[self.word, self.near, self.trans.ravel()]
        start, mean, square = theta.copy(), np.zeros(len(theta)), np.zeros(len(theta))
        times = sum(np.bincount(own, of_word, N_FEATURES) for own in features)
        for step in range(1, steps + 1):
            self.word, self.near, self.trans = theta[:n_word], theta[n_word : n_word + 2], theta[n_word + 2 :].reshape(2, 2)
            p, r, s, u, before, after = self._run(index, features, first)
            x = np.exp(np.clip(u[pairs + 1], -30, 30)) * s[pairs + 1]
            m, past = np.exp(self.trans), r[pairs]
            joint = np.stack([np.full(len(past), m[0, 0]), m[0, 1] * x, past * m[1, 0], past * m[1, 1] * x])
            expected = (joint / joint.sum(0) * of_pair).sum(1).reshape(2, 2)
            miss = (y - p) * of_word
            gradient = np.r_[np.bincount(index, miss, n_word), miss @ before, miss @ after, (seen - expected).ravel()] - 0.1 * (theta - start)
            mean, square = 0.8 * mean + 0.2 * gradient, 0.95 * square + 0.05 * gradient**2
            theta = theta + 0.3 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
            self.other += (sum(np.bincount(own, miss, N_FEATURES) for own in features) - self.other) / (0.25 * times + 10)
        self.word, self.near, self.trans = theta[:n_word], theta[n_word : n_word + 2], theta[n_word + 2 :].reshape(2, 2)

    @staticmethod
    def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per row: 1, the log-odds of its likeliest word, and ln(1 + expected toxic words)."""
        n = len(first) - 1
        most, total = np.zeros(n), np.zeros(n)
        full = np.diff(first) > 0
        if full.any():
            most[full] = np.maximum.reduceat(p, first[:-1][full])
            total[full] = np.add.reduceat(p, first[:-1][full])
        most = np.clip(most, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(n), np.log(most / (1 - most)), np.log1p(total)], axis=1)

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(p, first) @ self.curve, -30, 30)))

    def fit_curve(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton's method, with a weak pull to the start."""
        start, pull = self.curve.copy(), 1e-2 * np.eye(3)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))
            gradient = x.T @ (weight * (label - q)) - pull @ (self.curve - start)
            self.curve = self.curve + np.clip(np.linalg.solve((x * (weight * q * (1 - q) + 1e-6)[:, None]).T @ x + pull, gradient), -3, 3)


def fit_field(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Field:
    """Learn a field.  rows: doc_id, text; labels: doc_id, label (0 or 1), one row an id.

    All labelled rows count for the word statistics; at most 2**SLOTS_LOG2 listed words, and `sample` documents
    for the fit, come to the driver.  A fifth of the sample is toxic, if so many are; the fit weighs both labels by
    how frequent they are.
    """

    def distinct(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text"), CHUNK):
                words = Words(batch.column("text").slice(lo, hi - lo), lower=True, breaks=NOT_ALNUM)
                slot = (words.hashes >> U(64 - SLOTS_LOG2)).astype(np.uint32)
                own = [np.unique(slot[a:z]).tobytes() for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(own, pa.binary())], ["doc_id", "slots"])

    def added(held):
        codes, slot = pd.factorize(np.concatenate([s for s, _ in held]))
        toxic = np.bincount(codes, np.concatenate([t for _, t in held]), len(slot)).astype(np.int64)
        return pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(np.bincount(codes, minlength=len(slot)) - toxic), pa.array(toxic)], ["slot", "clean", "toxic"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            own = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("slots")]
            held.append((np.concatenate(own), np.repeat(batch.column("label").to_numpy(), [len(x) for x in own])))
            size += len(held[-1][0])
            if size >= 4 * FLUSH:
                yield added(held)
                held, size = [], 0
        if held:
            yield added(held)

    of_rows = rows.where("doc_id is not null").mapInArrow(distinct, "doc_id long, slots binary")
    # Labels grow with the documents: the join is a shuffle at every size.
    counts = of_rows.join(labels.hint("merge"), "doc_id").select("label", "slots").mapInArrow(count, "slot int, clean long, toxic long")
    counts = counts.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.ln((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.ln((F.col("clean") + 0.5) / (n_clean + 1.0))
    table = counts.withColumn("odds", odds).where((F.col("toxic") >= max(SUPPORT, SHARE * n_toxic)) & (F.col("odds") >= ODDS)).select("slot", "odds").toArrow()
    order = np.argsort(table.column("slot").to_numpy())
    field = Field(table.column("slot").to_numpy()[order].astype(np.int64), table.column("odds").to_numpy()[order])

    # The smallest hashed ids of each label; orderBy and limit keep no more than so many rows a task.
    hashed = [F.xxhash64("doc_id"), "doc_id"]
    toxic = max(sample // 5, round(sample * n_toxic / max(1, n_toxic + n_clean)))
    chosen = labels.where("label = 0").orderBy(*hashed).limit(sample - toxic).union(labels.where("label = 1").orderBy(*hashed).limit(toxic))

    def sequences(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text"), CHUNK):
                tokens = Tokens(batch.column("text").slice(lo, hi - lo))
                ends = list(zip(tokens.first[:-1], tokens.first[1:], strict=True))
                yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.array([tokens.slot[a:z].astype(np.uint32).tobytes() for a, z in ends], pa.binary()), pa.array([tokens.features[:, a:z].astype(np.uint16).tobytes() for a, z in ends], pa.binary())], ["label", "slots", "features"])

    held = rows.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(sequences, "label int, slots binary, features binary").toArrow()
    if not len(held) or not n_toxic:
        return field
    label = held.column("label").to_numpy().astype(np.int64)
    own = [np.frombuffer(x.as_py(), np.uint32) for x in held.column("slots")]
    features = np.concatenate([np.frombuffer(x.as_py(), np.uint16).reshape(4, -1) for x in held.column("features")], axis=1).astype(np.int64)
    first = np.r_[0, np.cumsum([len(x) for x in own])]
    index = field.index(np.concatenate(own).astype(np.int64))
    y = ((index > 0) & np.repeat(label == 1, np.diff(first))).astype(np.int64)
    weight = np.where(label == 1, n_toxic / max(1, (label == 1).sum()), n_clean / max(1, (label == 0).sum()))
    weight *= len(label) / weight.sum()
    if len(index):
        field.fit(index, features, first, y, weight, steps)
    field.fit_curve(Field.summary(field._run(index, features, first)[0], first), label, weight)
    return field


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score_toxicity(docs: DataFrame, field: Field, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and spans (code points of runs of words with a marginal of 1/2 or more).

    One row for each input row.  A null or wordless text has no spans and the score of a text without
    toxic words.  Whole texts are tagged; a text of any length is one chain.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def tag(batches):
        f = model.value
        for batch in batches:
            for lo, hi in slices(batch.column("text"), CHUNK):
                part = batch.slice(lo, hi - lo)
                tokens = Tokens(part.column("text"))
                words, p = tokens.words, f.marginals(tokens)
                score = f.score(p, words.first)
                spans = [[] for _ in range(hi - lo)]
                hot = np.flatnonzero(p >= 0.5)
                for r in np.unique(words.rows[hot]).tolist():
                    own = hot[(hot >= words.first[r]) & (hot < words.first[r + 1])]
                    text = words.data[words.offsets[r] : words.offsets[r + 1]]
                    point = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
                    for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        a, z = words.starts[run[0]] - words.offsets[r], words.ends[run[-1]] - words.offsets[r]
                        spans[r].append({"start": int(point[a]), "end": int(point[z])})
                columns = [part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, SPANS)]
                yield pa.record_batch(columns, ["doc_id", "score", "predicted", "spans"])

    return text_rows(docs, id_col, text_col).mapInArrow(tag, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long>>")


def drop_toxic(docs: DataFrame, field: Field, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below the threshold.

    Null, empty and wordless texts have the score of a text without toxic words and stay; equal texts stay or go
    together; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def clean(batches):
        for batch in batches:
            ok = []
            text = batch.column(text_col)
            for lo, hi in slices(text, CHUNK):
                tokens = Tokens(text.slice(lo, hi - lo))
                ok.append(model.value.score(model.value.marginals(tokens), tokens.first) < threshold)
            yield batch.filter(pa.array(np.concatenate(ok))) if ok else batch

    return bounded(docs).mapInArrow(clean, docs.schema)


def training_labels(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label of the ids to learn from; of repeated ids the largest label counts; null ids and labels are left out."""
    c = F.col(f"`{id_col}`").cast("long")
    rows = labels.select(c.alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each document, learnt from the labels outside the fold.

    held_out: crc32(id as text) mod folds is fold (a null id counts as an empty text and is never learnt
    from).  Repeated rows have equal results; a score of just 1/2 is predicted 1.  Empty tables give an empty
    result; without labels every score is the curve's start.  Only the named columns are read.
    """
    learn = cut(training_labels(labels, label_col, folds, fold))
    rows = text_rows(docs, id_col, text_col)
    scored = score_toxicity(rows, fit_field(rows, learn))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")
