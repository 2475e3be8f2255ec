"""Personal data: patterns, and terms that give protected values away (information-theoretic sanitisation).

Pattern matches (email, ip, card, phone) are the protected entities.  A term of the documents that hold an
entity (a word that no pattern match touches) discloses

    PMI(entity; term) / IC(entity) = log2(N df(entity, term) / (df(entity) df(term))) / log2(N / df(entity))

of the entity's information, with document frequencies counted over the whole corpus.  Terms that disclose
`disclosure` of it or more, in `support` documents or more, are spans of kind `term` wherever they stand in
the documents that hold the entity: generalised, or removed if they disclose `removal` or more.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import FLUSH, bounded, cut, fresh, row_key
from docloom.llm.tokens import NOT_ALNUM, U, Words, slices

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE, REMOVAL, SUPPORT = 0.8, 0.95, 2
#: Bits of the fixed-size filters of terms, pairs and rows, and of the one of entities.
FILTER_LOG2, ENTITIES_LOG2 = 24, 20
#: A term in at least this part of all rows is broadcast with its frequency: (terms a row) / COMMON at most.
COMMON = 1 / 16384

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def emails(text: str):
    """Leftmost matches of local@domain.  An address starts at the run before its @, so each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    """Four dotted numbers, taken from the left of each dotted run."""
    if "." not in text:
        return
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, start = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


FINDERS = (emails, ips, cards, phones)


def patterns(text: str) -> list[tuple[str, int, int]]:
    """All pattern matches by kind, then start; code points, end exclusive.  Linear in the text."""
    return [(kind, a, z) for kind, find in zip(KINDS, FINDERS, strict=True) for a, z in find(text)]


def entity_of(kind: str, value: str) -> int:
    """64-bit name of a value, whatever its spacing or case."""
    value = value.translate(_UPPER) if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text, at its length, with spaces for the words that the spans touch and for the spans."""
    out, done = [], 0
    for a, z in sorted(spans):
        while a > done and _TERM.match(text[a]) and _TERM.match(text[a - 1]):
            a -= 1
        while z < len(text) and _TERM.match(text[z - 1]) and _TERM.match(text[z]):
            z += 1
        a = max(a, done)
        if z > a:
            out += [text[done:a], " " * (z - a)]
            done = z
    return "".join([*out, text[done:]])


DETECTED = "doc_id long, key long, base array<struct<kind:string,start:long,end:long>>, entities array<long>, terms binary, base_sha256 string"
BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
TERMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("disclosed", pa.float64())]))


def term_hashes(terms: list[str]) -> np.ndarray:
    return Words(pa.array(terms, pa.string()), lower=True, breaks=NOT_ALNUM).hashes.view(np.int64)


def detect(rows: DataFrame) -> DataFrame:
    """Pattern spans of each row, and its distinct entities and terms (none without an entity).  rows: doc_id, text, key."""

    def scan(batches):
        for batch in batches:
            base, entities, rest, digests = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = patterns(text)
                base.append([{"kind": k, "start": a, "end": z} for k, a, z in spans])
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest())
                entities.append(sorted({entity_of(k, text[a:z]) for k, a, z in spans}))
                rest.append(masked(text, [(a, z) for _, a, z in spans]) if spans else "")
            terms, rest = [], pa.array(rest, pa.string())
            for lo, hi in slices(rest):
                words = Words(rest.slice(lo, hi - lo), lower=True, breaks=NOT_ALNUM)
                terms += [np.unique(words.hashes[a:z]).tobytes() for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(base, BASE), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.binary()), pa.array(digests)], ["doc_id", "key", "base", "entities", "terms", "base_sha256"])

    return rows.mapInArrow(scan, DETECTED)


def slot_of(h: np.ndarray, log2: int) -> np.ndarray:
    return (h.view(U) >> U(64 - log2)).astype(np.int64)


def slots_in(df: DataFrame, column: Column, log2: int = FILTER_LOG2) -> np.ndarray:
    """Filter of fixed size, as packed bits: the slots of the column's values."""
    slots = df.select(F.shiftrightunsigned(column, 64 - log2).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(1 << log2, bool)
    bits[slots] = True
    return np.packbits(bits)


def passes(bits: np.ndarray, h: np.ndarray, log2: int = FILTER_LOG2) -> np.ndarray:
    slot = slot_of(h, log2)
    return (bits[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df over all rows: added up in the tasks before the shuffle."""

    def ship(held):
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                words = Words(batch.column("text").slice(lo, hi - lo), lower=True, breaks=NOT_ALNUM)
                h, row = words.hashes, words.rows
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                held.append(h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]] if len(h) else h)
                size += len(held[-1])
                if size >= FLUSH:
                    yield ship(held)
                    held, size = [], 0
        if size:
            yield ship(held)

    return rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def most_documents(df_entity, n: float, disclosure: float):
    """A term in more documents discloses too little of an entity in df_entity of n, even if it is in all of those."""
    return n * (df_entity / n) ** disclosure * (1 + 1e-9)


def pairs_of(found: DataFrame, frequency, terms, n: int, disclosure: float, wanted=None) -> DataFrame:
    """key, entity, term: all pairs of a row's entities and terms whose frequencies can reach the threshold, and some that can't.

    frequency: by entity slot, of its most frequent entity (0: none).  terms: common terms and their frequencies,
    and by term slot log2 of its rarest term's frequency (255: none).  wanted: filter of the pairs.
    """

    def scan(batches):
        held, size = [], 0
        common, counts, rarest = terms.value
        for batch in batches:
            for key, own, packed in zip(batch.column("key"), batch.column("entities"), batch.column("terms"), strict=True):
                entity = np.array(own.as_py(), np.int64)
                df = frequency.value[slot_of(entity, ENTITIES_LOG2)]
                entity, most = entity[df > 0], most_documents(df[df > 0], n, disclosure)
                if not len(entity):
                    continue
                term = np.frombuffer(packed.as_py(), np.int64)
                scale = rarest[slot_of(term, FILTER_LOG2)]
                least = np.where(scale < 255, np.exp2(scale.astype(np.float64)), np.inf)
                if len(common):
                    at = np.minimum(np.searchsorted(common, term), len(common) - 1)
                    least = np.where(common[at] == term, counts[at], least)
                for e, limit in zip(entity, most, strict=True):
                    some = term[least <= limit]
                    if wanted is not None:
                        some = some[passes(wanted.value, some ^ e)]
                    held.append((np.full(len(some), key.as_py()), np.full(len(some), e), some))
                    size += len(some)
                    if size >= FLUSH:
                        yield ship(held)
                        held, size = [], 0
        if size:
            yield ship(held)

    def ship(held):
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "entity", "term"])

    return found.where(F.size("entities") > 0).select("key", "entities", "terms").mapInArrow(scan, "key long, entity long, term long")


def disclosing_terms(rows: DataFrame, found: DataFrame, disclosure: float, support: int) -> DataFrame:
    """key, term, disclosed: the terms of each row that disclose one of its entities, from all rows' counts."""
    sc, n = rows.sparkSession.sparkContext, rows.count()
    entities = found.select("key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    entities = cut(entities.where(F.col("df_entity") >= support))
    slots = entities.groupBy(F.shiftrightunsigned("entity", 64 - ENTITIES_LOG2).cast("int").alias("slot")).agg(F.max("df_entity").alias("df")).toArrow()
    frequency = np.zeros(1 << ENTITIES_LOG2, np.int64)
    frequency[slots.column("slot").to_numpy()] = slots.column("df").to_numpy()
    most = float(most_documents(frequency.max(), max(n, 1), disclosure))
    frequency = sc.broadcast(frequency)
    terms = document_frequencies(rows).withColumnRenamed("df", "df_term")
    terms = cut(terms.where((F.col("df_term") >= support) & (F.col("df_term") <= most)))
    often = F.col("df_term") >= n * COMMON
    common = terms.where(often).toArrow()
    order = np.argsort(common.column("term").to_numpy())
    slots = terms.where(~often).groupBy(F.shiftrightunsigned("term", 64 - FILTER_LOG2).cast("int").alias("slot")).agg(F.floor(F.log2(F.min("df_term"))).cast("short").alias("scale")).toArrow()
    rarest = np.full(1 << FILTER_LOG2, 255, np.uint8)
    rarest[slots.column("slot").to_numpy()] = slots.column("scale").to_numpy()
    known = sc.broadcast((common.column("term").to_numpy()[order], common.column("df_term").to_numpy()[order], rarest))
    together = pairs_of(found, frequency, known, n, disclosure).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    pmi = F.log2(F.lit(float(n)) * F.col("both") / (F.col("df_entity") * F.col("df_term")))
    information = F.log2(F.lit(float(n)) / F.col("df_entity"))
    disclosed = F.when(information > 0, pmi / information).otherwise(0.0)
    pairs = together.join(entities, "entity").join(terms, "term").withColumn("disclosed", disclosed).where(F.col("disclosed") >= disclosure)
    pairs = cut(pairs.select("entity", "term", "disclosed"))
    wanted = sc.broadcast(slots_in(pairs, F.col("entity").bitwiseXOR(F.col("term"))))
    return pairs_of(found, frequency, known, n, disclosure, wanted).join(pairs, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosed").alias("disclosed"))


def term_spans(rows: DataFrame, of_rows: DataFrame) -> DataFrame:
    """key, terms: where the given terms (key, term, disclosed) stand in the rows of these keys.  Other rows' texts are not shuffled."""
    wanted = rows.sparkSession.sparkContext.broadcast(slots_in(of_rows, F.col("key")))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch.column("key").to_numpy())))

    def place(batches):
        for batch in batches:
            out = []
            for value, own in zip(batch.column("text"), batch.column("own"), strict=True):
                text, disclosed = value.as_py(), {x["term"]: x["disclosed"] for x in own.as_py()}
                places = [m.span() for m in _TERM.finditer(masked(text, [(a, z) for _, a, z in patterns(text)]))]
                terms = term_hashes([text[a:z] for a, z in places]).tolist()
                out.append([{"start": a, "end": z, "disclosed": disclosed[t]} for t, (a, z) in zip(terms, places, strict=True) if t in disclosed])
            yield pa.record_batch([batch.column("key"), pa.array(out, TERMS)], ["key", "terms"])

    lists = of_rows.groupBy("key").agg(F.collect_list(F.struct("term", "disclosed")).alias("own"))
    held = rows.select("key", "text").mapInArrow(some, "key long, text string").join(lists, "key")
    return held.mapInArrow(place, "key long, terms array<struct<start:long,end:long,disclosed:double>>").dropDuplicates(["key"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return bounded(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), row_key(id_col, text_col).alias("key"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, base (pattern spans), terms (spans of disclosing terms with what they disclose) and base_sha256.

    One row for each input row.  A null text is empty.  Repeated rows (same id and text) have equal results
    and count once where pairs are counted.  A null id is an ordinary id.  Texts are read whole.  An empty table
    gives an empty result.  Only the named columns are read.
    """
    rows = _keyed(docs, id_col, text_col)
    found = cut(detect(rows))
    spans = term_spans(rows, cut(disclosing_terms(rows, found, disclosure, support)))
    empty = F.array().cast("array<struct<start:long,end:long,disclosed:double>>")
    return found.drop("terms").join(spans, "key", "left").select("doc_id", "key", "base", F.coalesce("terms", empty).alias("terms"), "base_sha256")


def span_digest(found: DataFrame) -> DataFrame:
    """The counts by kind and all spans as kind:start:end, pattern spans first."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    base = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), "base_sha256", F.concat_ws(",", F.concat(base, terms)).alias("spans"))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, z, label in sorted(spans):
        if a >= done:
            out += [text[done:a], label]
        done = max(done, z)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, removal: float = REMOVAL, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with pattern spans replaced by their kind and disclosing terms generalised or removed.

    All rows and columns stay; a null text stays null.  A generalised term becomes [WORD] or [NUMBER].
    """
    key, base_col, terms_col = fresh(docs, "_key"), fresh(docs, "_base"), fresh(docs, "_terms")
    spans = find_personal_data(docs, disclosure, support, id_col, text_col).where((F.size("base") > 0) | (F.size("terms") > 0))
    spans = spans.select(F.col("key").alias(key), F.col("base").alias(base_col), F.col("terms").alias(terms_col)).dropDuplicates([key])
    both = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left").drop(key)
    names = docs.columns
    place = names.index(text_col)

    def rewrite(batches):
        for batch in batches:
            texts = []
            for value, base, terms in zip(batch.column(place), batch.column(base_col), batch.column(terms_col), strict=True):
                if base.is_valid and value.is_valid:
                    own = value.as_py()
                    spans = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base.as_py()]
                    spans += [(s["start"], s["end"], "" if s["disclosed"] >= removal else "[NUMBER]" if own[s["start"] : s["end"]].isdigit() else "[WORD]") for s in terms.as_py()]
                    texts.append(replaced(own, spans))
                else:
                    texts.append(value.as_py())
            yield pa.record_batch([pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(names))], names)

    return both.mapInArrow(rewrite, docs.schema)
