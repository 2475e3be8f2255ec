"""Token counts as delta-maintained rollups.

A ledger in a folder takes batches of changes: documents inserted, deleted or revised.  A batch becomes
signed rows (a revision is a minus and a plus), which are added up by source, language and tokenizer
version; totals are the sum over batches, so they are additive.  Counts of single documents are kept
beside the totals, as deletes and revisions need the old ones; compaction replaces old batches by what
they add up to, so a commit reads the documents held and not the whole history.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokenizer versions: white-space words; words with punctuation apart (a run of ASCII letters, digits and non-ASCII characters, or one other character).
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"}
GROUP = ("source", "lang", "tokenizer")
COUNTS = ("n_docs", "n_tokens", "n_chars")


def token_count(text: Column, pattern: str) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def counted(docs: DataFrame, tokenizers=None, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_docs (1), n_tokens, n_chars: one row a document and tokenizer version."""
    c = lambda name: F.col(f"`{name}`")
    text = c(text_col).cast("string")
    versions = F.array(*(F.struct(F.lit(v).alias("tokenizer"), token_count(text, p).alias("n_tokens")) for v, p in (tokenizers or TOKENIZERS).items()))
    rows = docs.select(c(id_col).cast("long").alias("doc_id"), c(source_col).cast("string").alias("source"), c(lang_col).cast("string").alias("lang"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.explode(versions).alias("v"))
    return rows.select("doc_id", "source", "lang", "v.tokenizer", F.lit(1).cast("long").alias("n_docs"), "v.n_tokens", "n_chars")


class Ledger:
    """The rollup kept in a folder that all executors share.

    A batch is written to a folder of its own and counts from the moment its mark is there, which is one
    empty file created after all of its rows; a batch that breaks off leaves no mark and is written anew.
    Committing a batch id again changes nothing.

    Each id is held once: an insert of a held id revises it, a revision of an id not held inserts it, a
    delete of an id not held is no change; within a batch deletes come first.  Of several rows of one id in
    a batch the one with most characters counts (then the largest source, language and tokens).  Rows
    without an id are documents that nothing can name again: each insert adds them, and deletes and
    revisions of a null id are no changes.  Null sources and languages are groups of their own.  Columns
    other than those of counted() are not read.
    """

    #: Batches that pile up before a commit compacts those before it.
    COMPACT = 32

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> dict[str, str]:
        """Folder of each batch with a mark; if two writers have marked one, the first name counts."""
        root = self._path(f"{self.folder}/{kind}")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return dict(sorted(((n.rsplit("@", 1)[0], f"{self.folder}/data/{n}") for n in names), reverse=True))

    def _mark(self, kind: str, name: str) -> None:
        self._fs.create(self._path(f"{self.folder}/{kind}/{name}")).close()

    def _rows(self, kind: str, before: str | None = None) -> DataFrame | None:
        """Signed rows (documents or totals) of the committed batches, or of those before one: the last compaction and what came after."""
        inside = lambda batch: before is None or batch < before
        compacted = {b: f for b, f in self._marked("compactions").items() if inside(b)}
        last = max(compacted, default="")
        folders = [f for b, f in self._marked("commits").items() if inside(b) and b > last] + ([compacted[last]] if compacted else [])
        return self.spark.read.parquet(*(f"{f}/{kind}" for f in folders)) if folders else None

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit a batch; False if it was committed before.  Batch ids ascend.  inserts, revisions: rows of counted(); deletes: doc_id."""
        committed = self._marked("commits")
        if batch in committed:
            return False
        if sum(b > max(self._marked("compactions"), default="") for b in committed) >= self.COMPACT:
            self.compact()
        columns = ("doc_id", *GROUP, *COUNTS)
        named = [df.where("doc_id is not null").select(*columns) for df in (inserts, revisions) if df is not None]
        gone = [df.select("doc_id") for df in (*named, *([deletes] if deletes is not None else []))]
        signed = []
        if named:
            best = F.max_by(F.struct(*GROUP, *COUNTS), F.struct("n_chars", "source", "lang", "n_tokens")).alias("r")
            signed.append(_union(named).groupBy("doc_id", F.col("tokenizer").alias("_version")).agg(best).select("doc_id", "r.*"))
        if inserts is not None:
            signed.append(inserts.where("doc_id is null").select(*columns))
        held = self._rows("documents", batch)
        if held is not None and gone:
            now = held.join(_union(gone).distinct(), "doc_id", "left_semi").groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n_docs <> 0")
            signed.append(now.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in COUNTS)))
        if not signed:  # deletes from an empty ledger
            signed = [self.spark.createDataFrame([], DOCUMENTS)]
        self._write("commits", batch, _union(signed))
        return True

    def compact(self) -> None:
        """Replace what the committed batches hold by its sum, for later reads."""
        committed = self._marked("commits")
        if committed and max(committed) not in self._marked("compactions"):
            self._write("compactions", max(committed), self._rows("documents").groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n_docs <> 0"))

    def _write(self, kind: str, batch: str, signed: DataFrame) -> None:
        name = f"{batch}@{uuid.uuid4().hex}"
        signed.write.parquet(f"{self.folder}/data/{name}/documents")
        written = self.spark.read.parquet(f"{self.folder}/data/{name}/documents")
        written.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in COUNTS)).write.parquet(f"{self.folder}/data/{name}/totals")
        self._mark(kind, name)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars over all committed batches; groups that came to nothing are left out."""
        rows = self._rows("totals")
        if rows is None:
            return self.spark.createDataFrame([], DOCUMENTS).drop("doc_id")
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def documents(self) -> DataFrame:
        """The documents that the ledger holds now, with their counts; those without an id are added up by group."""
        rows = self._rows("documents")
        if rows is None:
            return self.spark.createDataFrame([], DOCUMENTS)
        return rows.groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in COUNTS)).where("n_docs <> 0")


DOCUMENTS = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
