"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage works on all that the one
before it has kept, and all but the last return the columns of `documents`.  Null and empty texts are in no
group, hold no benchmark passage and no personal data and aren't toxic: they stay until the mix, which takes
words.  Null ids are ordinary; repeated rows are near duplicates of each other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import toxic_crf
from docloom.llm.blocks import cut, shared_folder, text_rows
from docloom.llm.jaccard_join import deduplicate
from docloom.llm.mixing import mix_sources
from docloom.llm.sanitise import sanitise
from docloom.llm.tiling import decontaminate

#: Near duplicates: 100 * Jaccard from this on, over shingles of so many words (op4_jaccard_join has its own contract).
PERCENT, SHINGLE = 80, 5
#: Labels of ids whose crc32 falls in this fold are never learnt from.
FOLDS, FOLD = 5, 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field doesn't take for toxic."""
    labels = cut(toxic_crf.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", FOLDS, FOLD))
    return toxic_crf.drop_toxic(docs, toxic_crf.fit_field(text_rows(docs), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id."""
    return deduplicate(docs, percent=PERCENT, k=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced; n_chars follows the new text."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return mix_sources(docs, keep=("text", "lang", "n_chars")).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", sanitise_personal_data),
    ("mixing", mix),
]

#: The stages' models and dynamic programme are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
