"""From raw documents to packed token sequences: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever further ones the table has. run() writes each result to the shared folder and reads
it back for the next stage.

Documents without a letter, null and empty texts among them, go in the first stage; with no labelled
document to learn from there is no language to reject, and all others pass it. Rows that share an id, and rows without one,
are documents of their own, except that an overlap with the benchmark takes all rows of its id. A table
without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontamination, language_id, near_dups, packing, secrets
from keystrata.llm.common import clean_name, stored, table
from keystrata.llm.queries import repository, tokenizer_path

#: Cosine below which a document is of none of the languages. Of the 51,282 documents of 0.1 GB none is
#: below it: the least has 0.093 (one of a few words over and over), one in a thousand is below 0.23. Random
#: letters, 100 at a time, have 0.05 on average and 0.15 at most.
LEAST_LANGUAGE_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; where lang is null, it becomes the predicted one."""
    prototypes = language_id.fit(language_id.training_rows(docs))
    if not prototypes.languages:  # nothing was learned, so all that has a letter stays
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = (clean_name(docs.columns, c) for c in ("lang_pred", "score"))
    known = language_id.predict(docs, prototypes, keep_text=True).where(language_id.accepted(F.col(pred), F.col(score), LEAST_LANGUAGE_SCORE))
    return known.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id."""
    return near_dups.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in the text; n_chars follows the text where that changed."""
    before = docs.withColumn("n_chars", F.struct("n_chars", F.xxhash64("text").alias("of")))
    after = secrets.redact(before, repository=repository())
    n_chars = F.when(F.xxhash64("text") == F.col("n_chars.of"), F.col("n_chars.n_chars")).otherwise(F.length("text").cast("long"))
    return after.withColumn("n_chars", n_chars).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place there."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the language profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
