"""A corpus pipeline of five of the operators: reject, deduplicate, cut repeats, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nibblespark.llm import decontamination, nbsvm, packing, simhash, suffix_dedup
from nibblespark.llm._common import materialise
from nibblespark.llm._rows import named, scanned
from nibblespark.llm._tokens import public_tokenizer

#: Rows with a benchmark passage that are broadcast to be left out.
BROADCAST_ROWS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on this stage's labelled rows) rejects go.

    Null and empty texts get the score of a text without n-grams. Repeated rows go or stay alike. Without labels
    of both classes every score is 0.5, and all rows go. All columns are kept. An empty table stays empty.
    """
    model = nbsvm.train(docs, _table(spark, sf_dir, "labels"))
    aside = docs.withColumnRenamed("score", "__score")  # an extra column of that name would be replaced
    kept = nbsvm.score(aside, model, aside.columns).where(F.col("score") >= nbsvm.THRESHOLD).drop("score")
    return kept.withColumnRenamed("__score", "score").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest doc_id.

    Rows are told apart by place, not by id: of repeated rows one stays, whether they have an id or not, and a
    row never goes for sharing its id with a copy. Rows without an id stay only where their group has no other.
    Null, empty and blank texts are one group. An empty table stays empty. All columns are kept.
    """
    return simhash.without_copies(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes, and of over 50 words however short, are cut out of the texts; every row stays.

    Null texts stay null; a text may become empty. n_chars is counted anew; all other columns are kept, those
    with the name of one of the operator's results too. Equal rows are at most one after the stage before; given
    alone to this stage, they lose what they share. An empty table stays empty.
    """
    aside = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in suffix_dedup.RESULTS}
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(aside), words=suffix_dedup.WORDS)
    cut = cut.drop(*suffix_dedup.RESULTS).withColumnsRenamed({v: k for k, v in aside.items()})
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go, by their place: rows that share an id with them stay.

    Null and empty texts hold nothing. Repeated rows go or stay alike. All columns are kept. An empty table, of
    documents or of items, leaves the documents as they are.
    """
    rows, keys = named(scanned(docs)), ["__block", "__row"]
    found = decontamination.contaminated(rows, _table(spark, sf_dir, "benchmark"), tuple(keys)).select(*keys).distinct()
    found = materialise(found, "leaks")
    few = found.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(found) if few else found, keys, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized, cut and packed into sequences.

    Null and empty texts are one piece, of the end id alone. Repeated rows and null ids are packed as rows of
    their own. Extra columns are left out. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, the fingerprints, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
