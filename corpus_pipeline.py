"""Corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and reads them again, so a
lost executor costs no more than the stage at work; a stage's rows are deleted once the next one's are
written, the last one's when the driver ends.

Null, empty and wordless texts fail the quality stage. Rows with a null id pass the stages that judge a
text alone and are never the copy that goes. Repeated rows, and rows of one id, are judged alike; rows
equal in id and text stay or go together. Extra columns are handed on as they are, but those named like
a result of the stage at work (score, kept, n_words and the like) are not looked at. An empty table
gives empty stages, and without labels every document has the same score.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakefold.llm import jaccard, packing, quality, substring, toxicity
from lakefold.llm._cluster import new_folder
from lakefold.llm.queries import BYTE_BPE, ID_CRC, PIECE_BPE
from lakefold.session import delete_folder

#: Near-duplicates: runs of five words, Jaccard similarity of 0.8.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones outside its hold-out, scores under TOXIC."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, learn=F.expr(f"{ID_CRC} % 4 <> 2"))
    scored = toxicity.score(_packed(docs), model).where(F.col("score") < TOXIC)
    return scored.select("_row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the tokenisers' bands."""
    return quality.judge(_packed(docs), PIECE_BPE, BYTE_BPE).where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return jaccard.one_of_each(docs, n=SHINGLE, threshold=SIMILARITY).select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that also start earlier; n_chars follows the text."""
    # the text goes apart from its row, which takes it back in its place
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("_row"))
    cut = substring.dedup_substrings(rows)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per part of a document, with its bin."""
    return packing.pack(docs, keep=["doc_id"])


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that a stage needs, and whole rows that its results can't clash with."""
    return docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_row"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]
#: A fitted model, tokenisers and best-fit are beyond SQL; tests hold the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = name
    return docs
