"""A corpus in five stages: toxic documents, recurring lines, near duplicates, repeated passages, packing into sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the columns of documents. run()
writes each stage as Parquet to the shared folder and reads it again as the next one's docs.

Null and empty texts stay as they are up to the packing, which places them as empty items. Texts of any length are taken
in whole. Ties between copies go to the least id; rows that repeat an id and its text are copies of each other, of which
one stays. Extra columns keep their values, whatever their names, up to the packing. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.llm import lines, near, packing, repeats, toxicity
from envgrid.llm.common import read, stage

#: None: the first stage's classifier is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _recounted(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order, with n_chars (where docs has it) of the text as it is now."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from the labels of the documents given."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    scored = toxicity.score_texts(rows, model, keep=("row",), carry_text=True)
    return scored.where("predicted = 0").select("row.*", "text").select(docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across different ones."""
    return _recounted(lines.drop_lines(docs, counts=False), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    kept = stage(near.near_components(docs).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")), "kept")
    of = docs["doc_id"] == kept["_id"]
    again, unnamed = kept.where("n > 1"), docs.where(docs["doc_id"].isNull())
    if again.isEmpty():
        return docs.join(kept, of, "left_semi").unionByName(unnamed)
    # ids that several rows have: of rows with the same text one stays
    return docs.join(kept.where("n = 1"), of, "left_semi").unionByName(docs.join(again, of, "left_semi").dropDuplicates(["doc_id", "text"])).unionByName(unnamed)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 200 bytes or more that a document of smaller id, or the same one before, has."""
    return _recounted(repeats.remove_repeats(docs, keep="first", counts=False), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: their tokens, and the ids, pieces and places of the documents that they hold."""
    return packing.pack_sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
