"""Corpus preparation in stages; each stage reads what its predecessor kept.

All stages but the last return the columns of their input as they are, extra
ones with any name among them. Null ids are kept, and a document with one is
judged by its text alone; it is linked with nothing in the third stage. A null
text counts as empty; an empty text is no duplicate of others than empty ones,
holds no benchmark passage and no pieces. Repeated rows are one document from
the second stage on. Ids that several different texts share are judged text by
text, but in the third stage as one document. Empty tables pass as such, and
without labels nothing is toxic. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import contamination, exact, minhash, pieces, toxicity
from gaugeline.llm.common import Scratch, read, scratch_scope
from gaugeline.llm.queries import PIECES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the labels of these documents."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label")).where(~toxicity.held_out())
    weights = toxicity.train(docs.select("doc_id", "text"), labels)
    return docs.where(toxicity.scorer(weights)(F.col("text")) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    found = exact.exact_duplicates(docs).where("NOT kept").select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again"))
    gone = found.where("NOT again").distinct()
    same = docs.doc_id.eqNullSafe(gone.doc_id) & (F.sha2(F.coalesce(docs.text, F.lit("")), 256) == gone.text_sha256)
    kept = docs.join(gone, same, "left_anti")
    return kept if found.where("again").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five words, similarity 0.8), the document with the smallest id."""
    found = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contamination.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    same = docs.doc_id.eqNullSafe(found.doc_id) & (F.xxhash64(docs.text) == found.text_key)
    return docs.join(found, same, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the pieces, their number, and whether they decode to the text."""
    found = pieces.decode(pieces.encode(docs, PIECES), PIECES)
    return found.select("doc_id", "ids", F.size("ids").alias("n_pieces"), (F.xxhash64("text") == F.col("text_key")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: A trained model's scores and byte-pair ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with scratch_scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
