"""Training-data pipeline: toxicity, near duplicates, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
The first three return the columns of documents (doc_id, text, lang, source, n_chars; extra columns stay, too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, sentencepiece, toxicity
from tessera.llm.common import stage

#: Most row keys in a broadcast: 16 MB.
BROADCAST_KEYS = 1_000_000


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5. The classifier is fitted on the labelled rows of docs that op7 may learn from; null and empty texts stay, and all do where nothing could be learnt."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.LEARN)
    if not model[0].any():  # nothing could be learnt: one score for all
        return docs
    return unpacked(toxicity.score(packed(docs), *model).where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, similarity 0.75) one row stays, of those with the smallest doc_id.

    Rows are dropped one by one, so that rows of one doc_id with other texts are judged by their own. Texts without words link with nothing, so that
    all of them stay, as do rows with a null doc_id. No rows give no rows.
    """
    rows = jaccard.row_keys(packed(docs))
    gone = stage(jaccard.similarity_join(rows).where("not stays").select("_src", "_row"), "gone")
    # keys by broadcast while they are few, else by a join of both sides
    few = gone.count() <= BROADCAST_KEYS
    return unpacked(rows.join(F.broadcast(gone) if few else gone, ["_src", "_row"], "left_anti"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.decontaminate(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.where("n_hit = 0"), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip of every document that is left."""
    return sentencepiece.encode(docs.select("doc_id", "text"), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: A trained classifier and a vocabulary decide; SQL has neither. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what passes from stage to stage is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
