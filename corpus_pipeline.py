"""The corpus pipeline: quality, toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
documents. All but the last return the columns of ``documents``; the last returns a row for each piece of a packed sequence.

Nulls and edge cases: a null or empty text counts as empty in every stage and is packed as the end id alone; a null doc_id is
carried along, and without a label; rows equal in doc_id and text are one row from the near-duplicate stage on; documents of a null
language or source are mixed under the name ''; further columns are kept up to the last stage, whatever their names; where no
labelled document is left, no document is rejected; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing, quality, simhash, toxicity
from tickloom.llm.common import cut, table
from tickloom.llm.queries import LABELLED, vocabulary

#: Documents that score less than this for quality, or this much for toxicity, go.
LEAST_QUALITY, MOST_TOXICITY = 0.5, 0.3
#: No document is repeated, and the mix may leave out a tenth of the tokens to approach its weights.
MIX = mixing.Mix(fraction=0.9, max_epochs=1)


def _rows(docs: DataFrame) -> DataFrame:
    """The text, and all columns in a struct, where no name of theirs can meet that of a score."""
    return docs.select("text", F.struct("*").alias("row"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents among ``docs`` and drop those that the classifier rejects."""
    weights = quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"), "quality", LABELLED))
    return quality.score(_rows(docs), weights).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents among ``docs`` and drop those that the tagger rejects."""
    model = toxicity.fit(quality.sample(docs, table(spark, sf_dir, "labels"), "toxic", LABELLED))
    return toxicity.score(_rows(docs), model).where(F.col("score") < MOST_TOXICITY).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return simhash.representatives(docs, words_each=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents towards the target weights of domains, languages and sources."""
    return mixing.mixed(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096), capacity=4096)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express a trained classifier, a tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
