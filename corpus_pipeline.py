"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, under their names and with their values,
whatever other columns there are. ``run`` writes every stage's result as
Parquet to the shared folder and rereads it for the next; a stage's folder goes
when the next one has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import conv_classifier, cotrain, lsh_forest, mixing, pattern_pack
from brindle.llm.common import fresh, shared_folder, table
from brindle.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts and nulls in other columns are scored like other
    values, whole texts whatever their length; rows that repeat are judged
    alike and all stay or go. Without labels of both classes all stay. An empty
    table gives an empty one.
    """
    names = fresh(docs, "content_score", "meta_score", "score", "kept")
    scored = cotrain.score_rows(docs, cotrain.fit_quality(docs, table(spark, sf_dir, "labels")), names)
    return scored.filter(F.col(names[-1])).select(*[f"`{c}`" for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the toxicity threshold or above go.

    Null and empty texts have the score of no words; whole texts are scored
    whatever their length; rows that repeat stay or go together. An empty table
    gives an empty one.
    """
    (name,) = fresh(docs, "toxic_score")
    scored = conv_classifier.score_rows(docs, conv_classifier.fit_toxicity(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.filter(F.col(name) < 0.3).select(*[f"`{c}`" for c in docs.columns])


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays.

    Null texts, texts without words and rows with a null doc_id all stay; texts
    under one id are different documents if they differ; a row that repeats an
    id and its text goes. An empty table gives an empty one.
    """
    return lsh_forest.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them.

    Null sources are one source; null texts and texts without words have no
    size and are not taken; rows that repeat share what is taken of them
    evenly. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece of a document.

    A null text is empty and still has its end token; long texts are cut into
    pieces; each row is packed, repeated or not. An empty table gives an empty one.
    """
    return pattern_pack.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("toxicity", toxicity), ("jaccard", jaccard), ("mixture", mixture), ("packing", packing)]

#: Trained models and a tokenizer decide; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _remove(spark, f"{folder}/{before}")
        before = name
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Through Spark's file systems, so that the folder may be in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
