"""A training-corpus pipeline: toxic documents go, recurring lines go, near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's docs.
All but the last return the columns of documents.

Edge cases, in every stage: an empty table stays empty; columns beside doc_id, text, source and n_chars pass through,
whatever their names; a null text is an empty one and stays null.  The rest is told at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, linededup, mixing, simhash, toxicity
from quillstone.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic are rejected; the model learns from the labels outside the held-out fold.

    Texts that are null, empty or blank score 0 and stay, as do all documents if the labels hold one class only;
    repeated rows share their fate; a null doc_id is scored like any other and never learnt from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, however short; documents stay, n_chars follows the text.

    Rows of one doc_id, or of none, are one document; a document that loses all lines keeps an empty text."""
    out = linededup.drop_recurring_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; of repeated rows one.

    Texts without words are copies of each other; a group of null ids keeps one of its texts."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted 0 to 3 times, to the sources' target weights; a null source is a source of its own.

    Texts without words add nothing to a source's size and are emitted at its rate, not at all in a source without words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every emitted document; a null doc_id stays null."""
    return bpe.encode_decode(docs, bpe.default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over documents.  Stage tables lie in corpus-pipeline/<run_id> of the shared checkpoint folder, one folder a
    stage; a run under the same run_id takes up the stages that are complete there, one without an id starts afresh."""
    root = f"{shared_folder(spark)}/corpus-pipeline/{run_id or uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = _stored(spark, f"{root}/{i + 1}-{name.replace(' ', '-')}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def _stored(spark: SparkSession, path: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, made and written first unless it is complete there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Toxicity is a trained model and encoding a tokenizer, so SQL can't express run(); tests/llm holds it against brute force.
ORACLE_SQL = None
