"""Language ID, exact de-duplication, near de-duplication, mixing and packing of a corpus, stage by stage.

Each stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introngrid.llm import exact, langid, mix, packing, simhash
from introngrid.llm.queries import tokenizer_path
from introngrid.storage import work_folder

#: Documents below this score look alike to every language: their best language leads by next to nothing.
LEAST_SCORE = 0.001
#: Near copies: five-word shingles of at least this Jaccard similarity.
NEAR_WIDTH, NEAR_LEAST = 5, 0.8


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified; where no label allows a model, those with a letter."""
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs, model, prefix="__")
    return told.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*[f"`{c}`" for c in docs.columns])


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.drop_near_copies(docs, width=NEAR_WIDTH, least=NEAR_LEAST)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks."""
    return mix.mix_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of token ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", _language), ("exact_dedup", _exact), ("simhash_dedup", _near), ("mixing", _mix), ("packing", _pack)]

#: Mixing draws by a hash, near copies need components and packing needs a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{work_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
